"""Bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's word shingles and how many
distinct shingles there are or seem to be. Sketches of parts merge into the sketch of the
whole; two sketches estimate resemblance, containment and the union's distinct count.

Sketch text: base64 of 5-byte big-endian hashes in rising order after a 2-byte k.

The edited text of a document takes its last quarter from the start of the next document
by id. Its SHA-256 needs all of it in one place, so texts are dealt into ranges of (id, hash
of the text) of about equal numbers of characters, each to a task of its own, with the
range's first row repeated behind the range before it; a task walks its sorted rows and
always sees the next one. Long texts are sketched in parts, whose sketches are merged.

Edge cases: null texts are empty; an empty text has an empty sketch, equal only to another
empty one; texts of fewer words than a shingle are one shingle; equal ids are ordered by a
hash of their texts; null ids come first; the only row is its own next; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import persist, range_of

K, SHINGLE, WIDTH = 128, 5, 5
SPACE = (1 << (8 * WIDTH)) - 1
#: Characters of text that a range has about, unless there would be over MAX_RANGES (whose bounds are part of the plan).
RANGE_CHARS, MAX_RANGES = 24_000_000, 16_384
#: Words of a part of a long text; parts overlap by a shingle less one word.
PART_WORDS = 50_000


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when full."""

    LIMIT = 120_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


WORDS = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words, or of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(shingle, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ words[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 8 * WIDTH)) & np.uint64(SPACE)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, rising."""
    if len(hashes) > 8 * k:  # cut first: repeats among the smallest only make the next cut wider
        take = 4 * k
        while take < len(hashes):
            low = np.unique(np.partition(hashes, take)[:take])
            if len(low) > k:  # what equals the last value may be cut, values below it are whole
                return low[:k]
            take *= 4
    return np.unique(hashes)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    return bottom(np.concatenate(sketches), k)


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else estimated from the k-th smallest hash."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / (SPACE + 1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard likeness, from the k smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """How much of a's shingles b has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k=k), k)
    return min(1.0, shared / distinct_count(a, k))


def encode(sketch: np.ndarray, k: int = K) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()
    return base64.b64encode(k.to_bytes(2, "big") + raw).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text)[2:], np.uint8).reshape(-1, WIDTH)
    return np.hstack([np.zeros((len(raw), 8 - WIDTH), np.uint8), raw]).copy().view(">u8").reshape(-1).astype(np.uint64)


def sketch_words(words: np.ndarray, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """The sketch of a sequence of word hashes, merged from parts of PART_WORDS."""
    if len(words) <= PART_WORDS:
        return bottom(shingle_hashes(words, shingle), k)
    starts = range(0, len(words) - shingle + 1, PART_WORDS)
    return merge(*(bottom(shingle_hashes(words[a : a + PART_WORDS + shingle - 1], shingle), k) for a in starts), k=k)


def sketch_text(text: str | None, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    return sketch_words(word_hashes((text or "").split()), k, shingle)


def edited_sketch(cut: int, edited: str, text: str, words: np.ndarray, k: int, shingle: int) -> np.ndarray:
    """Sketch of ``edited``, which has the first ``cut`` characters of ``text``: that of the words before the cut, merged with that of the rest."""
    kept = max(0, len(text[:cut].split()) - 1)  # the word at the cut may change
    if kept <= shingle:
        return sketch_text(edited, k, shingle)
    rest = np.concatenate([words[kept - shingle + 1 : kept], word_hashes(edited.split()[kept:])])
    return merge(sketch_words(words[:kept], k, shingle), sketch_words(rest, k, shingle), k=k)


def text_ranges(slim: DataFrame, rows: int, chars: int, range_chars: int) -> tuple[list[int], list[int]]:
    """(bounds, parts): rising ids at which ranges begin, and into how many parts by hash each range is cut on.

    ``slim`` has place and chars. Bounds are quantiles of the ids in which a row counts once for
    every average row's characters that it has, so ranges have about equal characters. An id
    that stands for several of them is a range of its own, cut by the hash of its texts.
    """
    ranges = min(MAX_RANGES, max(1, math.ceil(chars / range_chars)))
    weighted = slim.select("place", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("chars") * rows / F.lit(max(1, chars))))))
    cuts = weighted.agg(F.percentile_approx("place", [i / ranges for i in range(ranges)], max(10_000, 4 * ranges)).alias("cuts")).first()["cuts"] or [0]
    times = Counter(cuts)
    behind = {c + 1 for c, n in times.items() if n > 1 and c < 2**63 - 1}
    bounds = sorted(times.keys() | behind)
    return bounds, [times.get(c, 1) for c in bounds]


def task_keys(docs: DataFrame, tasks: int) -> list[int]:
    """keys[i]: a number that ``repartition(tasks, key)`` deals to task i."""
    ids = docs.sparkSession.range(tasks * (8 + 2 * tasks.bit_length()))
    found = {r["t"]: r["id"] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("t")).agg(F.min("id").alias("id")).collect()}
    return [found.get(i, i) for i in range(tasks)]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Also what the sketches estimate: distinct_shingles of the document, edited_containment (how
    much of it its edited text has) and next_containment (how much of it the next one has).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"place": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    slim = persist(rows.select("place", "tie", (F.length("text") + 1).cast("long").alias("chars")))
    size = slim.agg(F.count("*").alias("rows"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    bounds, parts = text_ranges(slim, size["rows"], size["chars"], range_chars)
    first_task = [sum(parts[:i]) for i in range(len(parts))]
    at = F.greatest(range_of(F.col("place"), bounds), F.lit(1))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i)
    part = F.lit(0)
    if max(parts) > 1:  # the leading 31 bits of the hash, in order, scaled to the number of parts
        part = F.shiftright((F.shiftright("tie", 33) + 2**30) * pick(parts, at), 31).cast("int")
    task = pick(first_task, at) + part
    tasks = sum(parts)
    # the first row of each task that has rows, and the task before it
    firsts = sorted((r["task"], r["f"]["place"], r["f"]["tie"]) for r in slim.groupBy(task.alias("task")).agg(F.min(F.struct("place", "tie")).alias("f")).collect())
    known = {t: (place, tie, firsts[i - 1][0]) for i, (t, place, tie) in enumerate(firsts)}
    place_of, tie_of, before_of = ([known.get(t, (0, 0, 0))[i] for t in range(tasks)] for i in range(3))
    keys = task_keys(docs, tasks)
    dealt = rows.withColumn("range", task)
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("beyond"))
    before = F.struct(pick(before_of, F.col("range") + 1).alias("range"), F.lit(1).alias("beyond"))
    first = (pick(place_of, F.col("range") + 1) == F.col("place")) & (pick(tie_of, F.col("range") + 1) == F.col("tie"))
    spread = dealt.select("doc_id", "text", "place", "tie", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("x")).select("x.range", "x.beyond", "place", "tie", "doc_id", "text")
    tied = spread.repartition(tasks, pick(keys, F.col("range") + 1).cast("long")).sortWithinPartitions("range", "beyond", "place", "tie")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "edited_containment", "next_containment"]

    def walk(batches):
        last = None
        for batch in batches:
            out = []
            for span, beyond, doc_id, text in zip(batch["range"], batch["beyond"], batch["doc_id"], batch["text"]):
                words = word_hashes(text.split())
                sketch = sketch_words(words, k, shingle)
                if last is not None and last[0] == span and not last[1]:
                    out.append(row(*last[2:], text, sketch))
                last = span, beyond, doc_id, text, words, sketch
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    def row(doc_id, text, words, sketch, following, next_sketch):
        cut = len(text) - len(text) // 4
        edited = text[:cut] + following[: len(text) // 4]
        changed = edited_sketch(cut, edited, text, words, k, shingle)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (
            None if pd.isna(doc_id) else doc_id, len(text), digest, encode(sketch, k), encode(changed, k), resemblance(sketch, changed, k), resemblance(sketch, next_sketch, k),
            distinct_count(sketch, k), containment(sketch, changed, k), containment(sketch, next_sketch, k),
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, edited_containment double, next_containment double"
    return tied.select("range", "beyond", "doc_id", "text").mapInPandas(walk, schema)
