"""Phrase collocations from merged count-min sketches and an exact second pass.

A first pass hashes every phrase of one to ``longest`` words (language included) into the
cells of a count-min sketch of two rows. Tasks send what they counted as sparse tiles of
the sketch; a tile's parts are added up as they stream by, and what is left of a tile is one
bit a cell: may a phrase of this cell be frequent? The sketch overestimates, so no frequent
phrase is lost. A second pass counts, by their very words, only the phrases whose cells in
both rows have the bit. Candidates are then scored at their weakest cut and dropped where a
longer candidate explains most of them.

Sizes: a sketch row has some sixteenth of the text's bytes in cells, up to 2^28; the bits
that go to all tasks are thus 64 MB at most. Larger inputs fill the cells more, so the second
pass counts more phrases than it would need; the result stays exact. Texts are read in chunks
of about 2 MB that end at a piece's end, so a worker's memory follows the longest piece, not
the longest text.

Edge cases: null and empty texts count no word; a null language is ``und`` (as is a language
of that name); repeated rows count as often as they stand there; equal scores go to the more
frequent phrase, then to the smaller one by UTF-8 bytes. Empty input gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm.common import persist

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
CHUNK_BYTES = 2 << 20
TILE_BITS, LEAST_BITS, MOST_BITS = 16, 16, 28
ROWS = 2

KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")
_TABLES = np.random.default_rng(20).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_pieces(text: bytes, size: int):
    """The text in parts of about ``size`` bytes, each of which ends where a piece ends."""
    at = 0
    while len(text) - at > size:
        end = 1 + max(text.rfind(bytes([b]), at, at + size) for b in BREAKS)
        if end <= at:
            found = _BREAK.search(text, at + size)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def read_chunks(batches, size: int):
    """Lists of (language, bytes) with about ``size`` bytes in all."""
    held, total = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            for part in cut_pieces(text.as_py() or b"", size):
                held.append((lang, part))
                total += len(part) + 1
                if total >= size:
                    yield held
                    held, total = [], 0
    if held:
        yield held


class Words:
    """The words of a chunk: where they stand in its normal form (one blank behind each), their pieces, languages and hashes."""

    def __init__(self, parts: list, hashes: int):
        raw = np.frombuffer(b"\n".join(t for _, t in parts) + b"\n", np.uint8)
        kind = KIND[raw]
        word = kind == 0
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        sizes = ends - starts + 1
        keep = word.copy()
        keep[ends] = True
        self.text = np.where(word, LOWER[raw], np.uint8(32))[keep]
        self.at = np.cumsum(sizes) - sizes
        self.end = self.at + sizes - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        begins = np.cumsum([0] + [len(t) + 1 for _, t in parts[:-1]])
        self.langs = sorted({lang for lang, _ in parts})
        code = np.array([self.langs.index(lang) for lang, _ in parts])
        self.lang = code[np.searchsorted(begins, starts, "right") - 1]
        salts = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], np.uint64)
        self.hash = []
        place = np.arange(len(self.text), dtype=np.int32) - np.repeat(self.at.astype(np.int32), sizes)
        for table, step in zip(_TABLES[:hashes], _STEPS):
            if not len(starts):
                self.hash.append(np.zeros(0, np.uint64))
                continue
            power = np.multiply.accumulate(np.full(int(sizes.max()), step))
            weighed = table[self.text]
            weighed *= power[place]
            self.hash.append(mix(np.add.reduceat(weighed, self.at)))
        self.first = [mix(h ^ salts[self.lang]) for h in self.hash]

    def phrases(self, longest: int):
        """For each length: where its phrases begin, and their hashes."""
        grown = self.first
        for n in range(1, longest + 1):
            if n > 1:
                grown = [mix(g[:-1] * _STEPS[i] + h[n - 1 :]) for i, (g, h) in enumerate(zip(grown, self.hash))]
            whole = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])
            yield n, whole, [g[whole] for g in grown]


def cell_of(hashed: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashed >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def sketch_parts(batches, bits: int, longest: int, count_type, size: int = CHUNK_BYTES):
    """mapInArrow: for every chunk and tile the cells met, 2 bytes each, then how often, up to the type's most."""
    most = np.iinfo(count_type).max
    for parts in read_chunks(batches, size):
        met = np.concatenate([h[0] for _, _, h in Words(parts, 1).phrases(longest)])
        tiles, cells = [], []
        for row in range(ROWS):
            at, n = np.unique(cell_of(met, row, bits), return_counts=True)
            number, first = np.unique(at >> TILE_BITS, return_index=True)
            low, n = (at & ((1 << TILE_BITS) - 1)).astype(np.uint16), np.minimum(n, most).astype(count_type)
            for t, a, b in zip(number.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                tiles.append(row << 32 | t)
                cells.append(low[a:b].tobytes() + n[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(cells, pa.binary())], ["tile", "cells"])


def merge_tiles(batches, least: int, count_type):
    """mapInArrow over rows sorted by tile: its parts added up, then one bit for every cell that reaches ``least``."""
    width, now, sums = np.dtype(count_type).itemsize, None, None

    def bits() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["tile", "bits"])

    for batch in batches:
        for tile, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if tile != now:
                if now is not None:
                    yield bits()
                now, sums = tile, np.zeros(1 << TILE_BITS, np.int64)
            n = len(cells) // (2 + width)
            sums[np.frombuffer(cells, np.uint16, n)] += np.frombuffer(cells, count_type, n, 2 * n)
    if now is not None:
        yield bits()


def count_survivors(batches, sent, bits: int, longest: int, size: int = CHUNK_BYTES):
    """mapInArrow: exact counts, chunk by chunk, of the phrases whose cells may be frequent; under n = 0 those of all words."""
    kept = [np.frombuffer(b, np.uint8) for b in sent.value]
    for parts in read_chunks(batches, size):
        words = Words(parts, 2)
        text = words.text.tobytes()
        of_lang = np.bincount(words.lang, minlength=len(words.langs))
        out = [(words.langs, [0] * len(words.langs), [b""] * len(words.langs), of_lang)]
        for n, begin, (one, two) in words.phrases(longest):
            for row in range(ROWS):
                cell = cell_of(one, row, bits)
                stays = np.flatnonzero((kept[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
                begin, one, two = begin[stays], one[stays], two[stays]
            order = np.argsort(one)
            a, b = one[order], two[order]
            if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # two phrases of one hash
                order = np.lexsort((two, one))
                a, b = one[order], two[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
            at = begin[order[first]]
            slices = [text[s:e] for s, e in zip(words.at[at].tolist(), words.end[at + n - 1].tolist())]
            out.append(([words.langs[i] for i in words.lang[at].tolist()], [n] * len(at), slices, np.diff(first, append=len(a))))
        for langs, n, phrases, found in out:
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(n, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(found.astype(np.int64), pa.int64())], ["lang", "n", "phrase", "found"])


def frequent_phrases(docs: DataFrame, least: int, longest: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, n, phrase, f for all phrases of up to ``longest`` words that stand ``least`` times or more; n = 0 has a language's words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 16).bit_length()))
    count_type = np.uint8 if least <= 255 else np.uint32
    parts = rows.mapInArrow(lambda b: sketch_parts(b, bits, longest, count_type), "tile long, cells binary")
    merged = parts.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda b: merge_tiles(b, least, count_type), "tile long, bits binary")
    kept = [bytearray((1 << bits) // 8) for _ in range(ROWS)]
    step = (1 << TILE_BITS) // 8
    for tile, found in merged.collect():  # the bits of all cells, 64 MB at most
        at = (tile & 0xFFFFFFFF) * step
        kept[tile >> 32][at : at + step] = found
    sent = spark.sparkContext.broadcast([bytes(k) for k in kept])
    exact = rows.mapInArrow(lambda b: count_survivors(b, sent, bits, longest), "lang string, n int, phrase string, found long")
    return exact.groupBy("lang", "n", "phrase").agg(F.sum("found").alias("f")).filter((F.col("n") == 0) | (F.col("f") >= least))


def big(c) -> Column:
    return F.col(c).cast("decimal(25,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, text_col: str = "text", lang_col: str = "lang", salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by their weakest cut.

    A phrase goes if a longer candidate that holds it stands ``covered`` percent as often or more.
    """
    found = persist(frequent_phrases(docs, least, longest, text_col, lang_col))
    known = found.filter("n > 0").select("lang", "phrase", "f")
    candidates = found.filter("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(2000000 * cast(a AS decimal(25,0))) div (cast(l AS decimal(25,0)) + cast(r AS decimal(25,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inside = candidates.filter("n > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)))
    inside = inside.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    scored = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * big("longer") < covered * big("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
