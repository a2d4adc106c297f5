"""SimHash near-duplicate detection with pigeonring filtering.

A document's fingerprint has bit b set if over half of its shingle hashes (XXH64, seed 42)
have it. Equal fingerprints are collapsed first. Two fingerprints within ``bits`` differing
bits, cut into ``bits + 1`` segments laid on a ring, have a segment i from which every chain
of l segments differs in at most l * bits / (bits + 1) bits (pigeonring principle). So pairs
are sought among fingerprints that agree in one segment, longer chains prune them, and only
the survivors get the full Hamming check. Segments that very many fingerprints share are
refined by the next link of the chain (its neighbour segment with one bit masked), and what
is still large is cut into square tiles; no task holds more than two tiles.

Within a tile, links become stars around the smallest member, so the rows that leave it are
fewer than its fingerprints. Stars meet in the large-star/small-star algorithm for connected
components, over joins and group-bys with a checkpoint for every round.

Edge cases: null and empty texts have no words, fingerprint zero, and are linked like any
other; a null id never names a component unless all of its ids are null; equal rows are all
returned; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import persist, unused
from weftline.llm.fingerprint import shingle_hashes, word_hashes

SEED = 42
BUFFER_ROWS, MAX_EDGES = 30_000, 200_000
#: Rows of three numbers of which a table may have so many to be broadcast.
BROADCAST_ROWS = 500_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
        begins = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp (the fingerprint as a signed long)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("tie"), fp(text_col).alias("fp"))


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of the bits + 1 segments."""
    m = bits + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def segment(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def chain_masks(bits: int) -> np.ndarray:
    """masks[i, l]: the bits of segments i .. i + l on the ring."""
    cuts = [((1 << w) - 1) << s for s, w in segments(bits)]
    m = len(cuts)
    return np.array([[sum(cuts[(i + j) % m] for j in range(length + 1)) for length in range(m)] for i in range(m)], dtype=np.uint64)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows, the smallest row that links lead to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def tile_links(keys: np.ndarray, ring: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, centre) among rows of equal key; rows are sorted by key."""
    masks, m, n = chain_masks(bits), bits + 1, len(fps)
    a_all, b_all, held = [], [], 0
    left = np.arange(n - 1)
    for d in range(1, n):
        left = left[left + d < n]
        left = left[keys[left] == keys[left + d]]
        if not len(left):
            break
        at = left
        x = fps[at] ^ fps[at + d]
        for length in range(1, m):  # chains of two segments and more; the last is the full Hamming check
            fits = np.bitwise_count(x & masks[ring[at], length]) <= (length + 1) * bits // m
            at, x = at[fits], x[fits]
        if len(at):
            a_all.append(at)
            b_all.append(at + d)
            held += len(at)
        if held > MAX_EDGES:
            label = stars(n, np.concatenate(a_all), np.concatenate(b_all))
            member = np.flatnonzero(label != np.arange(n))
            a_all, b_all, held = [member], [label[member]], 0
    if not a_all:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = stars(n, np.concatenate(a_all), np.concatenate(b_all))
    member = np.flatnonzero(label != np.arange(n))
    return fps[member].view(np.int64), fps[label[member]].view(np.int64)


def whole_keys(batches, keys: list[str], links):
    """mapInPandas over rows sorted by ``keys``: ``links`` of runs of rows in which a key's rows stay together."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < BUFFER_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = np.logical_and.reduce([(rows[k] == rows[k].iloc[-1]).to_numpy() for k in keys])
        cut = len(rows) - int(last.sum())  # the last key may go on
        if cut:
            yield links(rows.iloc[:cut])
        held, size = [rows.iloc[cut:]], len(rows) - cut
    if size:
        yield links(pd.concat(held, ignore_index=True))


def near_links(fps: DataFrame, bits: int = 4, tile: int = 2048) -> DataFrame:
    """(u, v): links that connect every pair of distinct ``fp`` within ``bits`` bits, as stars."""
    cuts = segments(bits)
    options = F.array(*(F.struct(F.lit(i).alias("ring"), segment(F.col("fp"), s, w).alias("value")) for i, (s, w) in enumerate(cuts)))
    keyed = fps.select("fp", F.explode(options).alias("x")).select("fp", "x.ring", "x.value")
    counts = keyed.groupBy("ring", "value").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    marked = keyed.join(counts, ["ring", "value"], "left")
    plain = marked.filter("n is null").select("ring", F.concat_ws(":", "ring", "value").alias("key"), "fp")

    # large segments: the next segment on the ring may differ in one bit, so two rows share it with some bit masked
    def masked(i: int) -> Column:
        s, w = cuts[(i + 1) % len(cuts)]
        nearby = segment(F.col("fp"), s, w)
        return F.array(*(F.concat_ws("/", F.lit(b), nearby.bitwiseAND(F.lit(((1 << w) - 1) & ~(1 << b)))) for b in range(w)))

    near = F.array()
    for i in range(len(cuts)):
        near = F.when(F.col("ring") == i, masked(i)).otherwise(near)
    large = marked.filter("n is not null").select("ring", "fp", F.explode(near).alias("near"), "value").select("ring", F.concat_ws(":", "ring", "value", "near").alias("key"), "fp")
    sizes = large.groupBy("key").agg(F.count("*").alias("n"))
    tiles = F.ceil(F.col("n") / tile).cast("int")
    spread = large.join(sizes, "key").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.concat_ws("-", F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    tiled = spread.select("ring", F.explode(pair).alias("pair"), "key", "fp").select("ring", F.concat_ws(":", "key", "pair").alias("key"), "fp")

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = tile_links(pd.factorize(rows["key"])[0], rows["ring"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64), bits)
        return pd.DataFrame({"u": u, "v": v})

    found = plain.unionByName(tiled).repartition("key").sortWithinPartitions("key").mapInPandas(lambda b: whole_keys(b, ["key"], linked), "u long, v long")
    return found.distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root): the smallest node reachable from each node that has links."""

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        return both.join(low, "u").filter("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        near = down.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return near.unionByName(low.select("u", F.col("low").alias("v"))).distinct()

    state, before = persist(links.select("u", "v").filter("u <> v")), None
    for _ in range(max_rounds):
        seen = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] == 0 or seen == before:
            return state.select("u", F.col("v").alias("root"))
        before, state = seen, persist(small_star(large_star(state)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def looked_up(rows: DataFrame, found: DataFrame, key: str, value: str, hub: int = 1000) -> DataFrame:
    """``rows`` with ``value`` of ``found`` (key, n, value), which has one row per key and its number of rows.

    Keys of over ``hub`` rows, of which there is one for every ``hub`` rows at most, meet theirs
    under ``spread`` keys each, so no task gets all rows of a large group.
    """
    spread = 64
    salts = F.sequence(F.lit(0), F.lit(spread - 1))
    salted = found.filter(F.col("n") > hub).select(F.col(key).alias("_k"), F.explode(salts).alias("_s"), F.col(value).alias("_large"), F.lit(True).alias("_hit"))
    own = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int"))
    with_large = own.join(salted, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left").drop("_k", "_s", "_salt")
    large = with_large.filter("_hit").drop("_hit").withColumnRenamed("_large", value)
    small = with_large.filter("_hit is null").drop("_large", "_hit").join(found.filter(F.col("n") <= hub).select(key, value), key)
    return large.unionByName(small)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    marks = persist(with_fingerprint(docs, id_col, text_col, shingle).drop("tie"))
    by_fp = marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    roots = components(near_links(by_fp.select("fp"), bits)).withColumnRenamed("u", "fp")
    by_fp = persist(by_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    firsts = persist(by_fp.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = looked_up(by_fp.select("fp", "rows", "root"), firsts, "root", "component_id").select("fp", F.col("rows").alias("n"), "component_id")
    out = looked_up(marks, named, "fp", "component_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WIDE_WORDS = 16
WIDE_BITS = 64 * WIDE_WORDS


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x


#: Sets of up to so many shingles are compared as they are; so few votes make no estimate.
FEW = 20


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes, rising."""
    return np.unique(shingle_hashes(word_hashes((text or "").lower().split()), shingle))


def wide_votes(h: np.ndarray) -> np.ndarray:
    """Signed counts of distinct shingles in WIDE_BITS places; their transform has each bit's vote balance.

    A shingle's bit codes are plus or minus one Hadamard row, so one addition casts all of
    its votes at once.
    """
    place = (h & np.uint64(WIDE_BITS - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float32)
    return np.bincount(place, sign, WIDE_BITS).astype(np.float32)


def wide_fingerprints(sets: list[np.ndarray]) -> list[bytes]:
    out: list[bytes] = []
    order = np.random.default_rng(SEED + 1).permutation(WIDE_BITS)  # neighbours in a segment are no neighbours of the transform
    spin = 1.0 - 2.0 * np.random.default_rng(SEED).integers(0, 2, WIDE_BITS).astype(np.float32)
    for at in range(0, len(sets), 64):
        votes = np.stack([wide_votes(h) for h in sets[at : at + 64]])
        bits = hadamard(votes * spin) + 0.5 * spin > 0  # the half breaks even votes
        out += [row.tobytes() for row in np.packbits(bits[:, order], axis=1)]
    return out


def near_marks(texts, shingle: int, similarity: float) -> pd.DataFrame:
    """node, a hash of the shingle set; few, the set itself if a set of FEW may be near; wide, the fingerprint if it has over FEW."""
    most, nodes, few, wide = math.floor(FEW / similarity + 1e-9), [], [], []
    for at in range(0, len(texts), 64):
        sets = [shingle_set(t, shingle) for t in texts[at : at + 64]]
        prints = iter(wide_fingerprints([h for h in sets if len(h) > FEW]))
        nodes += [xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets]
        few += [h.tobytes() if len(h) <= most else None for h in sets]
        wide += [next(prints) if len(h) > FEW else None for h in sets]
    return pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "few": pd.Series(few, dtype=object), "wide": pd.Series(wide, dtype=object)})


def bits_for(similarity: float, bits: int = WIDE_BITS, slack: float = 0.0) -> int:
    """Differing bits to expect at a Jaccard likeness, plus ``slack`` standard deviations of sampling noise."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


#: Bits by which a chain may pass its share of the limit, as it starts where a bucket lies; the share of pairs at the likeness that a bucket's chain keeps then, at least.
CHAIN_SLACK, CHAIN_KEPT = 8, 0.985


def chain_limits(most: int) -> np.ndarray:
    """The bits in which a chain of 1, 2, ... words on the ring may differ; the last is the full Hamming check."""
    return np.minimum(most, most * np.arange(1, WIDE_WORDS + 1) // WIDE_WORDS + CHAIN_SLACK)


def ring_word(segment: Column, width: int) -> Column:
    """The word of a fingerprint in which a segment begins, or any for one that is dealt over all words."""
    return F.floor(F.pmod(segment, F.lit(WIDE_BITS // width)) * width / 64).cast("int")


def wide_segments(rows: int, similarity: float, recall: float = 0.98) -> np.ndarray:
    """The bits of each segment: wide enough for buckets of about a thousand rows, and as many as the recall asks for.

    A row is written once for each segment and compared with its bucket in each, so wider
    segments cost disk and narrower ones cost comparisons.

    The first segments lie side by side on the ring of the fingerprint's words; then seeded
    shuffles of all bits are cut up one after another, so there is no most to their number.
    The recall counts in what the chains leave out that start at a segment.
    """
    width = min(20, max(12, math.ceil(math.log2(max(rows, 2))) - 10))
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    count = math.ceil(math.log(1 - recall) / math.log(1 - CHAIN_KEPT * (1 - p) ** width))
    rng, each = np.random.default_rng(SEED), WIDE_BITS // width
    shuffles = [(rng.permutation(WIDE_BITS) if k else np.arange(WIDE_BITS))[: each * width].reshape(each, width) for k in range(math.ceil(count / each))]
    cuts = np.concatenate(shuffles)[:count]
    assert len(cuts) == count
    return cuts


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a spanning forest of least distances d (Boruvka's rounds).

    Whatever distance turns out to be too far, what the edges up to it connect, the forest's do.
    """
    order = np.lexsort((b, a, d))
    a, b = a[order], b[order]
    label, rank, taken = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = label[a], label[b]
        live = x != y
        a, b, rank, x, y = a[live], b[live], rank[live], x[live], y[live]
        if not len(a):
            break
        nearest = np.full(n, len(order))
        np.minimum.at(nearest, x, rank)
        np.minimum.at(nearest, y, rank)
        chosen = np.unique(nearest[nearest < len(order)])
        taken.append(chosen)
        at = np.searchsorted(rank, chosen)
        label = stars(n, x[at], y[at])[label]
    return order[np.sort(np.concatenate(taken))] if taken else np.empty(0, np.int64)


def wide_tile_links(keys: np.ndarray, nodes: np.ndarray, words: np.ndarray, most: int, ring: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (u, v, differing bits) among rows of equal key within ``most`` bits, as forests of nearest pairs.

    Pairs within ``most`` bits have a word on the ring from which every chain of l words differs
    in l / WIDE_WORDS of that at most (pigeonring principle). Rows of a key agree in a segment;
    chains that start at its word, ``ring``, prune their pairs, and the survivors' last chain is
    the full Hamming check.
    """
    n, a, b, d_all = len(nodes), [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left, held = np.arange(n - 1), 0
    limits, start = chain_limits(most), np.zeros(n, np.int64) if ring is None else ring

    def reduced():
        x, y, d = np.concatenate(a), np.concatenate(b), np.concatenate(d_all)
        at = forest(n, x, y, d)
        return [x[at]], [y[at]], [d[at]]

    for step in range(1, n):
        left = left[left + step < n]
        left = left[keys[left] == keys[left + step]]
        if not len(left):
            break
        at, spent = left, np.zeros(len(left), np.int64)
        for i, limit in enumerate(limits):
            word = (start[at] + i) % WIDE_WORDS
            spent = spent + np.bitwise_count(words[at, word] ^ words[at + step, word])
            at, spent = at[spent <= limit], spent[spent <= limit]
        if len(at):
            a.append(at)
            b.append(at + step)
            d_all.append(spent)
            held += len(at)
        if held > MAX_EDGES:
            a, b, d_all = reduced()
            held = len(a[0])
    (x,), (y,), (d,) = reduced()
    return nodes[x], nodes[y], d


def few_tile_links(keys: np.ndarray, nodes: np.ndarray, sets: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star links among rows of equal key whose shingle sets have ``similarity`` or more, exactly."""
    n, a_all, b_all = len(nodes), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    sizes = np.array([len(s) // 8 for s in sets], np.int64)
    width = int(sizes.max(initial=1))
    held = np.arange(width) < sizes[:, None]
    values = np.zeros((n, width), np.uint64)
    values[held] = np.frombuffer(b"".join(sets), np.uint64)
    left = np.arange(n - 1)
    for d in range(1, n):
        left = left[left + d < n]
        left = left[keys[left] == keys[left + d]]
        if not len(left):
            break
        near = left[np.minimum(sizes[left], sizes[left + d]) >= similarity * np.maximum(sizes[left], sizes[left + d]) - 1e-9]
        for at in np.array_split(near, len(near) // 20_000 + 1):
            shared = np.zeros(len(at), np.int64)
            for i in range(width):
                shared += ((values[at, i, None] == values[at + d]) & held[at + d]).any(axis=1) & held[at, i]
            at = at[shared >= similarity * (sizes[at] + sizes[at + d] - shared) - 1e-9]
            a_all.append(at)
            b_all.append(at + d)
        if sum(map(len, a_all)) > MAX_EDGES:
            label = stars(n, np.concatenate(a_all), np.concatenate(b_all))
            member = np.flatnonzero(label != np.arange(n))
            a_all, b_all = [member], [label[member]]
    label = stars(n, np.concatenate(a_all), np.concatenate(b_all))
    member = np.flatnonzero(label != np.arange(n))
    return nodes[member], nodes[label[member]]


def few_keys(held: bytes, similarity: float) -> np.ndarray:
    """Those of a set's smallest shingles of which two sets of ``similarity`` share one at least."""
    n = len(held) // 8
    return np.frombuffer(held, np.uint64)[: n - math.ceil(similarity * n - 1e-9) + 1].astype(np.int64)


def wide_links(nodes: DataFrame, similarity: float, rows: int, tile: int = 6144, slack: float = 2.5) -> DataFrame:
    """(u, v, bits) over rows (node, few, wide): links that connect nodes of likeness ``similarity`` or more.

    Small sets meet by their smallest shingles and are compared exactly (bits 0). The others
    meet by segments of their fingerprints, whose chains on the ring prune them, and are linked
    if these differ in no more bits than ``slack`` standard deviations above what
    ``similarity`` lets expect. Rows of one key
    are dealt into pairs of tiles, so no task holds more than two tiles of a key at once.
    """
    cuts, most = wide_segments(rows, similarity), bits_for(similarity, slack=slack)

    def keys_of(batch: pd.DataFrame):
        """(keys, places in the batch, what is compared); an even key is a shingle's, an odd one a segment's."""
        small = np.flatnonzero(batch["few"].notna())
        if len(small):
            keys = [few_keys(s, similarity) for s in batch["few"].iloc[small]]
            at = np.repeat(small, [len(k) for k in keys])
            yield np.concatenate(keys) << 1, at, batch["few"].to_numpy()[at]
        large = np.flatnonzero(batch["wide"].notna())
        for key in segment_keys(batch["wide"].iloc[large]) if len(large) else ():
            yield key << 1 | 1, large, batch["wide"].to_numpy()[large]

    def segment_keys(wide: pd.Series):
        bits = np.unpackbits(np.frombuffer(b"".join(wide), np.uint8).reshape(-1, WIDE_BITS // 8), axis=1)
        for i, cut in enumerate(cuts):
            key = np.full(len(bits), i << 24, np.int64)
            for at, bit in enumerate(cut):
                key |= bits[:, bit].astype(np.int64) << at
            yield key

    def index(batches):
        for batch in batches:
            for key, at, held in keys_of(batch):
                yield pd.DataFrame({"key": key, "node": batch["node"].to_numpy()[at], "held": held})

    def keys_only(batches):
        for batch in batches:
            for key, _, _ in keys_of(batch):
                yield pd.DataFrame({"key": key})

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        of_segment = rows["key"].to_numpy(np.int64) & 1 == 1
        few, wide = rows[~of_segment], rows[of_segment]
        u, v = few_tile_links(pd.factorize(few["key"])[0], few["node"].to_numpy(np.int64), few["held"].tolist(), similarity)
        words = np.frombuffer(b"".join(wide["held"]), "<u8").reshape(-1, WIDE_WORDS)
        x, y, d = wide_tile_links(pd.factorize(wide["key"])[0], wide["node"].to_numpy(np.int64), words, most, wide["ring"].to_numpy(np.int64))
        low, high = np.concatenate([u, np.minimum(x, y)]), np.concatenate([v, np.maximum(x, y)])
        return pd.DataFrame({"u": low, "v": high, "bits": np.concatenate([np.zeros(len(u), np.int64), d])})

    # keys of large groups are hashed anew with each pair of tiles; two keys that collide only share a comparison
    large = persist(nodes.select("few", "wide").mapInPandas(keys_only, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile))
    if large.count() <= BROADCAST_ROWS:  # one for every ``tile`` index rows at most; beyond that the index is shuffled for it
        large = F.broadcast(large)
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    kind = F.col("key").bitwiseAND(F.lit(1))
    spread = F.transform(F.sequence(F.lit(0), tiles - 1), lambda o: F.xxhash64("key", F.least(o, own), F.greatest(o, own)).bitwiseAND(F.lit(~1)) + kind)
    pair = F.when(F.col("n").isNull(), F.array("key")).otherwise(spread)
    tiled = nodes.select("node", "few", "wide").mapInPandas(index, "key long, node long, held binary").join(large, "key", "left").select(ring_word(F.shiftright("key", 25), cuts.shape[1]).alias("ring"), F.explode(pair).alias("key"), "node", "held")
    # in the order of nodes, so that like groups of different keys give like links
    found = tiled.repartition("key").sortWithinPartitions("key", "node").mapInPandas(lambda b: whole_keys(b, ["key"], linked), "u long, v long, bits long")
    return found.groupBy("u", "v").agg(F.min("bits").alias("bits"))


def true_links(links: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, sure: float) -> DataFrame:
    """(u, v): the links that hold. Those whose fingerprints leave a doubt are settled by the texts' shingle sets.

    A link is beyond doubt if it was compared exactly, or has so few differing bits that a pair
    of likeness ``similarity - 0.05`` has as few only ``sure`` standard deviations off.
    """
    links = persist(links)
    clear = bits_for(similarity - 0.05, slack=-sure)
    doubt = links.filter(F.col("bits") > clear).select("u", "v")
    ends = doubt.select(F.explode(F.array("u", "v")).alias("node"), "u", "v")
    wanted = persist(ends.join(nodes.select("node", F.col("first.doc_id").alias("want_id"), F.col("first.tie").alias("want_tie")), "node"))
    if wanted.count() <= BROADCAST_ROWS:  # beyond that the texts are shuffled
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.coalesce(F.xxhash64("text"), F.lit(0)))
    met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("tie") == F.col("want_tie")))
    text_of = lambda end: F.first(F.when(F.col("node") == F.col(end), F.col("text")), ignorenulls=True)
    pairs = met.groupBy("u", "v").agg(text_of("u").alias("a"), text_of("v").alias("b"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = shingle_set(x, shingle), shingle_set(y, shingle)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    return links.filter(F.col("bits") <= clear).select("u", "v").unionByName(pairs.filter(near("a", "b")).select("u", "v"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that of the smallest id.

    Near is a likeness of ``similarity`` or more between the sets of lower-cased shingles.
    Sets of FEW shingles or less are compared exactly. Others are candidates by SimHash
    fingerprints of 1,024 bits (a likeness of 0.8 leaves no segment of a 64-bit fingerprint
    untouched, hence the width), whose nearest pairs are settled by the shingle sets
    themselves wherever the fingerprints leave a doubt. Texts are equal only if their shingle
    sets are. Null and empty texts are one group; a row with an id is kept before one without,
    and of equal rows one stays; an empty table gives an empty result.
    """

    @F.pandas_udf("node long, few binary, wide binary")
    def mark(texts: pd.Series) -> pd.DataFrame:
        return near_marks(texts.tolist(), shingle, similarity)

    marks = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("tie"), mark(text_col).alias("m"))
    marks = persist(marks.select("doc_id", "tie", "m.node", "m.few", "m.wide"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    nodes = persist(marks.groupBy("node", "few", "wide").agg(first))
    links = wide_links(nodes.select("node", "few", "wide"), similarity, nodes.filter("wide is not null").count())
    roots = components(true_links(links, nodes, docs, id_col, text_col, shingle, similarity, sure=4.0))
    by_node = nodes.drop("few", "wide").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = by_node.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.tie")
    copies = marks.groupBy("doc_id", "tie").agg(F.count("*").alias("rows"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))
    keep = keep.alias("k").join(copies.alias("c"), same("k", "c")).select("k.doc_id", "k.tie", "c.rows")
    tie, times = unused(docs, "_tie"), unused(docs, "_rows")
    rows = docs.withColumn(tie, F.coalesce(F.xxhash64(text_col), F.lit(0))).alias("d")
    kept = rows.join(keep.alias("k"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{tie}") == F.col("k.tie")))
    kept = kept.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("k.rows").alias(times))
    once = kept.filter(F.col(times) == 1).drop(times)
    return once.unionByName(kept.filter(F.col(times) > 1).drop(times).dropDuplicates([id_col, text_col]))
