"""Which texts are too like a given one: a similarity join on the Ratcliff-Obershelp ratio.

The ratio of two texts is 2 M / (sum of their lengths), M being what their matching blocks hold.
A ratio of t leaves at most u = (1 - t) (sum of lengths) characters outside the blocks. So the
lengths of a pair lie within (2 - t) / t of each other, their character counts differ by u at
most, and, as between two blocks something is left over, they share M - u - 1 pairs of
neighbouring characters. Texts meet the sources of their own and the two nearest bands of
lengths, in cells of bounded size; a cell compares character counts as arrays, then the pairs
of characters of what is left, and measures the rest exactly, until a text has its first hit.

The number of cells grows with texts times sources of like length; no cell, and so no group of
copies or common passage, gets more than CELL_ROWS rows and CELL_CHARS characters a side.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.storage import settle

#: Characters are counted by their code modulo this number.
BUCKETS = 32
#: Rows and characters of a side of a cell; a text that is longer has a cell of its own.
CELL_ROWS, CELL_CHARS = 4096, 1_000_000
FOLDED = "id long, folded string, size int, counts binary"


def folded(batches):
    """mapInPandas: texts without outer blanks and case, with their character counts."""
    for rows in batches:
        texts = [(t or "").strip().casefold() for t in rows["text"]]
        # counts stop at 255, which makes no two differ by more
        counts = [np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS).clip(max=255).astype(np.uint8).tobytes() for t in texts]
        yield pd.DataFrame({"id": rows["id"], "folded": texts, "size": [len(t) for t in texts], "counts": counts})


def ratio(a: str, b: str, threshold: float) -> bool:
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


def pairs_of(text: str) -> Counter:
    return Counter(map("".join, zip(text, text[1:])))


def first_hits(texts: pd.DataFrame, sources: pd.DataFrame, threshold: float) -> list[int]:
    """Ids of the texts of a cell that have a source in it whose ratio reaches the threshold."""
    sources = sources.sort_values("size", kind="stable")
    size, known = sources["size"].to_numpy(np.int64), sources["folded"].tolist()
    counts = np.frombuffer(b"".join(sources["counts"]), np.uint8).reshape(-1, BUCKETS).T
    sums, columns, shared = counts.sum(axis=0, dtype=np.int64), np.ascontiguousarray(counts), {}
    low, high, hits = threshold / (2 - threshold), (2 - threshold) / threshold, []
    for i, n, text, held in zip(texts["id"], texts["size"], texts["folded"], texts["counts"]):
        a, b = np.searchsorted(size, n * low - 1e-6), np.searchsorted(size, n * high + 1e-6, "right")
        own = np.frombuffer(held, np.uint8)
        apart = sums[a:b] + own.sum(dtype=np.int64) - 2 * np.minimum(columns[:, a:b], own[:, None]).sum(axis=0, dtype=np.int64)
        near = np.flatnonzero(apart <= (size[a:b] + n) * (1 - threshold) + 1e-6)
        mine = pairs_of(text) if len(near) else None
        for at in (a + near[np.argsort(apart[near], kind="stable")]).tolist():
            if at not in shared:
                shared[at] = pairs_of(known[at])
            if (mine & shared[at]).total() >= (n + size[at]) * (1.5 * threshold - 1) - 1 - 1e-6 and ratio(text, known[at], threshold):
                hits.append(i)
                break
    return hits


def like_ids(texts: DataFrame, sources: DataFrame, threshold: float) -> DataFrame:
    """(id) of folded texts that have a source whose ratio reaches the threshold, below 1; equal ones are not looked for."""
    width = math.log((2 - threshold) / threshold) + 1e-6
    band = F.floor(F.log("size") / F.lit(width)).cast("int")
    texts, sources = (x.filter("size > 0").withColumn("band", band) for x in (texts, sources))
    # a row a band, of which there are as many as the logarithm of the longest text has widths
    own, known = ({r["band"]: (r["n"], r["size"]) for r in x.groupBy("band").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect()} for x in (texts, sources))
    tiles = lambda n, longest: max(1, -(-n // max(1, min(CELL_ROWS, CELL_CHARS // longest))))
    number = lambda found: F.create_map(*(F.lit(v) for b, x in found.items() for v in (b, tiles(*x))))
    if not own or not known:
        return texts.select("id").limit(0)
    dealt = lambda x: F.pmod(F.xxhash64("folded"), x).cast("int")
    # a cell is a tile of a band of texts with a tile of a band of sources
    around = lambda c: F.explode(F.array(*(F.col(c) + i for i in (-1, 0, 1))))
    left = texts.withColumn("tile", dealt(number(own)[F.col("band")])).withColumn("other", around("band")).filter(F.col("other").isin(*known)).withColumn("theirs", F.explode(F.sequence(F.lit(0), number(known)[F.col("other")] - 1)))
    right = sources.withColumn("theirs", dealt(number(known)[F.col("band")])).withColumnRenamed("band", "other").withColumn("band", around("other"))
    right = right.filter(F.col("band").isin(*own)).withColumn("tile", F.explode(F.sequence(F.lit(0), number(own)[F.col("band")] - 1)))
    cell = ["band", "tile", "other", "theirs"]

    def hits(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": np.array(first_hits(a, b, threshold) if len(a) and len(b) else [], np.int64)})

    cells = sum(tiles(*own[b]) * tiles(*known[o]) for b in own for o in (b - 1, b, b + 1) if o in known)
    # two cells a task on the average, whatever their number; more than so many tasks only burden the driver
    tasks = max(1, min(20_000, cells // 2))
    kept = lambda x: x.select(*cell, "id", "folded", "size", "counts").repartition(tasks, *cell).groupBy(*cell)
    return kept(left).cogroup(kept(right)).applyInPandas(hits, "id long").distinct()


def too_similar(df: DataFrame, column: str, sources: DataFrame, source_column: str | None = None, threshold: float = 0.92, out_col: str = "too_similar") -> DataFrame:
    """``df`` with a flag: the text is blank, equals a source whatever the case, or has a ratio of ``threshold`` or more to one.

    A threshold of 0 or less asks for equal texts only. Null and blank sources are no sources.
    """
    numbered = settle(df.withColumn("_id", F.monotonically_increasing_id()))
    own = numbered.select(F.col("_id").alias("id"), F.col(column).cast("string").alias("text")).mapInPandas(folded, FOLDED)
    # equal texts are measured once
    distinct = settle(own.groupBy("folded").agg(F.min("id").alias("id"), F.any_value("size").alias("size"), F.any_value("counts").alias("counts")))
    known = sources.select(F.col(source_column or column).cast("string").alias("text")).distinct().withColumn("id", F.lit(0).cast("long")).mapInPandas(folded, FOLDED)
    known = settle(known.filter("size > 0").groupBy("folded").agg(F.any_value("size").alias("size"), F.any_value("counts").alias("counts")).withColumn("id", F.monotonically_increasing_id()))
    hits = distinct.filter("size = 0").select("folded").unionByName(distinct.select("folded").join(known.select("folded"), "folded", "left_semi"))
    if 0 < threshold < 1:
        fresh = settle(distinct.join(hits, "folded", "left_anti"))
        hits = hits.unionByName(fresh.join(like_ids(fresh, known, threshold), "id", "left_semi").select("folded"))
    flagged = own.select("id", "folded").join(hits.withColumn("hit", F.lit(True)), "folded", "left").select(F.col("id").alias("_id"), F.coalesce("hit", F.lit(False)).alias(out_col))
    return numbered.join(flagged, "_id").drop("_id")
