"""Exact top-k inner product search with block-at-a-time pruning.

Vectors become whole numbers, floor(scale * x). Rows are packed into blocks of neighbouring
ids; a block keeps its vectors (a forward index) and, for each dimension ("term"), its
largest and smallest value. For a query, the sum over the terms of the larger of
q*max and q*min bounds every score in a block. Blocks are visited in falling order of that
bound until the bound is below the k-th best score so far.

Work is dealt in cells of a query group and a block group. A first round, of each query's own
block group, gives every query a floor. Then the queries meet the term extremes of whole
block groups, which are some thousand numbers a group, and go only to groups whose bound
reaches their floor; blocks go only to query groups of which a query comes. Cells of the
second round return only rows that reach the floor.

Edge cases: vectors that are null or empty, or hold null or non-finite components, take no
part, nor do rows with a null id; a query meets vectors of its own length only. Equal scores
go to the smaller id. A repeated id is another candidate: only the query's own row is left
out; many rows of one id are dealt over several groups. Empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm.common import persist, range_of

BLOCK_ROWS = 256
#: Rows in a block group and in a query group: what one cell holds at most, 8 bytes a component.
GROUP_ROWS, QUERY_ROWS = 16_384, 8192
PACKED = "grp long, block long, dims int, ids binary, rows binary, vectors binary, tops binary, bottoms binary"
#: Groups whose extremes one cell of the second round's sifting holds.
SIFT_GROUPS = 1024
QUERY = "vec_id long, row long, dims int, home long, vector binary, side long, floor long"
FOUND = "query_row long, query_id long, cand_id long, score long"


def pack(batches, block_rows: int, group_rows: int):
    """mapInPandas: rows (grp, vec_id, row, vector) sorted by grp, dims and id into blocks."""
    held: list[pd.DataFrame] = []
    number = 0

    def block(part: pd.DataFrame) -> dict:
        m = np.ascontiguousarray(np.vstack(part["vector"].to_numpy()), dtype=np.int64)
        return {"grp": part["grp"].iloc[0], "block": number, "dims": m.shape[1], "ids": part["vec_id"].to_numpy(np.int64).tobytes(), "rows": part["row"].to_numpy(np.int64).tobytes(), "vectors": m.tobytes(), "tops": m.max(0).tobytes(), "bottoms": m.min(0).tobytes()}

    for batch in _ended(batches):
        if batch is not None and len(batch):
            held.append(batch)
        if not held:
            continue
        rows = pd.concat(held, ignore_index=True)
        dims = rows["vector"].map(len)
        run = ((rows["grp"] != rows["grp"].shift()) | (dims != dims.shift())).cumsum()
        out, rest = [], None
        for _, part in rows.groupby(run, sort=False):
            last = part.index[-1] == len(rows) - 1 and batch is not None
            whole = len(part) // block_rows * block_rows if last else len(part)
            for at in range(0, whole, block_rows):
                out.append(block(part.iloc[at : min(at + block_rows, whole)]))
                number += 1
            rest = part.iloc[whole:] if last else None
        held = [rest] if rest is not None and len(rest) else []
        if out:
            yield pd.DataFrame(out)


def _ended(batches):
    yield from batches
    yield None


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; through floats only where they are exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search_cell(queries: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of one block group for every query of one query group."""
    from_bytes = lambda x, d: np.frombuffer(x, np.int64).reshape(-1, d)
    out = []
    for dims, part in blocks.groupby("dims"):
        asked = queries[queries["dims"] == dims]
        if asked.empty:
            continue
        q = np.vstack([np.frombuffer(x, np.int64) for x in asked["vector"]])
        own, floor = asked["row"].to_numpy(np.int64), asked["floor"].to_numpy(np.int64)
        ids, rows, vectors = ([np.frombuffer(x, np.int64) for x in part["ids"]], [np.frombuffer(x, np.int64) for x in part["rows"]], [from_bytes(x, dims) for x in part["vectors"]])
        tops, bottoms = from_bytes(b"".join(part["tops"]), dims), from_bytes(b"".join(part["bottoms"]), dims)
        bounds = exact_product(np.maximum(q, 0), tops) + exact_product(np.minimum(q, 0), bottoms)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        kth, active = floor.copy(), np.arange(len(q))
        for step in range(len(vectors)):
            at = order[active, step]
            go = bounds[active, at] >= kth[active]  # a bound below the k-th score ends the query's search
            active, at = active[go], at[go]
            if not len(active):
                break
            for b in np.unique(at):
                who = active[at == b]
                scores = exact_product(q[who], vectors[b])
                for i, s in zip(who, scores):
                    keep = np.flatnonzero((s >= kth[i]) & (rows[b] != own[i]))
                    if not len(keep):
                        continue
                    s_all, id_all = np.concatenate([best[i][0], s[keep]]), np.concatenate([best[i][1], ids[b][keep]])
                    first = np.lexsort((id_all, -s_all))[:k]
                    best[i] = (s_all[first], id_all[first])
                    if len(first) == k:
                        kth[i] = max(kth[i], best[i][0][-1])
        who = np.repeat(np.arange(len(q)), [len(b[0]) for b in best])
        out.append(pd.DataFrame({"query_row": own[who], "query_id": asked["vec_id"].to_numpy(np.int64)[who], "cand_id": np.concatenate([b[1] for b in best]), "score": np.concatenate([b[0] for b in best])}))
    return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "cand_id": [], "score": []}, dtype="int64")


def group_extremes(blocks: pd.DataFrame) -> pd.DataFrame:
    """The term extremes of one group, from those of its blocks."""
    d = int(blocks["dims"].iloc[0])
    tops, bottoms = (np.frombuffer(b"".join(blocks[c]), np.int64).reshape(-1, d) for c in ("tops", "bottoms"))
    return pd.DataFrame({"grp": [blocks["grp"].iloc[0]], "dims": [d], "tops": [tops.max(0).tobytes()], "bottoms": [bottoms.min(0).tobytes()]})


def sift(queries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """The queries, once for each other group (``to``) whose bound reaches their floor."""
    out = []
    for dims, part in groups.groupby("dims"):
        asked = queries[queries["dims"] == dims]
        if asked.empty:
            continue
        q = np.vstack([np.frombuffer(x, np.int64) for x in asked["vector"]])
        tops, bottoms = (np.frombuffer(b"".join(part[c]), np.int64).reshape(-1, dims) for c in ("tops", "bottoms"))
        bounds = exact_product(np.maximum(q, 0), tops) + exact_product(np.minimum(q, 0), bottoms)
        near = (bounds >= asked["floor"].to_numpy(np.int64)[:, None]) & (asked["home"].to_numpy()[:, None] != part["grp"].to_numpy()[None])
        who, where = np.nonzero(near)
        out.append(asked.iloc[who].assign(to=part["grp"].to_numpy()[where]))
    columns = [c.split()[0] for c in QUERY.split(", ")] + ["to"]
    return pd.concat(out)[columns] if out else queries.iloc[:0].assign(to=np.zeros(0, np.int64))[columns]


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, every: int = 100, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id ``every`` divides."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    valid = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = persist(valid.select("vec_id", whole.alias("vector"), F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    ranges = max(1, math.ceil(n / group_rows))
    # Groups are ranges of ids with bounds from an approximate quantile sketch; the rows of an id that fills several are dealt by hash.
    bounds = sorted({int(b) for b in rows.approxQuantile("vec_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    ranged = rows.withColumn("range", range_of(F.col("vec_id"), bounds).cast("int"))
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    parts = [max(1, counts.get(i, 0) // (2 * group_rows) + 1) for i in range(len(bounds) + 1)]
    first = [sum(parts[:i]) for i in range(len(parts))]
    groups = sum(parts)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("range") + 1)
    dealt = ranged.withColumn("grp", (pick(first) + F.pmod(F.xxhash64("row"), pick(parts))).cast("long")).drop("range")
    blocks = persist(dealt.repartition(groups, "grp").sortWithinPartitions("grp", F.size("vector"), "vec_id", "row").mapInPandas(lambda b: pack(b, block_rows, group_rows), PACKED))
    sides = math.ceil(max(1, n / every) / query_rows)
    pack_long = F.pandas_udf(lambda s: s.map(lambda v: np.asarray(v, np.int64).tobytes()), "binary")
    queries = persist(dealt.filter(F.col("vec_id") % every == 0).select(
        "vec_id", "row", F.size("vector").alias("dims"), F.col("grp").alias("home"), pack_long("vector").alias("vector"), F.pmod(F.xxhash64("vec_id", "row"), F.lit(sides)).alias("side"), F.lit(-(2**62)).alias("floor"),
    ))
    run = lambda key, q, b: search_cell(q, b, k)

    def cells(asked: DataFrame, at: str) -> DataFrame:
        """The blocks of each group, once for every query group of which a query comes."""
        wanted = asked.select(F.col(at).alias("grp"), F.col("side").alias("at_side")).distinct()
        return blocks.join(wanted, "grp").withColumnRenamed("at_side", "side")

    found = queries.groupBy(F.col("home"), F.col("side")).cogroup(cells(queries, "home").groupBy("grp", "side")).applyInPandas(run, FOUND)
    found = persist(found)
    floors = found.groupBy("query_row").agg(F.min("score").alias("low"), F.count("*").alias("found"))
    floors = floors.select(F.col("query_row").alias("row"), F.when(F.col("found") >= k, F.col("low")).alias("low"))
    asked = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("low", "floor")).drop("low")
    extremes = persist(blocks.select("grp", "dims", "tops", "bottoms").groupBy("grp", "dims").applyInPandas(group_extremes, "grp long, dims int, tops binary, bottoms binary"))
    chunked = extremes.withColumn("chunk", F.floor(F.col("grp") / SIFT_GROUPS)).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    away = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((groups - 1) // SIFT_GROUPS))))
    away = persist(away.groupBy("chunk", "side").cogroup(chunked.groupBy("chunk", "side")).applyInPandas(lambda key, q, g: sift(q, g), QUERY + ", `to` long"))
    rest = away.groupBy("to", "side").cogroup(cells(away, "to").groupBy("grp", "side")).applyInPandas(run, FOUND)
    every_found = found.unionByName(rest) if groups > 1 else found
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "cand_id")
    ranked = every_found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("cand_id").alias("vec_id"), "score")
