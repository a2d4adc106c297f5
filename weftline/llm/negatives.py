"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Vectors become whole numbers, floor(scale * x). A further component that brings every row to
the norm of the longest one turns the largest inner product into the smallest distance, so
the triangle inequality holds. A bounded sample of rows are the pivots; each row belongs to
the cell of its nearest pivot and lies in blocks of rows of like distance from it. Anchors
form groups of neighbouring cells. What an anchor group asks for first meets its own cells;
the k-th score found there bounds how far a better row can be. For every cell the group then
has a ring of distances from the pivot outside which no row can serve any of its anchors, and
only blocks that meet the ring are sent to the group and joined with it, exactly.

The join runs twice: for the positives, among rows of the anchor's label, and for the
negatives, among the others, whose scores must lie in a band below each positive's.

Edge cases: rows whose id, label or vector is null, whose vector is empty or holds a null or
non-finite component take no part; vectors meet those of their own length only. Equal scores
go to the smaller id. A row of a repeated id is a row of its own: as an anchor it is answered
by itself, and only the row itself is left out of its answers. Equal vectors may fill a cell;
its rows are then dealt over several tasks. A label that is no whole number is known by its
64-bit hash. An anchor without positives, or whose positives score below 0, has no negatives.
Empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm.common import persist
from weftline.llm.topk import exact_product

#: Pivots: one for so many rows, within limits; they go to every task.
ROWS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 256, 8, 512
BLOCK_ROWS, UNIT_BLOCKS, GROUP_ROWS, TASK_ROWS = 1024, 16, 1024, 4096
#: Anchors whose scores with a unit are held at once.
AT_ONCE = 64
#: Share of the longest norm by which rounding may shift a distance.
SLACK = 1e-6
NONE, ALL = -(2**62), 2**62
BLOCK = "kin long, dims int, cell int, unit long, lo double, hi double, ids binary, rows binary, labels binary, vectors binary"
ASK = "row long, task long, anchor_id long, label long, dims int, cell int, vector binary, low long, high long"
FOUND = "row long, task long, cand_row long, cand_id long, score long"
GROUP = ["kin", "dims", "region", "part"]


class Space:
    """The pivots of each number of dimensions, and what distances need."""

    def __init__(self, vectors: list[np.ndarray], longest: float):
        self.longest, self.slack = longest, math.sqrt(longest) * SLACK
        self.pivots = {}
        for d in sorted({len(v) for v in vectors}):
            m = np.array([v for v in vectors if len(v) == d], np.float64)
            centred = m - m.mean(0)
            m = m[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]  # neighbours get near numbers
            self.pivots[d] = np.hstack([m, self.lift(m)])

    def lift(self, m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (m * m).sum(1, keepdims=True), 0))

    def away(self, m: np.ndarray, lifted: bool) -> np.ndarray | None:
        """Distances of rows (lifted) or anchors (not) from the pivots."""
        p = self.pivots.get(m.shape[1])
        if p is None:
            return None
        m = m.astype(np.float64)
        x = np.hstack([m, self.lift(m) if lifted else np.zeros((len(m), 1))])
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))

    def nearest(self, m: np.ndarray, lifted: bool) -> tuple[np.ndarray, np.ndarray]:
        d = self.away(m, lifted)
        if d is None:
            return np.full(len(m), -1), np.zeros(len(m))
        at = d.argmin(1)
        return at, d[np.arange(len(m)), at]


def located(batches, space: Space, lifted: bool):
    """mapInPandas: rows with cell, distance from its pivot and packed vector."""
    for batch in batches:
        size = batch["vector"].map(len)
        for d, part in batch.groupby(size):
            m = np.vstack(part["vector"].to_numpy()).astype(np.int64)
            cell, away = space.nearest(m, lifted)
            yield part.assign(dims=int(d), cell=cell, away=away, vector=[v.tobytes() for v in m])


def pack_blocks(batches, block_rows: int):
    """mapInPandas: rows sorted by key and distance into blocks; ``unit`` numbers what is joined at once."""
    base, number, held = TaskContext.get().partitionId() << 32, 0, None
    keys = ["kin", "dims", "cell"]

    def blocks(rows: pd.DataFrame, last: bool):
        nonlocal number
        out, rest = [], rows.iloc[:0]
        fresh = (rows[keys] != rows[keys].shift()).any(axis=1).cumsum()
        ends = fresh.iloc[-1] if len(rows) else 0
        for run, part in rows.groupby(fresh, sort=False):
            whole = len(part) if last or run != ends else len(part) // block_rows * block_rows
            rest = part.iloc[whole:]
            for at in range(0, whole, block_rows):
                b = part.iloc[at : min(at + block_rows, whole)]
                first = b.iloc[0]
                ids, numbers, labels = (b[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row", "label"))
                out.append((first["kin"], first["dims"], first["cell"], base | number // UNIT_BLOCKS, b["away"].min(), b["away"].max(), ids, numbers, labels, b"".join(b["vector"])))
                number += 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")]), rest

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        out, held = blocks(rows.reset_index(drop=True), False)
        if len(out):
            yield out
    if held is not None and len(held):
        yield blocks(held.reset_index(drop=True), True)[0]


def join_unit(asks: pd.DataFrame, blocks: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """The best k rows of some blocks for everything an anchor group asks."""
    names, out = [c.split()[0] for c in FOUND.split(", ")], []
    if asks.empty or blocks.empty:
        return pd.DataFrame(columns=names, dtype="int64")
    dims = int(blocks["dims"].iloc[0])
    ids, rows, labels = (np.frombuffer(b"".join(blocks[c]), np.int64) for c in ("ids", "rows", "labels"))
    vectors = np.frombuffer(b"".join(blocks["vectors"]), np.int64).reshape(-1, dims)
    anchors = list(asks.groupby("row", sort=False))
    for at in range(0, len(anchors), AT_ONCE):
        some = anchors[at : at + AT_ONCE]
        products = exact_product(np.vstack([np.frombuffer(own["vector"].iloc[0], np.int64) for _, own in some]), vectors)
        for (row, own), scores in zip(some, products):
            fits = (rows != row) & ((labels == own["label"].iloc[0]) == same)
            for task, low, high in zip(own["task"], own["low"], own["high"]):
                keep = np.flatnonzero(fits & (scores >= low) & (scores <= high))
                if len(keep) > 4 * k:
                    keep = keep[scores[keep] >= np.partition(scores[keep], -k)[-k]]
                keep = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
                out.append(pd.DataFrame({"row": row, "task": task, "cand_row": rows[keep], "cand_id": ids[keep], "score": scores[keep]}))
    return pd.concat(out)[names]


def rings(asks: pd.DataFrame, space: Space) -> pd.DataFrame:
    """For each cell that may serve an anchor group, the distances from its pivot that can."""
    first, d = asks.iloc[0], int(asks["dims"].iloc[0])
    m = np.vstack([np.frombuffer(v, np.int64) for v in asks["vector"]]).astype(np.float64)
    key = {c: first[c] for c in GROUP}
    away = space.away(m, False)
    if away is None:
        return pd.DataFrame([key | {"to": -1, "least": 0.0, "most": float("inf")}])
    norm = (m * m).sum(1) + space.longest
    reach = np.sqrt(np.maximum(norm - 2 * asks["low"].to_numpy(np.float64), 0)) + space.slack
    inner = np.sqrt(np.maximum(norm - 2 * asks["high"].to_numpy(np.float64), 0)) - space.slack
    pivots, home = space.pivots[d], away.argmin(1)
    apart = np.sqrt(np.maximum(((pivots[home][:, None] - pivots[None]) ** 2).sum(2), 1e-300))
    beyond = (away**2 - away[np.arange(len(home)), home][:, None] ** 2) / (2 * apart) - space.slack  # what is nearer to the other pivot is at least so far off
    use = beyond <= reach[:, None]
    low = np.where(use, np.maximum(away - reach[:, None], inner[:, None] - away), np.inf).min(0)
    high = np.where(use, away + reach[:, None], -np.inf).max(0)
    at = np.flatnonzero(use.any(0))
    return pd.DataFrame(key | {"to": at, "least": low[at], "most": high[at]})


class Index:
    """Blocks of located rows; ``by_label`` keeps labels apart."""

    def __init__(self, rows: DataFrame, space: Space, by_label: bool, block_rows: int):
        self.space, self.by_label = space, by_label
        keyed = rows.withColumn("kin", self.kin(F.col("label")))
        crowd = keyed.groupBy("kin", "dims", "cell").count().filter(F.col("count") > TASK_ROWS).withColumn("parts", F.ceil(F.col("count") / TASK_ROWS)).drop("count")
        dealt = keyed.join(crowd, ["kin", "dims", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1).cast("long"))))
        sort = ["kin", "dims", "cell", "salt"]
        dealt = dealt.repartition(*sort).sortWithinPartitions(*sort, "away").select("kin", "dims", "cell", "away", "vec_id", "row", "label", "vector")
        self.blocks = persist(dealt.mapInPandas(lambda b: pack_blocks(b, block_rows), BLOCK))

    def kin(self, label: Column) -> Column:
        return label if self.by_label else F.lit(0).cast("long")

    def grouped(self, asks: DataFrame, group_rows: int) -> DataFrame:
        """Asks with their group: neighbouring cells of one kin, and parts of them where they are many."""
        keyed = asks.withColumn("kin", self.kin(F.col("label")))
        total = keyed.groupBy("kin", "dims").agg(F.ceil(F.count("*") / group_rows).alias("regions"))
        most = max([1, *map(len, self.space.pivots.values())])
        keyed = keyed.join(total, ["kin", "dims"]).withColumn("region", F.floor(F.greatest("cell", F.lit(0)) * F.least("regions", F.lit(most)) / most)).drop("regions")
        parts = keyed.groupBy("kin", "dims", "region").agg(F.ceil(F.count("*") / (4 * group_rows)).alias("parts"))
        return keyed.join(parts, ["kin", "dims", "region"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")

    def meet(self, asks: DataFrame, served: DataFrame, k: int) -> DataFrame:
        """Exact join of the groups with the blocks they are served."""
        same = self.by_label
        served = served.select(*(F.col(c).alias(c) for c in served.columns))  # columns of its own, as both sides stem from the same tables
        asked = asks.join(served.select(*GROUP, "unit").distinct(), GROUP)
        key = [*GROUP, "unit"]
        asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))
        return asked.groupBy(*key).cogroup(served.groupBy(*key)).applyInPandas(lambda a, b: join_unit(a, b, same, k), FOUND)

    def search(self, asks: DataFrame, k: int, group_rows: int) -> DataFrame:
        """row, task, cand_row, cand_id, score, rank: the best k of what each ask allows (label, ``low`` <= score <= ``high``)."""
        space, b = self.space, self.blocks
        asks = persist(self.grouped(asks, group_rows))
        home = asks.select(*GROUP, "cell").distinct()
        near = persist(self.meet(asks, home.join(b, ["kin", "dims", "cell"]), k))
        best = Window.partitionBy("row", "task").orderBy(F.desc("score"), "cand_id", "cand_row")
        near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        floors = near.filter(F.col("rank") == k).select("row", "task", F.col("score").alias("floor"))
        asks = asks.join(floors, ["row", "task"], "left").withColumn("low", F.greatest("low", F.coalesce("floor", "low"))).drop("floor")
        fields = ", ".join(["kin long, dims int, region long, part long", "`to` int, least double, most double"])
        wanted = asks.groupBy(*GROUP).applyInPandas(lambda a: rings(a, space), fields)
        wanted = wanted.join(home.withColumnRenamed("cell", "to"), [*GROUP, "to"], "left_anti").withColumnRenamed("to", "cell")
        served = wanted.join(b, ["kin", "dims", "cell"]).filter((F.col("lo") <= F.col("most")) & (F.col("hi") >= F.col("least"))).drop("least", "most")
        far = self.meet(asks, served, k)
        found = near.drop("rank").unionByName(far)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def valid_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    x = F.col("v")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kind = vectors.select(label.alias("l")).schema["l"].dataType.typeName()
    code = label.cast("long") if kind in ("byte", "short", "integer", "long") else F.when(label.isNotNull(), F.xxhash64(label))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), code.alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.select("vec_id", "label", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("vector"), F.monotonically_increasing_id().alias("row"))


def make_space(rows: DataFrame) -> Space:
    """Pivots: of the rows, those whose vectors have the smallest hashes."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, longest = rows.agg(F.count("*"), F.max(square)).first()
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // ROWS_A_PIVOT))
    hashed = rows.select("vector", F.xxhash64("vector").alias("h")).filter(F.pmod("h", F.lit(max(1, n // (8 * pivots)))) == 0)
    chosen = hashed.groupBy("h").agg(F.any_value("vector").alias("vector")).orderBy("h").limit(pivots).collect()
    return Space([np.array(r["vector"], np.float64) for r in chosen], (longest or 0.0) * (1 + 1e-9))


def hard_negatives(vectors: DataFrame, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; a negative's score lies between ``low``
    and ``high`` percent of its positive's.
    """
    rows = persist(valid_rows(vectors, id_col, vector_col, F.col("label") if label is None else label, scale))
    space = make_space(rows)
    fields = "vec_id long, label long, vector binary, row long, dims int, cell int, away double"
    placed = persist(rows.mapInPandas(lambda b: located(b, space, True), fields))
    anchors = rows.filter(F.col("vec_id") % every == 0).mapInPandas(lambda b: located(b, space, False), fields)
    anchors = persist(anchors.select("row", F.lit(0).cast("long").alias("task"), F.col("vec_id").alias("anchor_id"), "label", "dims", "cell", "vector", F.lit(NONE).alias("low"), F.lit(ALL).alias("high")))
    kin = persist(Index(placed, space, True, block_rows).search(anchors, positives, group_rows))
    score = F.col("score").cast("decimal(38,0)")
    band = kin.select("row", F.col("cand_row").alias("task"), F.col("cand_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.ceil(score * low / 100)).cast("long").alias("low"), (F.floor(score * high / 100)).cast("long").alias("high")).filter("low <= high")
    asks = anchors.drop("task", "low", "high").join(band, "row")
    found = Index(placed, space, False, block_rows).search(asks.select(*[c.split()[0] for c in ASK.split(", ")]), negatives, group_rows)
    told = asks.select("row", "task", "anchor_id", "positive_id", "positive_score")
    return found.join(told, ["row", "task"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("cand_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
