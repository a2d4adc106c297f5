"""Exact nearest row of a reference table by Gower distance, without comparing all pairs.

Gower's distance is the mean over columns of a capped difference or of unequal labels. It
keeps the triangle inequality, also where missing numbers count as far from everything. Rows of
the reference are counted by boxes (equal labels, numbers within a quarter of their range), and
one row of each of the fullest boxes is a pivot. Every different reference row belongs to the
cell of its nearest pivot and, within it, to one of the rings of about equal depth that its
distance from the pivot gives. A query with an equal row is done. Any other first meets the ring
it would lie in itself; the best distance so far then bounds, for every pivot, the rings in which
a nearer row can lie, and the query meets those that there are. Nothing is sampled: pivots and
rings only decide who meets whom, and no row is left out that could be nearer. Equal queries are
one; rows meet in numpy blocks: what leaves a block is one number a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import exprs
from weftline.functions.storage import settle

#: Pivots at most, rows of a ring aimed at, and rows or queries of a block at most, about.
PIVOTS, RING_ROWS, BLOCK_ROWS = 64, 1024, 4096
#: Parts of a number's range that boxes tell apart, rings of a cell at most, and queries times rings that leave a task at once, about.
PARTS, MOST_RINGS, AT_ONCE = 4, 2048, 200_000
#: Distances computed at once, so that they stay in a core's cache.
CACHED = 32_768
#: By how much rounding may shift a distance.
SLACK = 1e-9


class Gower:
    """The distance between blocks of rows: numbers x0, x1 and so on, then label codes c0, c1 and so on."""

    def __init__(self, ranges: list[float], labels: int):
        self.ranges, self.parts = ranges, max(1, len(ranges) + labels)
        self.numbers = [f"x{i}" for i in range(len(ranges))]
        self.codes = [f"c{i}" for i in range(labels if self.parts == len(ranges) + labels else 1)]  # without columns all rows are alike
        self.columns = self.numbers + self.codes
        self.fields = ", ".join([f"{c} double" for c in self.numbers] + [f"{c} long" for c in self.codes])

    def rows(self, df: pd.DataFrame) -> list[np.ndarray]:
        return [df[c].to_numpy(float) for c in self.numbers] + [df[c].to_numpy(np.int64) for c in self.codes]

    def between(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        out, k = np.zeros((len(a[0]), len(b[0]))), len(self.ranges)
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(out), step := max(1, CACHED // max(1, len(b[0])))):
                part = out[at : at + step]
                for x, y, r in zip(a, b, self.ranges):
                    gap = x[at : at + step, None] - y
                    np.abs(gap, out=gap)
                    gap /= r
                    part += np.fmin(gap, 1.0, out=gap)  # of a missing number and 1, this is 1
                for x, y in zip(a[k:], b[k:]):
                    part += x[at : at + step, None] != y
                part /= self.parts
        return out


def prepared(df: DataFrame, numbers: list[str], labels: list[str], key: str) -> DataFrame:
    """(key, x0.., c0..): missing numbers are NaN, labels their hashes, missing ones alike."""
    code = lambda c: F.coalesce(F.xxhash64(F.col(c).cast("string")), F.lit(0).cast("long"))
    values = [(F.coalesce(exprs.number(c), F.lit(float("nan"))) + 0.0).alias(f"x{i}") for i, c in enumerate(numbers)]  # of zeros, the positive
    codes = [F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(code(c)).alias(f"c{i}") for i, c in enumerate(labels)]
    return df.select(F.col(key).alias("key"), *values, *(codes if values or codes else [F.lit(0).cast("long").alias("c0")]))


class Index:
    """The different rows of a reference table in cells and rings, to be asked more than once."""

    def __init__(self, reference: DataFrame, numbers: list[str], labels: list[str], ranges: dict[str, float], key: str):
        self.of = numbers, labels, key
        self.gower = gower = Gower([float(ranges.get(c) or 1.0) for c in numbers], len(labels))
        # equal rows are met once; of their keys, two tell whether another row than the query's own is among them
        once = prepared(reference, numbers, labels, key).groupBy(*gower.columns).agg(F.count("*").alias("n"), F.min("key").alias("one"))
        self.once = once = settle(once.select(F.monotonically_increasing_id().alias("id"), "n", "one", *gower.columns))
        self.total = once.count()
        if self.total:
            self.pivot_ids, self.pivots = self.chosen()
            self.ref, self.cells = self.ringed()
            self.sizes = self.ref.groupBy("cell", "ring").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))

    def chosen(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """A row of each of the fullest boxes; all rows are counted."""
        gower = self.gower
        box = [F.when(~F.isnan(c), F.floor(F.col(c) * PARTS / F.lit(r))).alias(f"b{c}") for c, r in zip(gower.numbers, gower.ranges)]
        boxes = self.once.groupBy(*box, *gower.codes).agg(F.count("*").alias("rows"), F.min("id").alias("id")).orderBy(F.desc("rows"), "id").limit(PIVOTS)
        few = self.once.join(F.broadcast(boxes.select("id")), "id", "left_semi").toPandas()  # as many rows as there are pivots
        return few["id"].to_numpy(np.int64), gower.rows(few)

    def ringed(self) -> tuple[DataFrame, dict[int, tuple]]:
        """The rows with cell and ring, and of each cell the cuts between its rings, its least and its greatest distance."""
        gower, pivots = self.gower, self.pivots

        def placed(batches):
            for rows in batches:
                for at in range(0, len(rows), BLOCK_ROWS):
                    part = rows.iloc[at : at + BLOCK_ROWS]
                    d = gower.between(gower.rows(part), pivots)
                    yield part.assign(cell=d.argmin(1).astype(np.int32), away=d.min(1))

        ref = settle(self.once.select("id", *gower.columns).mapInPandas(placed, f"id long, {gower.fields}, cell int, away double"))
        most = max(2, min(MOST_RINGS, -(-self.total // RING_ROWS)))
        sketch = F.percentile_approx("away", [i / most for i in range(1, most)], max(10_000, 4 * most))
        cells = {}
        for r in ref.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far"), sketch.alias("q")).collect():
            rings = min(most, -(-r["n"] // RING_ROWS))
            cells[r["cell"]] = (np.array(sorted({r["q"][i * most // rings - 1] for i in range(1, rings)} - {r["near"]})), r["near"], r["far"])
        cuts = ref.sparkSession.createDataFrame([(p, [float(x) for x in c[0]]) for p, c in cells.items()], "cell int, cuts array<double>")
        ring = exprs.position("away", "cuts", most).cast("int").alias("ring")
        return ref.join(F.broadcast(cuts), "cell").select("id", *gower.columns, "cell", ring), cells

    def asked(self, queries: DataFrame, itself: bool) -> DataFrame:
        """(key, x0.., c0.., skip): ``skip`` is the reference row that a query must not meet, or -1."""
        numbers, labels, key = self.of
        out = prepared(queries, numbers, labels, key)
        if not itself:
            return out.withColumn("skip", F.lit(-1).cast("long"))
        single = self.once.filter("n = 1").select(F.col("one"), F.col("id").alias("skip"), *(F.col(c).alias(f"_{c}") for c in self.gower.columns))
        same = F.col("key").eqNullSafe(F.col("one"))
        for c in self.gower.columns:
            same = same & (F.col(c) == F.col(f"_{c}"))
        return out.join(single, same, "left").select(*out.columns, F.coalesce("skip", F.lit(-1).cast("long")).alias("skip"))

    def different(self, asked: DataFrame) -> DataFrame:
        """(q, x0.., c0.., skip, n, copied): equal queries as one with their number, and whether the reference has an equal row that counts."""
        columns = self.gower.columns
        groups = asked.groupBy(*columns, "skip").agg(F.count("*").alias("n"))
        twins = groups.join(self.once.select("id", *columns), columns, "left").withColumn("copied", F.coalesce(F.col("id") != F.col("skip"), F.lit(False)))
        return settle(twins.select(F.monotonically_increasing_id().alias("q"), *columns, "skip", "n", "copied"))

    def own(self) -> DataFrame:
        """``different`` of the reference's own rows, each without itself."""
        return self.once.select(F.col("id").alias("q"), *self.gower.columns, F.when(F.col("n") == 1, F.col("id")).otherwise(F.lit(-1).cast("long")).alias("skip"), "n", (F.col("n") > 1).alias("copied"))

    def met(self, wanted: DataFrame) -> DataFrame:
        """(q, distance): the nearest row in the rings that queries (q, skip, x0.., c0.., cell, ring) want, a number for each block."""
        gower, columns, place = self.gower, self.gower.columns, ["cell", "ring", "part", "side"]

        def block(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or rows.empty:
                return pd.DataFrame({"q": [], "distance": []})
            a, b, place = gower.rows(asked), gower.rows(rows), pd.Series(np.arange(len(rows)), rows["id"].to_numpy())
            own = place.reindex(asked["skip"].to_numpy()).to_numpy()  # where the row stands that is not to be met
            nearest, step = np.empty(len(asked)), max(1, CACHED // len(rows))
            for at in range(0, len(asked), step):
                d, skip = gower.between([x[at : at + step] for x in a], b), own[at : at + step]
                d[np.flatnonzero(skip >= 0), skip[skip >= 0].astype(int)] = np.inf
                nearest[at : at + step] = d.min(1)
            return pd.DataFrame({"q": asked["q"], "distance": nearest})[np.isfinite(nearest)]

        crowd = wanted.groupBy("cell", "ring").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("sides")).join(self.sizes, ["cell", "ring"])
        each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        left = wanted.join(crowd, ["cell", "ring"]).withColumns({"side": F.pmod(F.xxhash64("q"), F.col("sides")), "part": each("parts")}).select("q", "skip", *columns, *place)
        right = self.ref.join(crowd, ["cell", "ring"]).withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")), "side": each("sides")}).select("id", *columns, *place)
        left, right = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (left, right))
        return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(block, "q long, distance double")

    def distances(self, groups: DataFrame) -> DataFrame:
        """``groups`` (see ``different``) with the distance to the nearest row; null without one."""
        gower, columns = self.gower, self.gower.columns
        if not self.total:
            return groups.withColumn("distance", F.lit(None).cast("double"))
        pivots, ids, cells = self.pivots, self.pivot_ids, self.cells
        held = np.array(sorted(cells))  # a missing number is far from itself, so a pivot's cell may be empty
        fields, out = ["q", "skip", *columns], f"q long, skip long, {gower.fields}, cell int, ring int"

        def blocks(batches):
            for rows in batches:
                for at in range(0, len(rows), BLOCK_ROWS):
                    part = rows.iloc[at : at + BLOCK_ROWS].reset_index(drop=True)
                    d = gower.between(gower.rows(part), pivots)
                    cell = held[d[:, held].argmin(1)]
                    yield part, d, cell, rings_of(cell, d[np.arange(len(part)), cell])

        def rings_of(cell: np.ndarray, d: np.ndarray) -> np.ndarray:
            ring = np.zeros(len(d), np.int32)
            for p in np.unique(cell):
                at = cell == p
                ring[at] = np.searchsorted(cells[p][0], d[at], "right")
            return ring

        def first_rings(batches):
            for part, _, cell, ring in blocks(batches):
                yield part[fields].assign(cell=cell.astype(np.int32), ring=ring)

        def other_rings(batches):
            """All rings that may hold a row nearer than the nearest so far, without the one that was met first."""
            near, far = (np.array([cells[p][i] for p in held]) for i in (1, 2))
            for part, d, cell, ring in blocks(batches):
                start = np.where(part["skip"].to_numpy()[:, None] == ids[None], 1.0, d).min(1)  # pivots are reference rows
                bound = np.fmin(part["found"].to_numpy(float), start)[:, None] + SLACK
                low, high = d[:, held] - bound, d[:, held] + bound
                row, col = np.nonzero((low <= far) & (high >= near))
                p, low, high = held[col], low[row, col], high[row, col]
                low, many = rings_of(p, low), rings_of(p, high) - rings_of(p, low) + 1
                lot = np.cumsum(many) // AT_ONCE
                for i in np.unique(lot):
                    at = np.flatnonzero(lot == i)
                    each = np.repeat(at, many[at])
                    step = np.arange(len(each)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
                    r = low[each] + step
                    new = (p[each] != cell[row[each]]) | (r != ring[row[each]])
                    if new.any():
                        yield part[fields].iloc[row[each[new]]].assign(cell=p[each[new]].astype(np.int32), ring=r[new].astype(np.int32))

        rest = groups.filter("not copied").select("q", "skip", *columns)
        first = settle(self.met(rest.mapInPandas(first_rings, out)).groupBy("q").agg(F.min("distance").alias("found")))
        wanted = rest.join(first, "q", "left").mapInPandas(other_rings, out)
        best = first.unionByName(self.met(wanted).withColumnRenamed("distance", "found")).groupBy("q").agg(F.min("found").alias("found"))
        # missing numbers count as far from everything, so no row is nearer than an equal one
        equal = sum((F.isnan(c).cast("double") for c in gower.numbers), F.lit(0.0)) / gower.parts
        return groups.join(best, "q", "left").withColumn("distance", F.when(F.col("copied"), equal).otherwise(F.col("found"))).drop("found")


def gower_nearest_exact(queries: DataFrame, reference: DataFrame, numbers: list[str], labels: list[str], ranges: dict[str, float], key: str, itself: bool = False) -> DataFrame:
    """(key, distance): Gower distance from each query to its nearest reference row; null without one.

    With ``itself`` a query's own row, of its key and values, is left out of the reference, as
    far as it stands there once.
    """
    index = Index(reference, numbers, labels, ranges, key)
    asked, place = index.asked(queries, itself), [*index.gower.columns, "skip"]
    return asked.join(index.distances(index.different(asked)).select(*place, "distance"), place, "left").select("key", "distance")
