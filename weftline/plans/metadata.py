"""Analytic queries over run metadata: newest per key, nearest peer, timings, counts, recent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def newest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of the largest ``order`` for each key, by an aggregate that combines before the shuffle."""
    best = df.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*df.columns).alias("row"))).alias("m"))
    return best.select("m.row.*")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same key."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def runs_with_results(runs: DataFrame, results: DataFrame, key: str, order: str, n: int | None = None) -> DataFrame:
    """Every run with its result or nulls, newest first; only the ``n`` newest runs meet their results."""
    newest = runs if n is None else runs.orderBy(F.col(order).desc_nulls_last(), F.col(key).desc()).limit(n)
    return newest.join(results, key, "left")


def partial_update(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the cells of ``changes`` that are not null; rows without a change and columns that only one side has stay as they are."""
    given = [c for c in changes.columns if c not in key and c in current.columns]
    new = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in given))
    joined = current.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in current.columns))


def nearest_peer(df: DataFrame, key: str, time: str, ident: str, width: int = 3600) -> DataFrame:
    """(id, peer_id, gap_seconds): the other row of the same key that is nearest in time.

    Of several as near, the one of the closest id counts, then the larger id. For every time
    of a key, the distinct times before and behind it are found in buckets of ``width``
    seconds and over the buckets; a row then looks for the closest id at its own time, or, if
    it is alone there, at the nearer of the two. No task holds all rows of a key.
    """
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    rows = df.select(F.col(key).alias("of"), F.col(ident).alias("id"), seconds.alias("t"))
    times = rows.groupBy("of", "t").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("t") / width))
    over = Window.partitionBy("of").orderBy("bucket")  # one row per bucket
    ends = times.groupBy("of", "bucket").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    ends = ends.select("of", "bucket", F.lag("high").over(over).alias("b_before"), F.lead("low").over(over).alias("b_behind"))
    inside = Window.partitionBy("of", "bucket").orderBy("t")
    near = times.withColumns({"i_before": F.lag("t").over(inside), "i_behind": F.lead("t").over(inside)}).join(ends, ["of", "bucket"])
    before, behind = F.coalesce("i_before", "b_before"), F.coalesce("i_behind", "b_behind")
    gap = F.when(F.col("n") > 1, F.lit(0).cast("long")).otherwise(F.least(F.col("t") - before, behind - F.col("t")))
    alone = near.select("of", "t", gap.alias("gap"), (F.col("t") - before == gap).alias("has_before"), (behind - F.col("t") == gap).alias("has_behind"))
    asked = rows.join(alone.filter("gap is not null"), ["of", "t"])
    at = F.when(F.col("gap") == 0, F.array("t")).otherwise(F.array_compact(F.array(F.when(F.col("has_before"), F.col("t") - F.col("gap")), F.when(F.col("has_behind"), F.col("t") + F.col("gap")))))
    probes = asked.select("of", F.explode(at).alias("t"), "id", "gap", F.lit(True).alias("probe"))
    held = rows.select("of", "t", "id", F.lit(None).cast("long").alias("gap"), F.lit(False).alias("probe"))
    along = Window.partitionBy("of", "t").orderBy("id", "probe")
    own = F.when(~F.col("probe"), F.col("id"))
    # a probe at its own time stands behind its own row, which is no peer
    skip = F.when(F.col("gap") == 0, 1).otherwise(0)
    lower = F.sort_array(F.array_compact(F.array(F.last(own, True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.last(own, True).over(along.rowsBetween(Window.unboundedPreceding, -2)))), False)
    met = probes.unionByName(held).withColumns({"lower": lower, "upper": F.first(own, True).over(along.rowsBetween(1, Window.unboundedFollowing)), "skip": skip})
    mine = F.filter("lower", lambda x: (F.col("skip") == 0) | (x != F.col("id")))
    found = met.filter("probe").select("of", "id", "gap", F.explode(F.array_compact(F.array(F.try_element_at(mine, F.lit(1)), "upper"))).alias("peer"))
    best = found.groupBy("of", "id", "gap").agg(F.min(F.struct(F.abs(F.col("id") - F.col("peer")).alias("g"), (-F.col("peer")).alias("neg"))).alias("b"))
    return best.select("id", (-F.col("b.neg")).alias("peer_id"), F.col("gap").alias("gap_seconds"))


def timings(df: DataFrame, group: str, start: str, end: str, rows: str) -> DataFrame:
    """(group, runs, total_seconds, total_rows, seconds_per_100) of finished runs."""
    t = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    out = df.filter(F.col(end).isNotNull()).groupBy(group).agg(F.count("*").alias("runs"), F.sum(t(end) - t(start)).alias("total_seconds"), F.sum(rows).alias("total_rows"))
    return out.withColumn("seconds_per_100", F.round(F.try_divide(F.col("total_seconds") * 100.0, F.col("total_rows")), 4))


def recent(df: DataFrame, order: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc()).limit(n)


def activity(parts: list[tuple[str, DataFrame, str, str]], n: int = 20) -> DataFrame:
    """(kind, id, at): the newest n entries of several (kind, table, id column, time column)."""
    feeds = [df.select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), F.col(t).cast("timestamp_ntz").alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(n) for kind, df, i, t in parts]
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.desc("at"), "kind", F.desc("id")).limit(n)


def stale(df: DataFrame, beat: str, now, minutes: int) -> DataFrame:
    """Rows whose last sign of life is over so many minutes old."""
    return df.filter(F.col(beat) < now - F.make_dt_interval(mins=F.lit(minutes)))


def insights(deltas: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(metric, insight, severity) for metrics that fell back or are below their targets."""
    goal = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))[F.col("metric")] if targets else F.lit(None).cast("double")
    below = F.coalesce(F.col("value_after") < goal, F.lit(False))
    kind = F.when(F.col("status") == "regressed", "regressed").when(below, "below_target")
    severity = F.when((F.col("status") == "regressed") & (F.abs("delta") >= 10), "high").when(F.col("status") == "regressed", "medium").when(goal - F.col("value_after") >= 15, "high").otherwise("medium")
    return deltas.withColumns({"insight": kind, "severity": severity}).filter("insight is not null").select("metric", "insight", "severity")


WEAK = {"statistical": 75.0, "correlation": 70.0, "ml_utility": 70.0}


def weak_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows (metric, score) below their thresholds."""
    goal = F.create_map(*(F.lit(x) for kv in WEAK.items() for x in kv))[F.col("metric")]
    return metrics.withColumn("threshold", goal).filter("score < threshold")
