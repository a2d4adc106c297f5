"""Train on synthetic, test on real: random forests on either table, tested on the same real rows.

A forest looks at bins of numbers and at told values only, so rows that agree in them and in the
label are one weighted row to it. Tables of over ROWS rows are grouped so before they are fitted.
Every row counts, also for the bins; what a tree draws with replacement are the rows of a group in blocks.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import exprs, roles, words
from weftline.functions.storage import settle
from weftline.operators import profile, repair

TREES, DEPTH, LIFT, SEED = 50, 6, 0.05, 42
#: Values of a text column that are told apart (the commonest ones); the forest's bins have to hold them.
VALUES, BINS = 200, 256
#: Rows up to which a forest is fitted row by row; of more, a grouped table has about as many (or as many as it has different rows).
#: Spark takes the thresholds of up to so many rows from all of them, of more from a sample of so many.
ROWS = BINS * BINS
RESULT = "target string, task string, status string, real_score double, synthetic_score double, score double"


def task_of(df: DataFrame, target: str) -> str | None:
    """regression for numbers with over 10 values, classification for 2 to 20 values, else nothing."""
    n = df.select(target).distinct().limit(21).count()
    if roles.is_numeric(df.schema[target].dataType) and n > 10:
        return "regression"
    return "classification" if 2 <= n <= 20 else None


def features_of(real: DataFrame, columns: list[str]) -> tuple[dict[str, list[str]], dict]:
    """The values told apart in text columns and the medians of number columns, learnt on the real training rows."""
    numbers = [c for c in columns if roles.is_numeric(real.schema[c].dataType)]
    medians = real.agg(*(F.percentile_approx(exprs.number(c), 0.5).alias(c) for c in numbers)).first().asDict() if numbers else {}
    texts: dict[str, list[str]] = {c: [] for c in columns if c not in numbers}
    if texts:
        for r in profile.value_counts(real.select(*(F.col(c).cast("string").alias(c) for c in texts)), list(texts), VALUES).filter("value is not null").collect():
            texts[r["column_name"]].append(r["value"])
    return texts, medians


def detached(model):
    """A fitted model without its training summary, which holds the session and whatever is not serializable in it."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(model._java_obj.getClass().getClassLoader().loadClass("scala.Option").getMethod("empty", None).invoke(None, None))
    return model


def bin_cuts(df: DataFrame, numbers: list[str]) -> dict[str, list[float]]:
    """The different values at the borders of as many parts of equal depth as the forest has bins."""
    points = [i / (BINS - 1) for i in range(1, BINS - 1)]
    row = df.agg(*(F.percentile_approx(c, points, profile.ACCURACY).alias(c) for c in numbers)).first() if numbers else {}
    return {c: sorted(set(row[c] or [])) for c in numbers}


def in_bins(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Numbers replaced by how many cuts are not above them."""
    return df.withColumns({c: exprs.position(c, F.array(*map(F.lit, own)), len(own) + 1).cast("double") if own else F.lit(0.0) for c, own in cuts.items()})


def grouped(df: DataFrame, columns: list[str], regression: bool) -> DataFrame:
    """Rows equal in ``columns`` and ``_y`` as one with their number ``_w``, in so many blocks that there are about ROWS in all.

    In a regression rows that are equal in ``columns`` have their mean: what their labels differ
    within a block is the same in every split, as no split parts them.
    """
    keys = columns if regression else [*columns, "_y"]
    blocks = max(1, ROWS // max(1, df.select(*keys).distinct().count()))
    rows = df.withColumn("_b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).groupBy(*keys, "_b")
    out = rows.agg(F.count("*").cast("double").alias("_w"), *([F.avg("_y").alias("_y")] if regression else [])).drop("_b")
    return settle(out.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism)))


def utility(real: DataFrame, synthetic: DataFrame, target: str, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """(target, task, status, real_score, synthetic_score, score) for one target."""
    spark, columns = real.sparkSession, [c for c in (columns or real.columns) if c not in (target, *key) and c in synthetic.columns]
    row = lambda *v: spark.createDataFrame([v], RESULT)
    task = task_of(real, target)
    if task is None or not columns or real.count() < 10 or synthetic.count() < 5:
        return row(target, task, "not_applicable", None, None, None)
    split = settle(repair.train_test_split(real.filter(F.col(target).isNotNull()), key))
    train, test = split.filter("not is_test"), split.filter("is_test")
    texts, medians = features_of(train, columns)

    def told(c: str):
        """The value, one of the commonest, or that it is missing or another."""
        value = F.col(c).cast("string")
        return F.when(value.isNull(), "?").when(value.isin(*texts[c]), value).otherwise("?other")

    def ready(df: DataFrame) -> DataFrame:
        label = exprs.number(target) if task == "regression" else F.col(target).cast("string")
        return df.select(*(F.coalesce(exprs.number(c), F.lit(float(m or 0))).alias(c) for c, m in medians.items()), *(told(c).alias(c) for c in texts), label.alias("_y")).filter("_y is not null")

    train, test, fake = ready(train), ready(test), ready(synthetic)
    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in texts]
    stages.append(VectorAssembler(inputCols=[*medians, *(f"_{c}" for c in texts)], outputCol="_x"))
    if task == "classification":
        labels = StringIndexer(inputCol="_y", outputCol="_label", handleInvalid="skip").fit(train)
        model = RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=BINS)
    else:
        labels = None
        model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=BINS)
    prepared = Pipeline(stages=stages).fit(train)
    shaped = lambda df: prepared.transform(labels.transform(df) if labels else df)

    def predicted(df: DataFrame) -> DataFrame:
        """The test rows with the predictions of a forest of ``df``; in its bins, if it has too many rows to be fitted one by one."""
        if df.count() <= ROWS:
            return detached(model.fit(shaped(df))).transform(shaped(test))
        own = bin_cuts(df, list(medians))
        one = grouped(in_bins(df, own), [*medians, *texts], task == "regression")
        return detached(model.copy({model.weightCol: "_w"}).fit(shaped(one))).transform(shaped(in_bins(test, own)))

    a = predicted(train)
    if task == "classification":
        metric = lambda df, name: MulticlassClassificationEvaluator(labelCol="_label", metricName=name).evaluate(df)
        majority = labels.transform(test).groupBy("_label").count().agg(F.max("count") / F.sum("count")).first()[0]
        if metric(a, "accuracy") < majority + LIFT:
            return row(target, task, "not_predictable", None, None, None)
        x, y = metric(a, "f1"), metric(predicted(fake), "f1")
    else:
        metric = lambda df, name: RegressionEvaluator(labelCol="_y", metricName=name).evaluate(df)
        if metric(a, "r2") < LIFT:
            return row(target, task, "not_predictable", None, None, None)
        x, y = metric(a, "rmse"), metric(predicted(fake), "rmse")
    score = 100.0 if x == y else 100.0 * min(x, y) / max(x, y)
    return row(target, task, "evaluated", float(x), float(y), round(score, 4))


def rank_targets(df: DataFrame, key: list[str], most: int = 6) -> list[str]:
    """Columns worth predicting: named like outcomes first, then classes, then numbers."""
    hints = words.TARGET_HINTS
    found = [(c, task_of(df, c)) for c in df.columns if c not in key and not c.lower().endswith("_id")]
    rank = lambda c, t: (next((i for i, h in enumerate(hints) if h in c.lower()), len(hints)), t != "classification", c)
    return [c for c, t in sorted((x for x in found if x[1]), key=lambda x: rank(*x))][:most]


def utility_auto(real: DataFrame, synthetic: DataFrame, key: list[str], target: str | None = None) -> DataFrame:
    """The first target that real rows can predict."""
    out = None
    for t in [target] if target else rank_targets(real, key):
        out = utility(real, synthetic, t, key)
        if out.first()["status"] == "evaluated":
            return out
    return out if out is not None else real.sparkSession.createDataFrame([(None, None, "not_applicable", None, None, None)], RESULT)
