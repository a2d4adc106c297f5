"""Generators: a Gaussian copula with empirical or fitted marginals, text providers, linked tables.

What a row gets depends on the seed and the row's number only: uniform numbers come from
hashes of both, so any task can make any row again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import exprs, roles, words
from weftline.functions.storage import settle
from weftline.operators import alike, clean, keys, marginals, profile, repair, rules, shape, text

KNOTS = 257


def uniform(ident, *salt) -> Column:
    """A number in (0, 1) by a hash of the row's number and the salt."""
    return (F.shiftrightunsigned(F.xxhash64(F.col(ident) if isinstance(ident, str) else ident, *map(F.lit, salt)), 11) + 0.5) / float(1 << 53)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """By the rational approximation of erf (Abramowitz and Stegun 7.1.26), to 1e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z) / 2
    return np.where(x < 0, tail, 1 - tail)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """By the rational approximation of Abramowitz and Stegun 26.2.23, sharpened by two Newton steps."""
    q = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(q))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    x = np.where(p < 0.5, -x, x)
    for _ in range(2):
        x = x - np.clip((normal_cdf(x) - p) * math.sqrt(2 * math.pi) * np.exp(x * x / 2), -0.1, 0.1) * (np.abs(x) < 4)
    return x


class GaussianCopula:
    """Normal scores of each column, their correlations, and quantile knots to go back.

    The model itself is of fixed size: ``KNOTS`` quantiles a number column, the shares of the
    ``max_categories`` commonest values of a text column, one correlation matrix. Text columns of
    more values keep a settled table of the rows that have the others, from which these are
    drawn, each as often as it stands.

    ``default_distribution`` names a family (``marginals``) for number columns, whose fitted
    quantiles take the place of the real ones; ``best`` takes the closest for each column, and
    a column that the family does not fit keeps its own. ``fitted`` has what was chosen.
    ``enforce_min_max_values`` keeps draws within the learnt range.
    """

    #: Whether a row comes from its number alone, so that a stream of numbers makes a stream of rows.
    streams = True

    def __init__(self, max_categories: int = 500, seed: int = 42, default_distribution: str | None = None, enforce_min_max_values: bool = True):
        self.max_categories, self.seed = max_categories, seed
        self.distribution, self.bounded = marginals.family_of(default_distribution or "empirical"), enforce_min_max_values
        self.fitted: dict[str, tuple[str, tuple[float, float], float]] = {}
        self.columns: list[tuple[str, str, object]] = []
        self.rare: dict[str, tuple[DataFrame, int]] = {}
        self.root = np.eye(0)

    def fit(self, df: DataFrame) -> GaussianCopula:
        numbers = [f.name for f in df.schema if roles.is_numeric(f.dataType)]
        dates = [f.name for f in df.schema if isinstance(f.dataType, roles.TEMPORAL)]
        points = [i / (KNOTS - 1) for i in range(KNOTS)]
        value = {c: exprs.number(c) for c in numbers} | {c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double") for c in dates}
        shaped = {c: value[c] for c in numbers} if self.distribution != "empirical" else {}
        rows = df.agg(*(F.percentile_approx(v, points, 10_000).alias(c) for c, v in value.items()), *marginals.moments(shaped)).first() if value else {}
        scores, self.columns, self.rare, self.fitted = [], [], {}, {}
        for f in df.schema:
            if f.name in value:
                knots = [float(x) for x in rows[f.name] or [0.0]]
                if f.name in shaped and (known := marginals.read_moments(rows, f.name)) and (fit := marginals.chosen(self.distribution, known, knots)):
                    self.fitted[f.name] = fit
                    knots = marginals.quantile_knots(*fit[:2], known[3], known[4], KNOTS, self.bounded)
                self.columns.append((f.name, "date" if f.name in dates else "int" if f.dataType.simpleString() in ("int", "bigint", "smallint") else "float", knots))
                p = self.cdf(value[f.name], knots)
            else:
                shares = self.shares(df, f.name)
                self.columns.append((f.name, "category", shares))
                middles, low = [], 0.0
                for v, s in shares:
                    middles += [F.lit(v), F.lit(low + s / 2)] if v is not None else []
                    low += s
                other = F.lit(1 - shares[-1][1] / 2) if f.name in self.rare else F.lit(0.5)
                p = F.coalesce(F.try_element_at(F.create_map(*middles), F.coalesce(F.col(f.name).cast("string"), F.lit(words.MISSING_CATEGORY))), other)
            scores.append(p.alias(f.name))
        normal = df.select(*scores)

        @F.pandas_udf("double")
        def score(p: pd.Series) -> pd.Series:
            return pd.Series(normal_quantile(p.fillna(0.5).clip(1e-6, 1 - 1e-6).to_numpy(float)))

        normal = normal.select(*(score(F.col(f"`{c}`")).alias(c) for c in df.columns))
        n = len(df.columns)
        pairs = [(i, j) for i in range(n) for j in range(i)]
        corr = np.eye(n)
        if pairs:
            # covariances, as a correlation with a constant column is an error
            row = normal.agg(*(F.covar_pop(df.columns[i], df.columns[j]).alias(f"p{i}_{j}") for i, j in pairs), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(df.columns))).first()
            for i, j in pairs:
                scale = (row[f"s{i}"] or 0.0) * (row[f"s{j}"] or 0.0)
                corr[i, j] = corr[j, i] = row[f"p{i}_{j}"] / scale if scale > 1e-12 else 0.0
        values, vectors = np.linalg.eigh(corr)
        self.root = vectors * np.sqrt(np.clip(values, 0, None))
        return self

    @staticmethod
    def cdf(v, knots: list[float]):
        below = F.size(F.filter(F.array(*(F.lit(k) for k in knots)), lambda k: k <= v))
        equal = F.size(F.filter(F.array(*(F.lit(k) for k in knots)), lambda k: k == v))
        return (below - equal / 2) / len(knots)

    def shares(self, df: DataFrame, column: str) -> list[tuple[str | None, float]]:
        """(value, share) of the commonest values; the last is (None, share) for all others if there are any."""
        value = F.coalesce(F.col(column).cast("string"), F.lit(words.MISSING_CATEGORY))
        counts = df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        top = counts.orderBy(F.desc("n"), "v").limit(self.max_categories + 1).collect()
        if len(top) <= self.max_categories:
            total = sum(r["n"] for r in top) or 1
            return [(r["v"], r["n"] / total) for r in top] or [(words.MISSING_CATEGORY, 1.0)]
        top = top[:-1]
        others = df.select(value.alias("v")).filter(~F.col("v").isin(*(r["v"] for r in top)))
        numbered = settle(clean.numbered(others.withColumn("m", F.monotonically_increasing_id()), ["v", "m"], "pos", 0).select("pos", "v"))
        rare = numbered.count()
        self.rare[column] = (numbered, rare)
        total = rare + sum(r["n"] for r in top)
        return [(r["v"], r["n"] / total) for r in top] + [(None, rare / total)]

    def generate(self, spark: SparkSession, rows: int, offset: int = 0) -> DataFrame:
        return self.of_numbers(spark.range(offset, offset + rows))

    def of_numbers(self, ids: DataFrame) -> DataFrame:
        """A row for each number (``id``), of a table or of a stream; it depends on the seed and the number only."""
        kinds = {"int": T.LongType(), "float": T.DoubleType(), "date": T.StringType(), "category": T.StringType()}
        names = [c for c, _, _ in self.columns]
        schema = T.StructType([T.StructField(f"c{i}", kinds[k]) for i, (_, k, _) in enumerate(self.columns)] + [T.StructField(f"r{i}", T.LongType()) for i, c in enumerate(names) if c in self.rare])
        columns, root = self.columns, self.root
        rare = {i: self.rare[c][1] for i, c in enumerate(names) if c in self.rare}

        def draw(batches):
            for batch in batches:
                z = normal_quantile(batch.to_numpy(float).reshape(-1, len(columns)))
                u = normal_cdf(z @ root.T) if len(z) else z
                out = {}
                for k, (_, kind, learnt) in enumerate(columns):
                    if kind == "category":
                        edges = np.cumsum([s for _, s in learnt])
                        at = np.minimum(np.searchsorted(edges, u[:, k], side="right"), len(learnt) - 1)
                        values = np.array([None if v == words.MISSING_CATEGORY else v for v, _ in learnt], dtype=object)
                        out[f"c{k}"] = values[at]
                        if k in rare:
                            share = (u[:, k] - (edges[-1] - learnt[-1][1])) / learnt[-1][1]
                            out[f"r{k}"] = pd.array(np.clip(share * rare[k], 0, rare[k] - 1).astype(np.int64), dtype="Int64")
                            out[f"r{k}"][at != len(learnt) - 1] = pd.NA
                        continue
                    x = np.interp(u[:, k], np.linspace(0, 1, len(learnt)), learnt)
                    out[f"c{k}"] = np.round(x).astype(np.int64) if kind == "int" else pd.to_datetime(x, unit="s").strftime("%Y-%m-%d") if kind == "date" else x
                yield pd.DataFrame(out, columns=schema.names)

        draws = ids.select(*(uniform("id", self.seed, i).alias(f"u{i}") for i in range(len(columns))))
        made = draws.mapInPandas(draw, schema)
        for k in rare:
            table = self.rare[names[k]][0].select(F.col("pos").alias("_pos"), F.nullif(F.col("v"), F.lit(words.MISSING_CATEGORY)).alias("_v"))
            common = made.filter(F.col(f"r{k}").isNull()).drop(f"r{k}")
            made = common.unionByName(made.filter(F.col(f"r{k}").isNotNull()).join(table, F.col(f"r{k}") == F.col("_pos")).withColumn(f"c{k}", F.col("_v")).drop("_pos", "_v", f"r{k}"))
        return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


class TemplateText:
    """Offline text provider: recombines halves of ``most`` texts (a sample by hash), for columns that a language model would write."""

    streams = True

    def __init__(self, column: str, most: int = 500, seed: int = 42):
        self.column, self.most, self.seed, self.texts = column, most, seed, [""]

    def fit(self, df: DataFrame) -> TemplateText:
        rows = df.select(F.col(self.column).alias("t")).filter("t is not null").distinct().orderBy(F.md5("t")).limit(self.most).collect()
        self.texts = [r["t"] for r in rows] or [""]
        return self

    def written(self, ident: Column, attempt: int = 0) -> Column:
        """The text of a row's number."""
        halves = [t.split() for t in self.texts]
        heads, tails = (F.array(*(F.lit(" ".join(x)) for x in part)) for part in ([h[: len(h) // 2] for h in halves], [h[len(h) // 2 :] for h in halves]))
        pick = lambda part, k: F.element_at(part, (F.floor(uniform(ident, self.seed, attempt, k) * len(self.texts)) + 1).cast("int"))
        return F.trim(F.concat_ws(" ", pick(heads, 0), pick(tails, 1)))

    def generate(self, spark: SparkSession, rows: int, offset: int = 0) -> DataFrame:
        return self.of_numbers(spark.range(offset, offset + rows))

    def of_numbers(self, ids: DataFrame) -> DataFrame:
        return ids.select(self.written(F.col("id")).alias(self.column))


class ProvidedText(TemplateText):
    """Texts by a provider such as a language model, which gets (numbers, example texts) and answers with a string.

    Numbers are asked for in batches, inside tasks. Answers are read by ``text.answers_by_id``;
    what is missing, repeats another text or is too like a real one (a ratio of ``similarity``
    or more to any text of the column, see ``alike``) is asked for again, up to ``retries``
    times, then written from templates.
    """

    def __init__(self, column: str, provider: Callable[[list[int], list[str]], str], batch: int = 25, retries: int = 3, most: int = 500, seed: int = 42, similarity: float = 0.92):
        super().__init__(column, most, seed)
        self.provider, self.batch, self.retries, self.similarity = provider, batch, retries, similarity
        self.real: DataFrame | None = None

    #: A retry depends on what other rows got, so no row comes from its number alone.
    streams = False

    def fit(self, df: DataFrame) -> ProvidedText:
        super().fit(df)
        self.real = settle(df.select(F.col(self.column).cast("string").alias("text")).filter("text is not null").distinct())
        return self

    def asked(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the answers to settled ``ids``."""
        ask, examples, size = self.provider, self.texts, self.batch

        def run(batches):
            for rows in batches:
                numbers = rows["id"].tolist()
                parts = [numbers[at : at + size] for at in range(0, len(numbers), size)]
                if parts:
                    yield pd.DataFrame({"ids": parts, "answer": [ask(p, examples[:5]) for p in parts]})

        # answers cost money and differ each time, so they are settled before they are read
        return text.answers_by_id(settle(ids.mapInPandas(run, "ids array<long>, answer string")), "answer", "ids")

    def generate(self, spark: SparkSession, rows: int, offset: int = 0) -> DataFrame:
        todo, kept = spark.range(offset, offset + rows), None
        real = spark.createDataFrame([(t,) for t in self.texts], "text string") if self.real is None else self.real
        for _ in range(self.retries):
            found = alike.too_similar(self.asked(todo).join(todo, "id"), "text", real, threshold=self.similarity, out_col="like").filter("not like").withColumn("low", F.lower("text"))
            if kept is not None:
                found = found.join(kept.select(F.lower("text").alias("low")).distinct(), "low", "left_anti")
            found = settle(found.groupBy("low").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id")).select("id", "text"))
            kept = found if kept is None else settle(kept.unionByName(found))
            todo = settle(todo.join(kept.select("id"), "id", "left_anti"))
            if todo.isEmpty():
                break
        rest = todo.select("id", self.written(F.col("id")).alias("text"))
        return (rest if kept is None else kept.unionByName(rest)).orderBy("id").select(F.col("text").alias(self.column))


def generator(name: str, **options):
    """The generator of a name; those that need a deep-learning library say so."""
    if name == "gaussian_copula":
        return GaussianCopula(**options)
    if name == "llm_text":
        return ProvidedText(**options) if "provider" in options else TemplateText(**options)
    if name in ("ctgan", "tvae"):
        raise RuntimeError(f"{name} needs the optional dependency torch, which is not installed")
    raise ValueError(f"unknown generator {name!r}")


def batch_size(rows: int, wanted: int | None = None, most_batches: int = 100) -> int:
    """Rows in one checkpointed batch: a few for small requests, and so many that there are at most ``most_batches``."""
    if wanted:
        return wanted
    return max(5, rows // 2) if rows <= 20 else 25 if rows <= 100 else 100 if rows <= 500 else max(200, -(-rows // most_batches))


def generate_rows(model, spark: SparkSession, rows: int, real: DataFrame | None = None, row_rules: list[dict] | None = None, derive: list[dict] | None = None, actions: dict[str, str] | None = None, factor: float = 1.25, most: int = 10) -> DataFrame:
    """``rows`` rows that keep the rules; raises when ``most`` attempts do not find them."""

    def attempts():
        have = offset = 0
        for _ in range(most):
            ask = max(1, math.ceil((rows - have) * factor))
            have += yield rules.valid_rows(rules.apply_derived(model.generate(spark, ask, offset), derive or []), row_rules or [])
            offset += ask

    out = repair.first_rows(attempts(), rows)
    out = clean.impute(out, real.select(*[c for c in out.columns if c in real.columns])) if real is not None else out
    return clean.apply_actions(out, actions, out.columns[:1]) if actions else out


def generate_checkpointed(model, spark: SparkSession, rows: int, path: str, wanted: int | None = None, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Generate in batches that are written as Parquet; a restart goes on behind the last whole batch.

    ``progress`` is told (rows done, rows wanted) after every batch, from what was written. Where
    more rows than asked for are there already, the first of them are returned.
    """
    from weftline.sources import sinks

    done, size = sinks.checkpoint_rows(spark, path), batch_size(rows, wanted)
    while done < rows:
        n = min(size, rows - done)
        done += sinks.append_batch(model.generate(spark, n, done), path, done)
        if progress:
            progress(done, rows)
    return sinks.read_checkpoint(spark, path, rows)


def parents_first(tables: list[str], relations: list[tuple[str, str, str, str]]) -> list[str]:
    """The tables in an order in which parents stand before their children; a cycle is an error."""
    left, out = set(tables), []
    while left:
        ready = sorted(t for t in left if not any(c == t and p in left and p != t for p, _, c, _ in relations))
        if not ready:
            raise ValueError("the relations form a cycle")
        out += ready
        left -= set(ready)
    return out


def rendered(template: str) -> tuple[str, int, str]:
    """(before, width, behind) of the last number in a value."""
    at = list(re.finditer(r"\d+", template))
    return (template[: at[-1].start()], len(at[-1].group()), template[at[-1].end() :]) if at else (template, 0, "")


def post_processed(real: DataFrame, out: DataFrame, pk: str, found: dict, most_categories: int = 50) -> DataFrame:
    """A generated table in the form of its original: other ids, key functions, decimals, derived columns, category shares."""
    for c in found["ids"]:
        if c != pk:
            values = [str(r[c]) for r in real.select(c).orderBy(F.desc(c)).limit(500).collect()]
            out = keys.make_ids(out, c, [pk], keys.id_pattern(values), real.select(F.col(c).cast("string")))
            out = out.withColumn(c, F.col(c).try_cast(real.schema[c].dataType))
    for c in found["functions"]:
        sample = real.filter(F.col(c).isNotNull()).select(c).orderBy(pk).first()
        before, width, behind = rendered(str(sample[c]) if sample else "")
        out = keys.apply_key_function(out.withColumn(c, F.lit(None).cast("string")), pk, c, real.select(pk, c), before, width, behind)
    modelled = [c for c in real.columns if c in out.columns]
    for r in found["derived"]:
        if r["rule_type"] == "arithmetic" and r["target"] not in out.columns:
            out = out.withColumn(r["target"], F.lit(None).cast(real.schema[r["target"]].dataType))
    out = rules.apply_derived(shape.restored(out, real.select(*modelled)), found["derived"])
    made = {r["target"] for r in found["derived"]}
    out = shape.restored(out, real.select(*(c for c in made if c in out.columns))) if made else out
    fixed = {pk, *found["ids"], *found["foreign"], *found["functions"], *made}
    for c in profile.text_columns(real):
        if c in out.columns and c not in fixed and real.select(c).distinct().limit(most_categories + 1).count() <= most_categories:
            out = repair.restore_categories(real, out, c, [pk])
    return out


def linked(tables: dict[str, DataFrame], relations: list[tuple[str, str, str, str]], primary: dict[str, str], rows: int | dict[str, int], seed: int = 42) -> dict[str, DataFrame]:
    """Synthetic tables whose foreign keys point to synthetic parents, as often as the originals do.

    Ids, foreign keys, key functions and derived columns are not learnt but made again.
    """
    made: dict[str, DataFrame] = {}
    for name in parents_first(list(tables), relations):
        df, pk = tables[name], primary[name]
        spark, n = df.sparkSession, rows[name] if isinstance(rows, dict) else rows
        foreign = {fk: (p, k) for p, k, c, fk in relations if c == name}
        found = shape.analyse_table(df, list(foreign), pk)
        spans = [r["target"] for r in found["derived"] if r["rule_type"] == "date_difference"]
        derived = [r["target"] for r in found["derived"] if r["target"] not in spans]
        body = rules.with_spans(shape.training_frame(df, [pk, *found["ids"]], list(foreign), derived, found["functions"]), found["derived"])
        body = body if set(body.columns) - {pk, *foreign} else df.select()
        out = GaussianCopula(seed=seed).fit(body).generate(spark, n) if body.columns else spark.range(n).select()
        start = keys.next_integers(df, pk)["start"] if dict(df.dtypes)[pk] in ("int", "bigint") else 1
        out = clean.numbered(out.withColumn("_i", F.monotonically_increasing_id()), ["_i"], pk, start).drop("_i")
        for fk, (parent, key) in foreign.items():
            # child counts of the original parents, by falling count, meet the synthetic parents by place
            counts = clean.numbered(df.groupBy(F.col(fk)).agg(F.count("*").alias("w")).withColumn("o", -F.col("w")), ["o", fk], "_p", 0).select("_p", "w")
            parents = clean.numbered(made[parent].select(F.col(key).alias("value")), ["value"], "_p", 0)
            weights = parents.join(counts, "_p", "left").select("value", F.coalesce("w", F.lit(1)).cast("double").alias("weight"))
            draws = draw_weighted(weights, n, seed)
            out = clean.numbered(out, [pk], "_q", 0).join(draws.withColumnRenamed("value", fk), "_q").drop("_q")
        made[name] = settle(shape.aligned(post_processed(df, out, pk, found), df.columns))
    return made


def draw_weighted(weights: DataFrame, n: int, seed: int) -> DataFrame:
    """(_q, value): n systematic draws in proportion to weight, in shuffled order."""
    picked = repair.systematic(weights.withColumn("k", F.col("value").cast("string")), "weight", n, ["k"], seed)
    filled = repair.fill_up(picked.select("value").withColumn("k", F.col("value").cast("string")), n, ["k"])
    return clean.numbered(filled.withColumn("h", exprs.md5_order("k", seed=seed)).withColumn("m", F.monotonically_increasing_id()), ["h", "m"], "_q", 0).select("_q", "value")


def linked_report(tables: dict[str, DataFrame], relations: list[tuple[str, str, str, str]], primary: dict[str, str]) -> DataFrame:
    """(check_name, bad_rows, passed) for keys and foreign keys of linked tables."""
    parts = []
    for name, pk in primary.items():
        r = keys.key_report(tables[name], pk)
        parts.append(r.select(F.lit(f"{name}.{pk} unique").alias("check_name"), (F.col("total_rows") - F.col("distinct_keys")).alias("bad_rows")))
    for p, k, c, fk in relations:
        r = keys.foreign_key_rows(tables[c], fk, tables[p], k)
        parts.append(r.select(F.lit(f"{c}.{fk} -> {p}.{k}").alias("check_name"), F.col("orphan_rows").alias("bad_rows")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumn("passed", F.col("bad_rows") == 0)
