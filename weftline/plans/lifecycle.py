"""Whole runs: evaluate a synthetic table, improve it, tune a generator, review the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import roles
from weftline.operators import compare, generate, keys, ml, profile, repair, rules, text
from weftline.plans import metadata

METRIC = "metric string, score double, status string"


def evaluate(real: DataFrame, synthetic: DataFrame, key: str, configs: dict[str, dict] | None = None, target: str | None = None, relations: list | None = None) -> DataFrame:
    """(metric, score, status): statistical, correlation, ml_utility, text, referential and privacy."""
    use, other = compare.eligible(real.select(*compare.common(real, synthetic)), configs)
    numbers, labels = [c for c, r in use.items() if r == "numerical"], [c for c, r in use.items() if r == "categorical"]
    rows = []
    stat = compare.statistical_similarity(real, synthetic, configs).agg(F.avg("score")).first()[0]
    rows.append(("statistical", stat))
    if len(numbers) >= 2:
        rows.append(("correlation", compare.correlation_preservation(real, synthetic, numbers).first()["overall_score"]))
    else:
        few = [c for c in labels if 2 <= real.select(c).distinct().limit(31).count() <= 30]
        rows.append(("correlation", compare.association_preservation(real, synthetic, few).first()[0] if len(few) >= 2 else None))
    rows.append(("ml_utility", ml.utility_auto(real, synthetic, [key], target).first()["score"]))
    texts = [c for c, r in other.items() if r == "free_form_text"]
    scores = [text.text_quality(real, synthetic, c)["score"] for c in texts]
    rows.append(("text", sum(scores) / len(scores) if scores else None))
    rows.append(("referential", keys.integrity(relations).agg(F.avg("score")).first()[0] if relations else None))
    enough = real.limit(5).count() >= 5 and synthetic.limit(5).count() >= 5
    rows.append(("privacy", compare.privacy(real, synthetic, key, None, None).first()["score"] if enough else None))
    return real.sparkSession.createDataFrame([(m, None if s is None else float(s), "not_applicable" if s is None else "evaluated") for m, s in rows], METRIC)


def improve(real: DataFrame, synthetic: DataFrame, key: str, thresholds=(0.04, 0.08, 0.14)) -> tuple[DataFrame, DataFrame]:
    """(best table, candidate scores): repairs at several thresholds against the table as it is."""
    concepts = roles.business_roles(real)
    numbers = [c for c in profile.numeric_columns(real) if c != key and c in synthetic.columns]
    labels = [c for c in concepts["statuses"] + concepts["categories"] if c in synthetic.columns]
    found = rules.detect_domain(real, numbers, concepts["dates"])
    made = {r["target"] for r in found if r["rule_type"] == "arithmetic"}
    base = rules.apply_arithmetic(synthetic, found)
    tables = {"baseline": synthetic}
    for t in thresholds:
        out = repair.match_marginals(real, base, [c for c in numbers if c not in made], [key], t)
        out = rules.apply_arithmetic(repair.match_categories(real, out, labels, [key]), found)
        tables[f"ks_{t:.2f}"] = repair.privacy_guard(real, out, [key])[0]
    rows = []
    for name, df in tables.items():
        quality = {r["metric"]: r["value"] for r in rules.quality_metrics(df).collect()}
        stat = compare.statistical_similarity(real, df).agg(F.avg("score")).first()[0]
        corr = compare.correlation_preservation(real, df, numbers).first()["overall_score"]
        exact = compare.exact_matches(real, df, [c for c in compare.common(real, df) if c != key]).first()["exact_match_rate"]
        late = quality.get("date_violation_rate")
        rows.append((name, stat, corr, quality["completeness"], rules.domain_validity(df, found).first()["validity"], 100.0 - (quality["duplicate_rate"] or 0.0), None if late is None else 100.0 - late, exact))
    scores = repair.candidate_scores(real.sparkSession.createDataFrame(rows, "candidate string, statistical double, correlation double, completeness double, domain_validity double, uniqueness double, chronology double, exact_match_rate double"))
    best = repair.best_candidate(scores).first()
    return tables[best["candidate"] if best else "baseline"], scores


def tuned(name: str, options: dict, attempt: int) -> dict:
    """The options for the next attempt: a new seed for the copula and, if a family was named, the closest of all; a looser guard against like texts for text providers."""
    out = dict(options)
    if name == "gaussian_copula":
        out["seed"] = out.get("seed", 42) + 13 * attempt
        if out.get("default_distribution", "best") != "best":
            out["default_distribution"] = "best"
    if "similarity" in out:
        out["similarity"] = min(0.95, round(out["similarity"] + 0.05, 2))
    return out


def autotune(real: DataFrame, key: str, rows: int, goal: float = 80.0, least_gain: float = 1.0, most: int = 3, name: str = "gaussian_copula", options: dict | None = None, score=None) -> tuple[DataFrame, list[dict]]:
    """(best table, attempts): generates again with tuned options until the score is good or gains little.

    ``score(real, made)`` is the mean statistical similarity by default. Each attempt says which
    metrics were weak.
    """
    body, attempts, best, last = real.drop(key), [], None, None
    options = dict(options or {})
    measure = score or (lambda r, m: compare.statistical_similarity(r, m).agg(F.avg("score")).first()[0] or 0.0)
    for i in range(1, most + 1):
        made = generate.generator(name, **options).fit(body).generate(real.sparkSession, rows)
        value = measure(body, made)
        weak = metadata.weak_metrics(real.sparkSession.createDataFrame([("statistical", float(value))], "metric string, score double")).select("metric").collect()
        attempts.append({"attempt": i, "options": dict(options), "score": value, "weak": [r["metric"] for r in weak]})
        if best is None or value > best[1]:
            best = (made, value)
        if value >= goal or (last is not None and value - last < least_gain):
            break
        options, last = tuned(name, options, i), value
    return best[0], attempts


def review(before: DataFrame, after: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """What got worse or is still below its target, from two results of ``evaluate``."""
    named = lambda df: df.select("metric", F.col("score").alias("value"))
    return metadata.insights(rules.metric_delta(named(before), named(after), ()), targets or metadata.WEAK)


def analyse_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, action, is_identifier) for every column, from its profile."""
    return profile.classify_columns(profile.classifier_input(df, exact))
