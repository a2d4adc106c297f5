"""Text quality of a synthetic column against a real one."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import exprs, words


def filled(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(F.col(column).cast("string")).alias("text")).filter("text is not null and text <> ''")


def duplicate_rate(df: DataFrame, column: str) -> DataFrame:
    """(rows, distinct_rows, duplicate_rate)"""
    counts = filled(df, column).groupBy("text").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return counts.withColumn("duplicate_rate", F.round(F.coalesce(exprs.divide(F.col("rows") - F.col("distinct_rows"), "rows"), F.lit(0.0)), 6))


def verbatim_rate(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(rows, verbatim, originality): synthetic texts that the real column holds, whatever their case."""
    known = filled(real, column).select(F.xxhash64(F.lower("text")).alias("h"), F.lower("text").alias("known")).distinct()
    own = filled(synthetic, column).select(F.xxhash64(F.lower("text")).alias("h"), F.lower("text").alias("text"))
    joined = own.join(known, ["h"], "left").withColumn("hit", (F.col("text") == F.col("known")).cast("int"))
    return joined.agg(F.count("*").alias("rows"), F.count(F.when(F.col("hit") == 1, 1)).alias("verbatim")).withColumn("originality", F.round(F.coalesce(1 - exprs.divide("verbatim", "rows"), F.lit(1.0)), 6))


def length_similarity(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(real_chars, synthetic_chars, real_words, synthetic_words, length_score)"""
    part = lambda df, name: filled(df, column).agg(F.avg(F.length("text")).alias(f"{name}_chars"), F.avg(exprs.word_total("text")).alias(f"{name}_words"), F.lit(1).alias("one"))
    both = part(real, "real").join(part(synthetic, "synthetic"), "one")
    score = 100 * (1 - F.least(F.abs(F.col("real_chars") - F.col("synthetic_chars")) / F.greatest(F.col("real_chars"), F.lit(1.0)), F.lit(1.0)))
    return both.select(*(F.round(c, 4).alias(c) for c in ("real_chars", "synthetic_chars", "real_words", "synthetic_words")), F.round(score, 4).alias("length_score"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    return filled(df, column).select(F.explode(exprs.letter_tokens("text")).alias("token"))


def vocabulary_overlap(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(shared, total, jaccard, lexical_diversity) over tokens of three letters and more."""
    tag = lambda df, a, b: vocabulary(df, column).groupBy("token").agg(F.count("*").alias("n")).select("token", F.lit(a).alias("r"), F.lit(b).alias("s"), F.when(F.lit(b == 1), F.col("n")).otherwise(0).alias("n"))
    sides = tag(real, 1, 0).unionByName(tag(synthetic, 0, 1)).groupBy("token").agg(F.max("r").alias("r"), F.max("s").alias("s"), F.sum("n").alias("n"))
    sums = sides.agg(F.coalesce(F.sum(F.col("r") * F.col("s")), F.lit(0)).cast("long").alias("shared"), F.count("*").alias("total"), F.sum("s").alias("types"), F.sum("n").alias("tokens"))
    return sums.select("shared", "total", F.round(F.coalesce(exprs.divide("shared", "total"), F.lit(0.0)), 6).alias("jaccard"), F.round(F.coalesce(exprs.divide("types", "tokens"), F.lit(0.0)), 6).alias("lexical_diversity"))


def near_duplicates(df: DataFrame, column: str, key: str, most: int = 50, least: float = 0.85) -> DataFrame:
    """(rows, near_duplicates, near_duplicate_rate) among the first ``most`` texts, a fixed sample by contract."""
    rows = df.filter(F.trim(F.col(column)) != "").select(F.col(key).alias("key"), F.trim(F.col(column)).alias("text"))
    head = rows.orderBy("key", "text").limit(most).agg(F.collect_list(F.struct("key", "text")).alias("items"))

    @F.pandas_udf("long")
    def later_twins(groups: pd.Series) -> pd.Series:
        def count(items) -> int:
            texts = [i["text"] for i in sorted(items, key=lambda i: (i["key"] is not None, i["key"], i["text"]))]
            twin = lambda i: any(SequenceMatcher(None, texts[i], t).ratio() >= least for t in texts[i + 1 :])
            return sum(map(twin, range(len(texts))))

        return groups.map(count)

    out = head.select(F.size("items").cast("long").alias("rows"), later_twins("items").alias("near_duplicates"))
    return out.withColumn("near_duplicate_rate", F.round(F.coalesce(exprs.divide("near_duplicates", "rows"), F.lit(0.0)), 6))


def sentiment_fits(text: Column, label: Column) -> Column:
    """False where a positive label meets only negative phrases, or the reverse, or the text is blank."""
    up = exprs.has_phrase(text, words.POSITIVE + words.MORE_POSITIVE)
    down = exprs.has_phrase(text, words.STRONG_NEGATIVE + words.MORE_NEGATIVE)
    name = F.lower(F.trim(label.cast("string")))
    fits = F.when(name.isin(*words.POSITIVE_LABELS), ~(down & ~up)).when(name.isin(*words.NEGATIVE_LABELS), ~(up & ~down)).otherwise(True)
    return F.when(F.coalesce(F.trim(text) == "", F.lit(True)), False).otherwise(fits)


def rating_fits(text: Column, rating: Column, complaint_column: bool = False) -> Column:
    """Whether a text's phrases suit a rating from 1 to 5."""
    bad, mild, good = exprs.has_phrase(text, words.STRONG_NEGATIVE), exprs.has_phrase(text, words.MILD_ISSUE), exprs.has_phrase(text, words.POSITIVE)
    fits = (
        F.when(rating == 1, bad)
        .when(rating == 2, bad | mild)
        .when(rating == 3, bad == good)
        .when(rating == 4, ~bad & ((good | mild) if complaint_column else good))
        .when(rating == 5, ~bad & (mild if complaint_column else good))
        .otherwise(True)
    )
    return F.when(F.coalesce(F.trim(text) == "", F.lit(True)), False).otherwise(fits)


def semantic_rate(df: DataFrame, column: str) -> DataFrame | None:
    """(semantic_rate) by the table's sentiment column, else by its rating column; None without either."""
    names = {c.lower(): c for c in df.columns}
    for k in words.SENTIMENT_NAMES:
        if k in names:
            return df.agg(F.round(F.avg(sentiment_fits(F.col(column), F.col(names[k])).cast("int")), 6).alias("semantic_rate"))
    for k in words.RATING_NAMES:
        if k in names:
            complaint = any(w in column.lower() for w in words.COMPLAINT_PARTS)
            return df.agg(F.round(F.avg(rating_fits(F.col(column), F.col(names[k]).try_cast("int"), complaint).cast("int")), 6).alias("semantic_rate"))
    return None


def text_quality(real: DataFrame, synthetic: DataFrame, column: str, key: str | None = None) -> dict[str, float]:
    """The column's measures and, of those that count, the mean, ``score``.

    Near duplicates (of a fixed sample by ``key``, or by the text itself) and lexical diversity
    are reported beside it.
    """
    words_of = vocabulary_overlap(real, synthetic, column).first()
    twins = near_duplicates(synthetic, column, key or column).first()
    beside = {"near_duplicate_rate": twins["near_duplicate_rate"], "lexical_diversity": words_of["lexical_diversity"]}
    out = {
        "uniqueness": 100 * (1 - duplicate_rate(synthetic, column).first()["duplicate_rate"]),
        "originality": 100 * verbatim_rate(real, synthetic, column).first()["originality"],
        "length": length_similarity(real, synthetic, column).first()["length_score"] or 0.0,
        "vocabulary": 100 * words_of["jaccard"],
    }
    if (rate := semantic_rate(synthetic, column)) is not None:
        out["semantic"] = 100 * (rate.first()["semantic_rate"] or 0.0)
    return {**out, **beside, "score": round(sum(out.values()) / len(out), 4)}


#: Phrases that an unsuitable generated text starts with or consists of.
CHATTER = r"(?i)^\s*(here (is|are)|sure[,!]|certainly[,!]|as an ai|i (can|will|cannot)\b)"
PLACEHOLDER = r"(?i)^\s*(n/?a|none|null|text|string|placeholder|lorem ipsum.*|example|\.{3,}|\[.*\]|<.*>)\s*$"


def clean_generated(c: Column) -> Column:
    """Generated text without quotes and fences; null where it is a placeholder, chatter or a JSON fragment."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"^```\w*|```$", ""), r"^[\"'\s]+|[\"'\s]+$", ""))
    return F.when((t == "") | t.rlike(PLACEHOLDER) | t.rlike(CHATTER) | t.rlike(r"^[\[{]|[\]}]$"), None).otherwise(t)


def json_part(c: Column) -> Column:
    """The JSON in an answer: without fences, from its first bracket to the last one of the kind."""
    t = F.trim(F.regexp_replace(c, r"(?m)^\s*```\w*\s*$|```", ""))
    array, whole = F.regexp_extract(t, r"(?s)\[.*\]", 0), F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(t.startswith("{") & ~t.contains("["), whole).when(array != "", array).otherwise(F.when(whole != "", whole))


def answer_records(c: Column) -> Column:
    """An answer's records as array of (number, text); plain strings have no number, what is no JSON has no records."""
    fields = ", ".join(f"`{k}`: string" for k in words.NUMBER_KEYS + words.TEXT_KEYS)
    part = json_part(c)
    records = F.from_json(part, f"array<struct<{fields}>>")
    strings = F.from_json(part, "array<string>")
    first = lambda x, keys: F.coalesce(*(F.nullif(F.trim(x[k]), F.lit("")) for k in keys))
    numbered = F.transform(records, lambda x: F.struct(first(x, words.NUMBER_KEYS).try_cast("long").alias("number"), clean_generated(first(x, words.TEXT_KEYS)).alias("text")))
    plain = F.transform(strings, lambda x: F.struct(F.lit(None).cast("long").alias("number"), clean_generated(x).alias("text")))
    of_objects = part.rlike(r"(?s)^\[\s*\{")
    return F.filter(F.when(of_objects, numbered).otherwise(plain), lambda x: x["text"].isNotNull())


def answers_by_id(df: DataFrame, answer: str, ids: str) -> DataFrame:
    """(id, text): what an answer says for the numbers asked for in ``ids`` (array of long).

    Records count by their number; if none of the numbers was asked for, they count from 0 in
    the order of ``ids``; plain strings come in that order as well. The last record of a
    number stands.
    """
    rows = df.select(F.col(ids).alias("ids"), answer_records(F.col(answer)).alias("r"))
    known = F.map_from_entries(F.transform(F.array_distinct(F.transform("r", lambda x: x["number"])), lambda n: F.struct(n, F.element_at(F.filter("r", lambda x: x["number"] == n), -1)["text"])))
    numbered = rows.filter(F.exists("r", lambda x: x["number"].isNotNull())).withColumn("r", F.filter("r", lambda x: x["number"].isNotNull())).withColumn("known", known)
    asked = F.transform("ids", lambda i: F.struct(i.alias("id"), F.try_element_at("known", i).alias("text")))
    relative = F.transform("ids", lambda i, at: F.struct(i.alias("id"), F.try_element_at("known", at.cast("long")).alias("text")))
    hit = F.exists("ids", lambda i: F.map_contains_key("known", i))
    one = numbered.select(F.explode(F.when(hit, asked).otherwise(relative)).alias("x"))
    plain = rows.filter(~F.exists("r", lambda x: x["number"].isNotNull())).select(F.explode(F.transform("ids", lambda i, at: F.struct(i.alias("id"), F.get("r", at)["text"].alias("text")))).alias("x"))
    return one.unionByName(plain).select("x.id", "x.text").filter("text is not null")


def answer_lines(c: Column) -> Column:
    """The texts of an answer: its JSON values, else its lines without bullets and numbers; broken JSON gives none."""
    t = F.trim(F.regexp_replace(c, r"(?m)^\s*```\w*\s*$|```", ""))
    lines = F.transform(F.split(t, r"\r?\n"), lambda x: clean_generated(F.regexp_replace(F.trim(x), r"^(\d+[.):]|[-*\u2022])\s*|,$", "")))
    broken = t.rlike(r"(?is)^\s*[\[{]") | t.rlike(r"(?i)[\"']text[\"']\s*:")
    values = F.transform(answer_records(c), lambda x: x["text"])
    return F.when(F.size(values) > 0, values).when(broken, F.array().cast("array<string>")).otherwise(F.filter(lines, lambda x: x.isNotNull()))
