"""Every operator on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from weftline.llm import fingerprint, html_text, langid, licenses, mixing, packing, simhash, topk, toxicity, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("size", "fp", "tie", "_tie", "words", "rows", "place", "range", "label", "language", "toxicity", "score", "block", "target", "d", "k", "_copy", "y")
LONG = "alpha beta gamma " * 20_000

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "der schnelle braune fuchs springt über den faulen hund", "de", "b", 5),
    (None, None, None, None, None),
    (4, LONG, "en", "a", len(LONG)),
    (5, "1234 !!! ...", "en", "c", 3),
    (6, "  \n\t ", "en", "c", 3),
    (7, "Released under the MIT License.", "en", "c", 31),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOC)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, None, 1), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


PAGES = [(1, "http://A.example.org/en/5?x", "<p>Some words here for the reader to read in full today.</p>"), (1, "http://A.example.org/en/5?x", "<p>Some words here for the reader to read in full today.</p>"), (2, None, None), (None, "no scheme", ""), (4, "http://", "<" * 5000), (5, "://x/y", "<div class='a")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "shape", "template", "n", "text", "segments")})


def both(df, run):
    """The result over the rows and over no rows."""
    none = run(df.limit(0)).collect()
    assert none == []
    return run(df).collect()


def test_toxicity(docs, labels):
    rows = both(docs, lambda d: toxicity.toxicity_report(d, labels))
    assert len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert toxicity.toxicity_report(docs, labels.limit(0)).filter("score <> 0").count() == 0


def test_licenses(docs):
    rows = both(docs, licenses.scan_licenses)
    assert len(rows) == len(ROWS)
    found = [r for r in rows if r["doc_id"] == 7][0]
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == (5, 1, 1, 1, "mit")
    assert [r["n_words"] for r in rows if r["doc_id"] == 2] == [0]
    assert [r["n_words"] for r in rows if r["doc_id"] == 4] == [60_000]


def test_language(docs):
    rows = both(docs, langid.language_report)
    assert len(rows) == len(ROWS)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 5, 6)} == {"und"}
    assert all(r["lang_pred"] == "und" for r in langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_mixing(docs):
    rows = both(docs, mixing.mix_report)
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    again = mixing.mix_report(docs.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    copies = both(docs, mixing.mixed_documents)
    assert copies and copies[0].asDict().keys() == set(docs.columns)


def test_fingerprints(docs):
    rows = both(docs, fingerprint.fingerprint_edits)
    assert len(rows) == len(ROWS)
    twins = [r for r in rows if r["doc_id"] == 1]
    assert twins[0]["fingerprint"] == twins[1]["fingerprint"] and max(r["near_next"] for r in twins) == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_urls(pages):
    rows = both(pages, urls.judge_urls)
    assert len(rows) == len(PAGES)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows if r["page_id"] == 1] == [("a.example.org", "/en/5", "org/", "allow")] * 2
    assert [(r["host"], r["path"], r["rule"]) for r in rows if r["page_id"] in (None, 2)] == [("", "", None)] * 2
    assert all(r["verdict"] in ("allow", "block") for r in rows)


def test_packing(docs):
    rows = both(docs, packing.pack_documents)
    assert len({(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] == 4}) == 1 + (sum(r["length"] for r in rows if r["doc_id"] == 4) - 1) // 2048
    assert sorted(r["length"] for r in rows if r["doc_id"] in (2, 3)) == [1, 1]


def test_html(pages):
    rows = both(pages, html_text.extract_main_text)
    assert len(rows) == len(PAGES)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["text"] for r in rows if r["page_id"] in (2, None)} == {""}


def test_topk(spark):
    v = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (1, [None, 1.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [2.0, 2.0]), (6, [2.0, 2.0]), (7, []), (8, [1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("grp", "row", "side", "vector", "score", "rank", "floor")})
    rows = both(df, topk.top_k)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows)
    unit = 1024 * 1024
    one = [(0, 1, 5, 6 * unit), (0, 2, 6, 6 * unit), (0, 3, 0, 5 * unit)]
    assert found == sorted(one * 2)


def test_simhash(docs):
    rows = both(docs, simhash.simhash_components)
    assert len(rows) == len(ROWS)
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in zero} == {2} and len(zero) == 4
    kept = both(docs, simhash.near_dedup)
    assert sum(r["doc_id"] == 1 for r in kept) == 1
    assert kept[0].asDict().keys() == set(docs.columns)
