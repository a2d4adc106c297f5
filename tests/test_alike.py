"""The guard against like texts against every pair."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.operators import alike, generate

WORDS = ["straße", "red", "Blue", "widget", "late", "order", "broken", "seal", "x", "to", "the", "a", "good"]


def edited(pick, text):
    letters = list(text or "")
    for _ in range(pick.randint(0, 1 + len(letters) // 8)):
        at = pick.randint(0, len(letters))
        if pick.random() < 0.4:
            letters.insert(at, pick.choice("abcXYZ "))
        elif letters:
            letters.pop(min(at, len(letters) - 1))
    return "".join(letters)


def plain(text, sources, threshold):
    text = (text or "").strip().casefold()
    known = [s.strip().casefold() for s in sources if s and s.strip()]
    return not text or text in known or (threshold > 0 and any(SequenceMatcher(None, text, s).ratio() >= threshold for s in known))


@pytest.mark.parametrize("threshold", [0.97, 0.92, 0.8, 0])
def test_guard_is_every_pair(spark, threshold):
    pick = random.Random(11)
    sources = [" ".join(pick.choice(WORDS) for _ in range(pick.randint(0, 45))) for _ in range(70)] + [None, "", " ", "ab", "abc"]
    texts = [edited(pick, pick.choice(sources)) for _ in range(140)] + ["new text", None, "", "  ", "AB", "ABC"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("id", F.lit("clash"))
    got = {r["k"]: r["too_similar"] for r in alike.too_similar(df, "t", spark.createDataFrame([(s,) for s in sources], "s string"), "s", threshold).collect()}
    assert got == {i: plain(t, sources, threshold) for i, t in enumerate(texts)}


def test_known_sentences(spark):
    sources = spark.createDataFrame([("The product did not work well.",)], "t string")
    df = spark.createDataFrame([(1, "The product did not work well."), (2, "the product did not work well"), (3, "Delivery was late and the seal was broken.")], "k int, t string")
    assert {r["k"]: r["too_similar"] for r in alike.too_similar(df, "t", sources).collect()} == {1: True, 2: True, 3: False}
    assert alike.too_similar(df.limit(0), "t", sources).count() == 0
    assert alike.too_similar(df, "t", sources.limit(0)).filter("too_similar").count() == 0


def test_near_copies_are_asked_for_again(spark):
    real = spark.createDataFrame([(f"A long and plain remark about order number {i}.",) for i in range(40)], "note string")
    asked = spark.sparkContext.accumulator(0)

    def provider(numbers, examples):
        asked.add(len(numbers))
        import json

        return json.dumps([{"id": n, "text": f"A long and plain remark about order number {n}!" if n % 2 else f"{'wholly other words ' * 2}{n * 7919}"} for n in numbers])

    made = [r["note"] for r in generate.ProvidedText("note", provider, retries=2, similarity=0.92).fit(real).generate(spark, 20).collect()]
    assert len(made) == 20 and not any(m.endswith("!") for m in made)
    assert asked.value >= 30
    loose = [r["note"] for r in generate.ProvidedText("note", provider, retries=1, similarity=1.0).fit(real).generate(spark, 20).collect()]
    assert sum(m.endswith("!") for m in loose) == 10


def test_common_passages_bring_no_cell_more_than_its_rows(spark, monkeypatch):
    """Texts of one length that share passages: cells have a bound, results stay those of every pair."""
    monkeypatch.setattr(alike, "CELL_ROWS", 16)
    pick, cells, large = random.Random(5), spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    hits = alike.first_hits

    def watched(texts, sources, threshold):
        cells.add(1)
        large.add(int(max(len(texts), len(sources)) > 64))
        return hits(texts, sources, threshold)

    monkeypatch.setattr(alike, "first_hits", watched)
    sources = [" ".join(["the same passage of many texts", *(pick.choice(WORDS) for _ in range(6))]) for _ in range(150)]
    texts = [edited(pick, pick.choice(sources)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r["k"]: r["too_similar"] for r in alike.too_similar(df, "t", spark.createDataFrame([(s,) for s in sources], "s string"), "s").collect()}
    assert got == {i: plain(t, sources, 0.92) for i, t in enumerate(texts)} and cells.value > 20 and not large.value
