"""The corpus pipeline: every stage on odd rows, and against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from weftline.llm import langid, mixing, packing, toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)
CLASHES = ("size", "fp", "tie", "_tie", "words", "rows", "node", "slot", "_slot", "language", "toxicity", "score", "place", "target", "d", "k", "first")
TEXT = "the quick brown fox jumps over the lazy dog again and again and then it rests for a while under the old tree"
ROWS = [
    (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "der schnelle braune fuchs springt über den faulen hund und ruht sich aus", "de", "b"), (None, None, None, None),
    (4, "alpha beta gamma " * 20_000, "en", "a"), (5, "1234 !!! ...", "en", "c"), (6, TEXT + " now", "en", "c"), (7, TEXT, "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_takes_odd_rows(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    assert STAGES[name](spark, odd.limit(0), SF).collect() == []
    if name != "packing":
        assert out.columns == odd.columns
    got, given = ids(out), ids(odd)
    assert set(got) <= set(given)
    if name == "language_id":
        assert not got[2] and not got[3] and not got[5] and got[1] in (0, 2) and got[None] <= 1
    if name == "toxicity":
        assert got == given
    if name == "near_copies":  # the texts of 1, 6 (18 of 19 shingles) and 7; those of 2, 3 and one without an id
        assert got[1] == 1 and not got[6] and not got[7] and got[2] == 1 and not got[3] and got[None] == 1 and got[4] == 1 and got[5] == 1
    if name == "source_mix":
        assert got[2] == got[3] == 1 and got[None] >= 1 and got[1] in (0, 2, 4) and max(got.values()) <= 4
    if name == "packing":
        rows = out.collect()
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == given and sum(r["length"] for r in rows if r["doc_id"] in (2, 3)) == 2


def test_languages_by_plain_python(spark, docs):
    out = ids(STAGES["language_id"](spark, docs, SF))
    tagger = langid.train_tagger(docs)
    least = 1 / len(tagger.langs) + pipeline.ABOVE_CHANCE * (1 - 1 / len(tagger.langs)) - 1e-6
    want = Counter()
    for r in docs.collect():
        text = r["text"] or ""
        if any(c.isalpha() for c in text):
            sums = tagger.pooled([text])[0]
            want[r["doc_id"]] += bool(sums[:-1].max() / sums[-1] >= least)
    assert out == +want and sum(out.values()) > 0.9 * docs.count()


def test_toxicity_by_plain_python(spark, docs):
    out = ids(STAGES["toxicity"](spark, docs, SF))
    lexicon, model = toxicity.train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = Counter(r["doc_id"] for r in docs.collect() if model.score(np.array([toxicity.features(r["text"] or "", lexicon)]))[0] < pipeline.MAX_TOXICITY)
    assert out == want and sum(out.values()) > 0.8 * docs.count()


def test_near_copies_by_plain_python(spark, docs):
    grams = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        grams[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in grams}
    top = lambda i: i if root[i] == i else top(root[i])
    near = {}
    for a in grams:
        for b in grams:
            if a < b:
                union = len(grams[a] | grams[b])
                likeness = len(grams[a] & grams[b]) / union if union else 1.0
                near[b] = max(near.get(b, 0), likeness)
                near[a] = max(near.get(a, 0), likeness)
                if likeness >= 0.8 - 1e-9:
                    root[max(top(a), top(b))] = min(top(a), top(b))
    kept = set(ids(STAGES["near_copies"](spark, docs, SF)))
    want = {top(i) for i in grams}
    assert all(near[i] >= 0.75 for i in set(grams) - kept) and len(kept ^ want) <= 0.01 * len(grams)


def plain_mix(rows, block):
    """Copies of each document, slot by slot. rows: (doc_id, text, source)."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words(t) for _, t, o in rows if o == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, left = {}, set(sources)
    while left:  # share by weight; sources above twice their size get that, the others share anew
        rest = 1.5 * sum(size.values()) - sum(target.values())
        full = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 2 * size[s]]
        if not full:
            target |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
            break
        for s in full:
            target[s] = 2 * size[s]
            left.discard(s)
    want = {s: int(target[s]) for s in sources if target[s] >= 1}
    slots = {s: -(-n // block) for s, n in want.items()}
    total, edge, at = sum(slots.values()), {}, 0
    for s in want:
        edge[s] = (int(at / total * 2**40), int((at + slots[s]) / total * 2**40))
        at += slots[s]
    order = {s: sorted((hashlib.md5(f"{'' if i is None else i}|{s or ''}|{t or ''}".encode()).hexdigest(), i, words(t)) for i, t, o in rows if o == s) for s in sources}
    taken, rank = defaultdict(int), Counter()
    for slot in range(2 * total + 16):
        point = (slot + 1) * mixing.GOLDEN % 2**40
        for s, (low, high) in edge.items():
            if low <= point < high and rank[s] < slots[s]:
                a, b = rank[s] * block, min((rank[s] + 1) * block, want[s])
                rank[s] += 1
                start = 0
                for p in (0, 1):
                    start = p * size[s]
                    for _, i, n in order[s]:
                        taken[i, p] += max(0, min(b, start + n) - max(a, start))
                        start += n
    copies = Counter({i: 1 for i, t, _ in rows if not words(t)})
    for i, t, _ in rows:
        copies[i] += sum(taken[i, p] * 2 >= words(t) > 0 and taken[i, p] > 0 for p in (0, 1))
    return +copies


def test_mixing_by_plain_python(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert ids(STAGES["source_mix"](spark, docs, SF)) == plain_mix(rows, 1024)


def test_packing_by_plain_python(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    some = docs.filter("doc_id < 60")
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in STAGES["packing"](spark, some, SF).collect()}
    want = {}
    for r in some.collect():
        tokens = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        n, at, k = len(tokens), 0, 0
        while at < n:
            length = n % 2048 or 2048 if k == 0 and n > 2048 else min(2048, n - at)
            want[r["doc_id"], k] = (at, length, zlib.crc32(tokens[at : at + length].tobytes()))
            at, k = at + length, k + 1
    assert got == want


def test_run_is_its_stages(spark):
    """The rows of run() are packed from documents that every stage kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF)
    rows = out.collect()
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == ids(docs)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
