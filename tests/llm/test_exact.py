"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import fingerprint, html_text, langid, licenses, mixing, packing, simhash, topk, toxicity, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(fps, bits):
    ids, parent = list(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_is_brute_force(docs, texts):
    fps = {i: plain_simhash(t) for i, t in texts.items()}
    whole = closure(fps, 4)
    rows = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == fps
    assert {i: r["component_id"] for i, r in rows.items()} == whole


def test_links_of_crowded_segments(spark):
    """Chains of near fingerprints that share whole segments, with tiles so small that all ways of splitting run."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    for b in base:
        for _ in range(60):
            fps.add(b)
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                b ^= 1 << bit
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    for tile in (8, 2048):
        found = {r["u"]: r["root"] for r in simhash.components(simhash.near_links(df, 4, tile)).collect()}
        want = closure({s[0]: s[0] & (2**64 - 1) for s in signed}, 4)
        groups = lambda m: {frozenset(v) for v in m.values()}
        a, b = defaultdict(set), defaultdict(set)
        for s in signed:
            a[found.get(s[0], s[0])].add(s[0])
            b[want[s[0]]].add(s[0])
        assert groups(a) == groups(b)


def test_near_dedup_finds_copies_and_keeps_the_rest(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(900)]
    plain = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    rows = list(enumerate(plain))
    for i, t in enumerate(plain[:20]):
        w = t.split()
        w[rng.randrange(200)] = "other"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, t))
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(60))


def test_near_dedup_tells_short_texts_apart(spark):
    """Thousands of different texts of 1 to 5 words stay; copies in other letter case go."""
    rng = random.Random(11)
    short = set()
    while len(short) < 4000:
        short.add(" ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(rng.randint(1, 5))))
    short = sorted(short)
    rows = list(enumerate(short)) + [(10_000 + i, t.upper()) for i, t in enumerate(short[:300])]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(4000))


def test_near_dedup_of_small_sets_is_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for base in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 24))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(3):
            v = list(w)
            if rng.random() < 0.5:
                v += [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 2))]
            else:
                v = v[rng.randint(0, 2) :]
            rows.append((len(rows), " ".join(v)))
    grams = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(max(1, len(w) - 4))} if t else set() for i, t in rows}
    root = {i: i for i in grams}
    top = lambda i: i if root[i] == i else top(root[i])
    for i in grams:
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {top(i) for i in grams}


def jaccard(a, b, shingle=5):
    grams = lambda t: {tuple(w[j : j + shingle]) for w in [t.split()] for j in range(max(1, len(w) - shingle + 1))}
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_near_dedup_drops_nothing_below_its_likeness(spark):
    """Copies with 1 to 12 changed words of 120: likeness between 0.96 and 0.4."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(160):
        w = rng.choices(vocab, k=120)
        v = list(w)
        for at in rng.sample(range(120), rng.randint(1, 12)):
            v[at] = "x" + v[at]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    likeness = {i + 1: jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)}
    dropped = {i: x for i, x in likeness.items() if i not in kept}
    assert kept >= {i for i, _ in rows if i % 2 == 0} and min(dropped.values()) >= 0.75
    clear = [i for i, x in likeness.items() if x >= 0.8]
    assert len(clear) > 20 and sum(i in dropped for i in clear) >= 0.98 * len(clear) - 1


def test_forest_connects_what_its_edges_up_to_any_distance_do():
    rng = np.random.default_rng(3)
    for n, e in ((2, 1), (30, 60), (200, 3000)):
        a = rng.integers(0, n, e)
        b = (a + 1 + rng.integers(0, n - 1, e)) % n
        d = rng.integers(0, 12, e)
        at = simhash.forest(n, a, b, d)
        assert len(at) <= n - 1
        for limit in range(13):
            whole, part = d <= limit, at[d[at] <= limit]
            assert np.array_equal(simhash.stars(n, a[whole], b[whole]), simhash.stars(n, a[part], b[part]))


def test_large_groups_of_near_copies_are_tiled(spark):
    """One family whose fingerprints share most segments, in tiles of 16 rows."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(400)] = f"y{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(400)) for _ in range(20)]
    marks = simhash.near_marks(texts, 5, 0.8)
    nodes = spark.createDataFrame([(int(a), None if b is None else bytes(b), None if c is None else bytes(c)) for a, b, c in marks.itertuples(index=False)], "node long, few binary, wide binary")
    roots = {r["u"]: r["root"] for r in simhash.components(simhash.wide_links(nodes, 0.8, 170, tile=16)).collect()}
    ids = marks["node"].tolist()
    assert len({roots.get(i, i) for i in ids[:150]}) == 1 and len({roots.get(i, i) for i in ids}) == 21


def test_lookups_of_large_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.when(F.min("k") != 4000, F.min("k")).alias("v"))
    out = simhash.looked_up(rows, found, "k", "v", hub=100).collect()
    assert {r["id"]: r["v"] for r in out} == {i: 0 if i < 4000 else None if i == 4000 else i for i in range(5000)}
    assert len(out) == 5000


@pytest.mark.parametrize("rows", [10_000, 1_000_000, 4_194_304, 4_300_000, 13_000_000, 17_000_000, 100_000_000, 1_000_000_000])
def test_near_copy_index_has_all_segments(rows):
    cuts = simhash.wide_segments(rows, 0.8)
    p = np.arccos(1.6 / 1.8) / np.pi
    assert 1 - (1 - (1 - p) ** cuts.shape[1]) ** len(cuts) >= 0.98
    assert all(len(set(c)) == cuts.shape[1] for c in cuts.tolist()) and len({frozenset(c) for c in cuts.tolist()}) == len(cuts)
    assert cuts.min() >= 0 and cuts.max() < simhash.WIDE_BITS


def test_fingerprints_follow_the_texts(docs, texts):
    order = sorted(texts)
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(docs, range_chars=40_000).collect()}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    gaps = []
    for i, following in zip(order, order[1:] + order[:1]):
        t, n = texts[i], texts[following]
        cut = len(t) - len(t) // 4
        edited = t[:cut] + n[: len(t) // 4]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.encode(fingerprint.sketch_text(t)) and r["edited_fingerprint"] == fingerprint.encode(fingerprint.sketch_text(edited))
        a, b = grams(t), grams(edited)
        gaps.append(abs(r["near_edited"] - len(a & b) / max(1, len(a | b))))
    assert np.mean(gaps) < 0.03 and max(gaps) < 0.2


def test_fingerprints_of_one_hot_id(spark):
    """Most rows have no id: they are cut into tasks by the hash of their texts and still meet their next."""
    rng = random.Random(4)
    rows = [(None if i % 4 else i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    order = sorted(df.collect(), key=lambda r: (-(2**63) if r["doc_id"] is None else r["doc_id"], r["tie"]))
    found = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.fingerprint_edits(df, range_chars=5_000).collect())
    want = Counter()
    for r, following in zip(order, order[1:] + order[:1]):
        t, n = r["text"], following["text"]
        want[r["doc_id"], len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()] += 1
    assert found == want


def test_ranges_of_long_texts_are_even(spark):
    """Long documents stand together at the end of the ids."""
    slim = spark.range(20_000).select(F.col("id").alias("place"), F.when(F.col("id") >= 19_500, 60_000).otherwise(500).cast("long").alias("chars"))
    chars = slim.agg(F.sum("chars")).first()[0]
    bounds, parts = fingerprint.text_ranges(slim, 20_000, chars, chars // 40)
    sums = slim.groupBy(F.expr(" + ".join(f"int(place >= {b})" for b in bounds)).alias("r")).agg(F.sum("chars").alias("n")).collect()
    assert set(parts) == {1} and len(bounds) >= 40 and max(r["n"] for r in sums) < 2 * chars / 40


def test_every_range_has_its_task(spark):
    df = spark.range(1)
    for tasks in (1, 7, 35, 300):
        keys = fingerprint.task_keys(df, tasks)
        got = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(tasks)).alias("t")).collect()
        assert [r["t"] for r in got] == list(range(tasks))


def test_no_task_gets_two_ranges(spark):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20).alias("text"))
    out = fingerprint.fingerprint_edits(rows, range_chars=5_000).select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert max(Counter(r["p"] for r in out).values()) <= 600 / 20


def test_long_texts_are_sketched_in_parts():
    words = fingerprint.word_hashes([f"w{i * 7 % 90_001}" for i in range(130_000)])
    assert np.array_equal(fingerprint.sketch_words(words), fingerprint.bottom(fingerprint.shingle_hashes(words)))


def test_sketches_merge():
    words = [f"w{i}" for i in range(4000)]
    whole = fingerprint.sketch_text(" ".join(words))
    parts = fingerprint.merge(fingerprint.sketch_text(" ".join(words[:2004])), fingerprint.sketch_text(" ".join(words[2000:])))
    assert np.array_equal(whole, parts)
    assert abs(fingerprint.distinct_count(whole) / 3996 - 1) < 0.3
    half = fingerprint.sketch_text(" ".join(words[:2000]))
    assert fingerprint.containment(half, whole) > 0.8 > fingerprint.containment(whole, half)
    assert np.array_equal(fingerprint.decode(fingerprint.encode(whole)), whole)


def test_packing_is_a_partition(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, block_pieces=64).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids) and (len(ids) > 2048 or len(by_doc[i]) == 1)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 5


def test_local_search_empties_bins():
    rng = random.Random(1)
    for n in (2, 5, 40, 300):
        lengths = [rng.randint(1, 2047) for _ in range(n)]
        bins = packing.improve([[i] for i in range(n)], lengths, 2048)
        assert sorted(p for b in bins for p in b) == list(range(n)) and all(sum(lengths[p] for p in b) <= 2048 for b in bins)
        assert len(bins) <= len(packing.best_fit(lengths, 2048)) * 1.15 + 1


def least_bins(lengths, size):
    """Lower bound of Martello and Toth."""
    best = 0
    for k in range(size // 2 + 1):
        large, middle = sum(x > size - k for x in lengths), [x for x in lengths if size / 2 < x <= size - k]
        small = sum(x for x in lengths if k <= x <= size / 2)
        best = max(best, large + len(middle) + max(0, -(-(small - len(middle) * size + sum(middle)) // size)))
    return best


def test_local_search_against_bounds():
    rng = random.Random(1)
    uniform, middle = [rng.randint(1, 255) for _ in range(1000)], [rng.randint(70, 140) for _ in range(1000)]
    assert len(packing.improve(packing.best_fit(uniform, 256), uniform, 256)) == least_bins(uniform, 256)
    best_fit = packing.best_fit(middle, 256)
    assert len(packing.improve(best_fit, middle, 256)) < len(best_fit)
    alone = packing.improve([[i] for i in range(len(middle))], middle, 256)
    assert len(alone) <= len(best_fit)


def test_tokens_of_special_strings_and_odd_white_space():
    from tokenizers import Tokenizer

    tok, chunks = Tokenizer.from_file(packing.default_tokenizer()), packing.Chunks(packing.default_tokenizer())
    texts = ["a <|endoftext|>b", "<|endoftext|>", " x<|endoftext|> \n y", "<|endof text|>", "a\u3000b  c\t\td \n\n e", "", " "]
    assert [np.frombuffer(b, "<u4").tolist() for b in chunks.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 0.3, (700, 12)).astype(np.float32)
    m[50:80] = m[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    rows = topk.top_k(df, every=50, block_rows=16, group_rows=150, query_rows=4).collect()
    w = np.floor(1024 * m.astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, 700, 50):
        s = w @ w[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        want |= {(q, k + 1, i, int(s[i])) for k, i in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows} == want


def test_topk_of_clusters_and_one_hot_id(spark):
    """Groups out of reach get no query; rows of one id are dealt over groups; two lengths of vectors."""
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.normal(c, 0.05, (120, 8)) for c in (-2, 0, 2, 5)]).astype(np.float32)
    rows = [(i if i < 240 else 300, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, v[:3].tolist()) for i, v in enumerate(m[::7])]
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=60, block_rows=8, group_rows=40, query_rows=3).collect())
    want = Counter()
    w = [np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) for _, v in rows]
    for i, (q, _) in enumerate(rows):
        if q % 60 == 0:
            scored = sorted((-int(w[i] @ w[j]), rows[j][0]) for j in range(len(rows)) if j != i and len(w[j]) == len(w[i]))[:10]
            want.update((q, rank + 1, v, -s) for rank, (s, v) in enumerate(scored))
    assert got == want


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mix_report(docs, block=64).collect()
    taken, target, total = Counter(), {}, sum(r["size"] for r in rows)
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    assert all(taken[s] == int(target[s]) for s in target)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total


def test_schedule_is_of_low_discrepancy(docs):
    _, targets, slots = mixing.mix_plan(docs, block=64)
    share = {r["source"]: r["target"] for r in targets.collect()}
    order = [r["source"] for r in slots.orderBy("slot").collect()]
    whole = sum(share.values())
    for s in list(share)[:5]:
        half = order[: len(order) // 2].count(s)
        assert abs(half - share[s] / whole * (len(order) // 2)) <= 4


def test_another_sequence_is_another_mix(spark, docs):
    of = lambda sequence: {r["doc_id"]: r for r in mixing.mix_report(docs, block=64, sequence=sequence).collect()}
    golden, other = of("golden"), of("van_der_corput")
    assert sum(golden[i]["taken"] for i in golden) == sum(other[i]["taken"] for i in other)
    assert sum(golden[i]["first_slot"] != other[i]["first_slot"] for i in golden) > len(golden) / 2
    order = lambda sequence: [r["doc_id"] for r in mixing.mixed_documents(docs, block=64, sequence=sequence).collect()]
    assert sorted(order("golden")) == sorted(order("van_der_corput")) and order("golden") != order("van_der_corput")


def test_a_sequence_that_stands_still_serves_one_source(docs, monkeypatch):
    monkeypatch.setitem(mixing.SEQUENCES, "still", (lambda slot: F.lit(0).cast("long"), 2))
    rows = mixing.mix_report(docs, block=64, sequence="still").collect()
    assert len({r["source"] for r in rows if r["taken"]}) == 1


def test_mixed_rows_stand_in_slot_order(docs):
    first = {r["doc_id"]: r["first_slot"] for r in mixing.mix_report(docs, block=64).collect()}
    order = [r["doc_id"] for r in mixing.mixed_documents(docs, block=64).collect()]
    seen, places = set(), []
    for i in order:
        if i not in seen and first[i] is not None:
            places.append(first[i])
        seen.add(i)
    steps = np.diff(places)
    assert np.mean(steps >= -64) > 0.9  # a document's copy may begin a block or two behind its first words


def test_every_source_gets_its_ranks(spark):
    """One word to half of all, in whatever order: the slots reach each source's target."""
    rng = random.Random(6)
    for sequence in mixing.SEQUENCES:
        rows = [(f"s{i:03}", 10_000, float(rng.choice([1, 2, 5, 64, 65, 1000, 30_000]))) for i in range(300)]
        targets = spark.createDataFrame(rows, "source string, source_size long, target double")
        got = Counter()
        for r in mixing.schedule(targets, 64, sequence).collect():
            got[r["source"]] += r["end"] - r["begin"]
        assert got == {s: int(t) for s, _, t in rows}


def test_points_are_exact_far_out(spark):
    slots = [0, 1, 2**20 - 1, 2**20, 10**9, 3 * 10**12]
    got = spark.createDataFrame([(i,) for i in slots], "slot long").select(mixing.golden_points(F.col("slot")).alias("p"), mixing.van_der_corput_points(F.col("slot")).alias("v")).collect()
    assert [r["p"] for r in got] == [(i + 1) * mixing.GOLDEN % 2**40 for i in slots]
    assert [r["v"] for r in got[:4]] == [int(f"{i:040b}"[::-1], 2) for i in slots[:4]]


def test_prefix_sums_in_levels(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(9)) for k in ("a", None) for i in sorted(rng.sample(range(1000), 300))]
    got = {(r["k"], r["i"]): r["base"] for r in mixing.with_base(spark.createDataFrame(rows, "k string, i long, n long"), ["k"], "i", "n", 1000, fan=7).collect()}
    assert got == {(k, i): sum(n for x, j, n in rows if x == k and j < i) for k, i, _ in rows}


def test_equal_rows_are_placed_once(spark):
    df = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    rows = mixing.mix_report(df.unionByName(spark.createDataFrame([(1, "x y", "b")], df.schema)), block=64).collect()
    taken = Counter((r["source"], r["taken"]) for r in rows)
    assert len(rows) == 9001 and sum(s * n for (_, s), n in taken.items()) == sum({r["source"]: int(r["target"]) for r in rows}.values())


def plain_votes(words, places, text):
    """Voting pairs of a template that a text has in their order: the longest common subsequence."""
    held = np.array([hash(x) for x in zip(text, text[1:])])
    best = np.zeros(len(held) + 1, np.int64)
    for i in places:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (held == hash((words[i], words[i + 1])))))
    return int(best[-1])


def edits(w):
    yield w
    for i in range(len(w) + 1):
        yield w[:i] + ["zzz"] + w[i:]
    for i in range(len(w)):
        yield w[:i] + w[i + 1 :]
        yield w[:i] + ["zzz"] + w[i + 1 :]


def test_license_notices_with_one_word_changed(spark):
    """At every place of every template: one label, that of the template which holds most pairs of the text, of those whose telling pairs are all there."""
    every = licenses.template_entries()
    entries = [(*e, {(e[1][i], e[1][i + 1]) for i in tells}) for e, tells in zip(every, licenses.telling_places(every)) if not e[2]]
    rows, want = [], []
    for label, w, _, places, _ in entries:
        for words in edits(w):
            text = ["qqq", *words, "qqq"]
            pairs = set(zip(text, text[1:]))
            ranks = sorted(((v, v / len(p), name) for name, t, _, p, tells in entries if tells <= pairs and (v := plain_votes(t, p, text)) >= 0.75 * len(p) and len(t) >= 5), reverse=True)
            if ranks:
                rows.append((len(rows), " ".join(text)))
                want.append((ranks[0][2], label, len(words) == len(w) and words == w))
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = {r["doc_id"]: set(filter(None, r["base_labels"].split(","))) for r in found}
    got = {r["doc_id"]: set(r["labels"].split(",")) - (base[r["doc_id"]] - {want[r["doc_id"]][0]}) for r in found}
    assert len(found) == len(rows) > 3000
    wrong = [(want[i], got[i], rows[i][1]) for i in got if got[i] != {want[i][0]}]
    assert wrong == [], Counter((w, tuple(g)) for w, g, _ in wrong)
    assert all(best == label for best, label, exact in want if exact)


def test_gpl_notices_stay_apart(spark):
    """A notice of version 3 with a word changed is one of version 3 or, where the word is what tells it from others, of no version."""
    texts = [" ".join(w) for label, t in licenses.TEMPLATES if label == "gpl-3" and len(t.split()) > 30 for w in edits(licenses.template_words(t))]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    told = {i for i, t in enumerate(texts) if all(p in t for p in ("gnu general", "version 3 of"))}
    assert len(rows) > 400 and {r["labels"] for r in rows if r["doc_id"] in told} == {"gpl-3"}
    assert {r["labels"] for r in rows if r["doc_id"] not in told} <= {"gpl-3", ""} and len(told) > 0.95 * len(texts)


def test_notices_side_by_side_and_plain_prose(spark):
    t = dict(reversed(licenses.TEMPLATES))
    whole = {label: text for label, text in licenses.TEMPLATES}
    texts = ["Released under the MIT License. " * 50, f"{t['isc']}. {whole['zlib']}", "word " * 40 + whole["gpl-2"] + " word" * 40 + whole["gpl-3"], "the terms of the license and the rights of the software as published by the author of this program " * 20, f"{whole['mit']} {whole['bsd-3']}"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["mit", "isc,zlib", "gpl-2,gpl-3", "", "bsd-3,mit"] and rows[0]["n_base"] == 50


def test_corpus_queries_equal_sql(spark):
    """The SQL of the corpus queries on the smallest tables and on license texts."""
    import duckdb
    from weftline.llm import queries

    c = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, SF), c.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        plain = lambda rows: sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
        assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall()), name
    texts = [" ".join(w) for _, t in licenses.TEMPLATES for i, w in enumerate(edits(licenses.template_words(t))) if i % 9 == 0]
    texts += [f"{a} of the {b}" for a, b in zip(texts, texts[7:])] + ["the MIT license, under the mit license of the software " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c.register("documents_table", docs.toPandas())
    c.sql("create or replace view documents as select * from documents_table")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted(map(tuple, licenses.scan_licenses(docs).select(*columns).collect()))
    assert got == sorted(c.sql(queries.oracle_sql()["op2_license_scan"]).select(*columns).fetchall())


def test_url_branches_of_a_hot_host(spark):
    """Millions of pages on one host: products of their counts are beyond 64 bits."""
    url = F.concat(F.lit("http://hot.com/"), F.when(F.col("id") % 2 == 0, "de").otherwise("fr"), F.lit("/5"))
    out = urls.judge_urls(spark.range(4_400_000).select(F.col("id").alias("page_id"), url.alias("url")))
    rows = out.groupBy("template", "verdict", "labelled", "blocked").count().collect()
    assert {tuple(r) for r in rows} == {("/de/#", "block", 2_200_000, 2_200_000, 2_200_000), ("/fr/#", "allow", 2_200_000, 0, 2_200_000)}


def test_license_places(spark):
    texts = ["X under the MIT license, under the mit License", "Apache License, Version 2.0 and apache license version 2", "CC-BY-NC cc by nc", "ÜNDER the MIT license", "This work is licensed under the GNU General Public License, version 3.",
             "licensed under the very Apache License, Version 2.0"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_base"], r["first_word"], r["last_word"]) for r in rows] == [(2, 1, 5), (2, 0, 6), (2, 0, 3), (0, None, None), (0, None, None), (1, 4, 4)]
    assert [r["base_labels"] for r in rows] == ["mit", "apache-2", "cc-by-nc", "", "", "apache-2"]
    assert rows[4]["labels"] == "gpl-3" and rows[5]["labels"] == "apache-2"


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_backpropagation_is_the_gradient():
    tagger = langid.ByteTagger(["a", "b"], hidden=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    codes = np.frombuffer(b"abczy\0", np.uint8).reshape(2, 3)
    mask = (codes != 0).astype(float)
    y = np.array([0, 1])
    g, _ = tagger.gradients(codes, mask, y)
    for k in tagger.p:
        i = tuple(np.array(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)))
        was, e = tagger.p[k][i], 1e-3
        tagger.p[k][i] = was + e
        up = tagger.gradients(codes, mask, y)[1]
        tagger.p[k][i] = was - e
        down = tagger.gradients(codes, mask, y)[1]
        tagger.p[k][i] = was
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-3 + 0.05 * abs(g[k][i]), k


def test_language_of_every_byte():
    tagger = langid.ByteTagger(["x", "y"])
    codes, of = langid.windows_of(["aaa bab 1 " * 40, "zzz yzy 1 " * 40])
    tagger.fit(np.repeat(codes, 10, axis=0), np.repeat(of, 10), epochs=10)
    assert tagger.label_bytes("aab, 1 a") == ["x"] * 8 and tagger.label_bytes("zz 11 z") == ["y"] * 7
    mixed = tagger.label_bytes("aaa bab 1 " * 30 + "zzz yzy 1 " * 30)
    assert mixed[:250] == ["x"] * 250 and mixed[-250:] == ["y"] * 250


def test_windows_hold_every_byte_once_and_see_their_neighbours():
    text = "".join(chr(97 + i % 26) for i in range(1000))
    codes, of = langid.windows_of(["", text, "b"])
    assert of.tolist() == [1] * 8 + [2]
    core = b"".join(c[langid.CONTEXT : -langid.CONTEXT].tobytes() for c in codes[:8]).rstrip(b"\0")
    assert core.decode() == text
    assert bytes(codes[3]) == text.encode()[3 * 128 - 12 : 4 * 128 + 12] and not codes[0][: langid.CONTEXT].any()


def slow_probabilities(tagger, window):
    """The network of one window, a byte and a unit at a time."""
    p, k, states = tagger.p, tagger.hidden, {}
    for d in "fb":
        h, out = np.zeros(k), {}
        for t in range(len(window)) if d == "f" else reversed(range(len(window))):
            if window[t]:
                x = p[f"x{d}"][window[t]].astype(float)
                z = 1 / (1 + np.exp(-(x[:k] + h @ p[f"r{d}"][:, :k])))
                g = 1 / (1 + np.exp(-(x[k : 2 * k] + h @ p[f"r{d}"][:, k:])))
                h = (1 - z) * h + z * np.tanh(x[2 * k :] + (g * h) @ p[f"c{d}"])
            out[t] = h
        states[d] = out
    rows = []
    for t in range(len(window)):
        e = np.exp(np.concatenate([states["f"][t], states["b"][t]]) @ p["out"] + p["bias"])
        rows.append(e / e.sum())
    return np.array(rows)


def test_pooling_is_brute_force():
    tagger = langid.ByteTagger(["a", "b", "c"], seed=3)
    texts = ["Ein kurzer Text, 12 Wörter.", "x" * 300 + " 7 " + "é" * 50, "no"]
    got = tagger.pooled(texts)
    for text, row in zip(texts, got):
        codes, _ = langid.windows_of([text])
        total, n = np.zeros(3), 0
        for window in codes:
            p = slow_probabilities(tagger, window)
            for t in range(langid.CONTEXT, langid.WINDOW - langid.CONTEXT):
                if 97 <= window[t] <= 122 or window[t] >= 128:
                    total, n = total + p[t], n + 1
        assert row[-1] == n and np.allclose(row[:-1], total, atol=1e-3)


def test_scores_do_not_depend_on_the_batch():
    tagger = langid.ByteTagger(["a", "b"])
    texts = [f"text {i} " * (i % 40 + 1) for i in range(3000)]
    whole = tagger.pooled(texts)
    assert np.array_equal(whole[100:200], tagger.pooled(texts[100:200])) and np.array_equal(whole[2999], tagger.pooled(texts[2999:])[0])


def test_undetermined_texts_and_many_languages(spark):
    odd = ["½ ² ①", "12 ½", "ª", "一", None, ""]
    rows = [(i, t, None) for i, t in enumerate(odd)] + [(100 + i, f"l{i % 70} " * 30, f"l{i % 70}") for i in range(140)]
    tagger = langid.train_tagger(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_windows=2)
    assert len(tagger.langs) == 70
    got = langid.identify_languages(spark.createDataFrame(rows[:6], "doc_id long, text string, lang string"), tagger).orderBy("doc_id").collect()
    assert [r["language"]["lang_pred"] == "und" for r in got] == [True, True, False, False, True, True]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity_report(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(hit) > 0.8 and np.mean(false) < 0.02


def test_trees_split_where_the_gain_is_largest():
    """Each node against a search over every feature and bin; each leaf is its Newton step."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, 60).astype(float)
    model = toxicity.BoostedTrees(trees=3, depth=2, rate=0.3, bins=8, least=4).fit(x, y)
    b, margin = model.binned(x), np.full(60, model.base)

    def check(tree, rows, g, h, depth):
        leaf = float(np.clip(0.3 * g[rows].sum() / (h[rows].sum() + 1), -2, 2))
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
        gains = {}
        for f in range(3):
            for at in range(7):
                left = b[rows, f] <= at
                if left.sum() >= 4 and (~left).sum() >= 4:
                    gains[f, at] = score(rows[left]) + score(rows[~left]) - score(rows)
        if isinstance(tree, float):
            assert abs(tree - leaf) < 1e-9 and (depth == 0 or len(rows) < 8 or max(gains.values(), default=0) <= 1e-6)
            return
        assert abs(gains[tree[0], tree[1]] - max(gains.values())) < 1e-9
        left = b[rows, tree[0]] <= tree[1]
        check(tree[2], rows[left], g, h, depth - 1)
        check(tree[3], rows[~left], g, h, depth - 1)

    for tree in model.forest:
        p = 1 / (1 + np.exp(-margin))
        check(tree, np.arange(60), y - p, p * (1 - p), 2)
        margin = margin + model.walk(tree, b)
    assert np.allclose(margin, model.margin(x))


def test_calibration_is_the_best_rising_fit():
    """Pooled blocks against the min-max formula of isotonic regression."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 2)), rng.integers(0, 2, 40).astype(float)
    model = toxicity.BoostedTrees(trees=5, least=4).fit(x, y).calibrate(x, y)
    order = np.argsort(model.margin(x), kind="stable")
    t, n = y[order], len(y)
    best = np.array([max(min(t[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
    levels = [best[0]] + [b for a, b in zip(best, best[1:]) if b - a > 1e-12]
    sizes = [int((abs(best - v) < 1e-12).sum()) for v in levels]
    want = [(v * s + 0.01) / (s + 0.02) for v, s in zip(levels, sizes)]
    assert np.allclose(model.knots[1], np.maximum.accumulate(want))


def test_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + rng.normal(scale=0.5, size=600) > 0).astype(float)
    model = toxicity.BoostedTrees(trees=20).fit(x[:400], y[:400]).calibrate(x[400:], y[400:])
    m = np.sort(model.margin(x))
    assert (np.diff(np.interp(m, *model.knots)) >= 0).all()
    assert abs(model.score(x[400:]).mean() - y[400:].mean()) < 0.1


PAGE = """<!doctype html><html><head><title>No &amp; no</title><style>p{}</style><script>var x="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First.<br><p>Second  one&nbsp;here.<p>Third <a href=x>link</a> with some words around it</p></article><!-- <p>hidden</p> -->
<section class="comments"><p>A reader's comment that is quite long and has many words in it to look like prose.</p></section><aside>Related</aside><form><p>Sign up</p></form><footer>&copy; 2020</footer></body>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst.\nSecond one here.\nThird link with some words around it"
    assert html_text.main_text("<p>" + "word " * 40 + "</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>") == " ".join(["word"] * 40)
    assert html_text.main_text(None) == "" and html_text.main_text("<script>never closed") == ""


def known_page(rng, layout):
    """(html, main text) of a made-up page."""
    word = lambda: rng.choice(["alpha", "beta", "gamma", "über", "x", "AT&amp;T", "1 &lt; 2", "end."])
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{word()} {word()}</a></li>" for i in range(n)) + "</ul>"
    blocks, text = [], []
    least = 1 if layout in ("article", "main") else 6
    for _ in range(rng.randint(1, 9) if least == 1 else rng.randint(4, 9)):
        words = [word() for _ in range(rng.randint(least, 60))]
        plain = [w.replace("&amp;", "&").replace("&lt;", "<") for w in words]
        shape = rng.choice(["p", "h2", "li", "blockquote", "open p", "div"])
        inline = list(words)
        if rng.random() < 0.5:
            at = rng.randrange(len(inline))
            inline[at] = rng.choice(["<b>{}</b>", "<i class='share-of'>{}</i>", "<a href=\"x>y\">{}</a>", "<math>{}</math>", "{}<!-- <p> -->", "{}<script>'</p>'</script>", "{}<svg><title>t</title></svg>"]).format(inline[at])
        body = rng.choice([" ", "\n ", "&nbsp;", "<br>"]).join(inline)
        blocks.append(f"<p>{body}" if shape == "open p" else f"<{shape}>{body}</{shape}>")
        text.append(" ".join(plain))
    core = "".join(blocks)
    inner = f"<article>{core}</article>" if layout == "article" else f"<main><div>{core}</div></main>" if layout == "main" else f"<div class='entry-body'>{core}</div>"
    noise = ["<nav>" + links(5) + "</nav>", "<div class='cookie-notice'><p>We use cookies here.</p></div>", "<div id=sidebar><p>" + "side " * 20 + "</p></div>", "<div class='ad'>Buy.</div>", "<form><p>Sign up</p><select><option>a<option>b</select></form>"]
    behind = ["<footer><p>" + "foot " * 30 + "</p></footer>", "<section class='comments'><article><p>" + "reader " * 30 + "</p></article></section>", "<div class='related-posts'>" + links(3) + "</div>", "<aside>" + "aside " * 12 + "</aside>"]
    rng.shuffle(noise)
    rng.shuffle(behind)
    if layout in ("article", "main"):  # an advert or a notice between two blocks
        core = "".join(b + ("</p>" + rng.choice(noise + behind) if rng.random() < 0.2 else "") for b in blocks)
        inner = f"<article>{core}</article>" if layout == "article" else f"<main><div>{core}</div></main>"
    return f"<html><head><title>No</title><style>p{{}}</style></head><body>{''.join(noise[:3])}{inner}{''.join(behind[:3])}</body></html>", "\n".join(text)


@pytest.mark.parametrize("layout", ["article", "main", "none"])
def test_main_text_of_known_pages(layout):
    rng = random.Random(layout)
    for _ in range(300):
        page, text = known_page(rng, layout)
        assert html_text.main_text(page) == text, page


def test_nothing_else_is_dropped():
    kept = "<article><p>Let <math><mi>x</mi></math> be <button>it</button>.</p><div class='related-work'><p>Earlier work</p></div><section id='header-notes'>Notes</section><p><a>All</a></p><p>b</p></article>"
    assert html_text.main_text(kept) == "Let x be it.\nEarlier work\nNotes\nAll\nb"
    short = ["One short.", "Two is short too.", "long " * 49 + "long", "The end is short."]
    assert html_text.main_text("".join(f"<p>{t}</p>" for t in short)) == "\n".join(short)
    assert html_text.main_text("<article><p>Main text of some length</p></article><article class='comment'><p>Nice</p></article><article><p>I agree</p></article>") == "Main text of some length"
    assert html_text.main_text("<article><svg viewBox='0'/><p>one</p><svg><p>two</p><button><p>three</p></article>") == "one\ntwo\nthree"
    assert html_text.main_text("<form id='aspnet'><article><p>In a form</p></article></form>") == "In a form"


@pytest.mark.parametrize("unit", ["<b ", '<b "', "<!--", "<svg>", "<script", "<p '<", "</", "<a href=\"x'", "<div class='a'>", "<", "&", "<!", "<p"])
def test_broken_markup_takes_linear_time(unit):
    import time

    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(unit * n)
        return time.perf_counter() - began

    assert seconds(64_000) < 10 * seconds(16_000) + 0.5 and seconds(64_000) < 5


def test_tree_splits_where_impurity_falls_most():
    """Against a search over all splits, node by node."""
    table = html_text.measured()

    def impurity(rows):
        p = sum(r[-1] for r in rows) / max(1, len(rows))
        return 2 * p * (1 - p) * len(rows)

    def check(tree, rows):
        if isinstance(tree, int):
            assert tree == int(2 * sum(r[-1] for r in rows) >= len(rows))
            return
        left, right = [r for r in rows if r[tree[0]] <= tree[1]], [r for r in rows if r[tree[0]] > tree[1]]
        best = min(impurity([r for r in rows if r[f] <= t]) + impurity([r for r in rows if r[f] > t]) for f in range(len(html_text.FEATURES)) for t in {r[f] for r in rows})
        assert impurity(left) + impurity(right) <= best + 1e-9 and left and right
        check(tree[2], left)
        check(tree[3], right)

    tree = html_text.grow(table)
    check(tree, list(table))
    assert all(html_text.decide(tree, r) == r[-1] for r in table)


def test_rare_siblings_become_wildcards(spark):
    rows = [(i, f"http://many.net/{a}{b}/end") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")]
    rows += [(1000 + i, f"http://few.net/{'xy'[i % 2]}/end") for i in range(6)]
    got = {r["page_id"]: r["template"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {got[i] for i in range(64)} == {"/*/end"}
    assert {got[1000 + i] for i in range(6)} == {"/x/end", "/y/end"}


def test_labelled_urls_take_the_place_of_seed_words(spark):
    rows = [(i, f"http://spam-farm.net/p/{i}") for i in range(30)] + [(100 + i, f"http://shop.net/sale/{i}") for i in range(30)]
    labelled = spark.createDataFrame([(f"http://shop.net/sale/{i}9", 1) for i in range(40)] + [("http://spam-farm.net/p/1", 0), (None, 1)], "url string, block int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labelled=labelled).collect()}
    assert len(got) == 60 and got[3] == "allow" and got[103] == "block"


def test_url_rules_and_tree(spark):
    rows = [(0, "http://X.example.org/es/1"), (1, "https://example.org/en/12#a"), (2, "http://notexample.org/es/1"), (3, "http://a.com/fr/"), (4, "http://a.com/de/x?y"), (5, "http://a.net/"), (6, "http://org/en"), (7, "http://a.org")]
    rows += [(100 + i, f"http://spam-farm.net/p/{i}") for i in range(30)] + [(200 + i, f"http://b.com/de/{i}") for i in range(30)]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(8)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, "org/", None]
    assert [got[i]["verdict"] for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert got[5]["verdict"] == "allow" and got[110]["verdict"] == "block"
