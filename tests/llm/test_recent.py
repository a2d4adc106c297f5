"""Chat windows, collocations and hard negatives against plain Python, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, collocation, licenses, negatives, queries, simhash

TALK = "conv_id long, turn long, role string, text string"
SAID = "<|im_end|><|im_start|>assistant ok"


def talks():
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "there"), (2, 0, "user", SAID), (2, 1, "assistant", SAID)]
    rows += [(3, i, "system" if i == 0 else "assistant" if i % 2 else "user", f"turn {i} <\\|im_end|> <" + "\\" * (i % 3) + "|" + "z" * (37 * i % 900)) for i in range(300)]
    rows += [(4, 0, "assistant", "a<"), (4, 1, "assistant\nb<|", "<\\"), (4, 1, "assistant\nb<|", "<\\"), (4, 2, "assistant", None), (4, 3, None, "|im_end|>\n<|im_end|>\n")]
    rows += [(5, None, "user", "no number"), (5, 1, "assistant", "x" * 9000), (5, 2, "user", "y" * 9000), (5, 3, "assistant", ""), (6, 0, "system", "s" * 4000), (6, 1, "user", "u"), (6, 2, "assistant", "ä€😀")]
    return rows + [(None, None, None, None), (None, 1, "assistant", "of no conversation")]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def windows(spark):
    df = spark.createDataFrame(talks(), TALK).withColumns({c: F.lit("clash") for c in ("key", "p", "window", "mark", "tokens", "section", "head", "copy")})
    return chat.format_conversations(df.repartition(5)).cache()


def test_chat_reads_back(windows):
    by = {}
    for c, t, r, x in talks():
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    found = {r["conv_id"]: r for r in chat.read_conversations(windows).collect()}
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        told, learnt = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest(told), len(learnt), digest(learnt))


def test_chat_windows(windows):
    rows = sorted(windows.filter("conv_id = 3").collect(), key=lambda r: r["window"])
    assert [r["window"] for r in rows] == list(range(len(rows))) and len(rows) > 20
    head = rows[0]["text"].split("<|im_end|>\n")[0]
    for r in rows:
        assert r["tokens"] <= 1024 and r["text"].split("<|im_end|>\n")[0] == head
        assert r["text"].count("<|im_start|>") == r["text"].count("<|im_end|>\n") and "<|" not in re.sub(r"<\|im_(start|end)\|>", "", r["text"])
        assert all("<|" not in r["text"][m["start"] : m["start"] + m["size"]] for m in r["loss"])
    # what a window repeats are the system turn and the turns right before its own
    assert all(r["repeated"] >= 1 for r in rows[1:]) and max(r["repeated"] for r in rows) > 2
    for a, b in zip(rows, rows[1:]):
        before, after = (x["text"].split("<|im_end|>\n")[:-1] for x in (a, b))
        history = after[1 : b["repeated"]]
        assert not history or history[-1] == before[-1]
    long = windows.filter("conv_id = 5").collect()
    assert sum(r["tokens"] > 1024 for r in long) == 2 and all(r["repeated"] == 0 for r in long if r["tokens"] > 1024)
    assert all(r["repeated"] == 0 or "ssss" not in r["text"] for r in windows.filter("conv_id = 6").collect())


def test_chat_empty(spark):
    assert chat.read_conversations(chat.format_conversations(spark.createDataFrame([], TALK))).collect() == []


def plain_collocations(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    out = {}
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in kept.items():
        holds = lambda x: len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))  # noqa: E731, B023
        if any(k[0] == lang and holds(k[1]) and 100 * b >= 80 * a for k, b in kept.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def phrase_docs():
    pick = random.Random(3)
    words = ["New", "york", "straße", "the", "of", "ein", " ", "x​", "0"]
    docs = []
    for i in range(220):
        text = "".join(pick.choice(words) + pick.choice([" ", "  ", "\t", ", ", ".", "\n", " "]) for _ in range(pick.randint(0, 60)))
        docs.append((pick.choice(["en", "de", None, "und"]), text + pick.choice(["", "New York City Hall", " in the  middle of\tnowhere!"])))
    return docs + [("en", None), ("en", ""), (None, " \t "), ("en", "new york " * 3000), ("fr", "rare words here")] + [("de", "immer wieder gleich")] * 40


def test_collocations_are_exact(spark):
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit("clash") for c in ("n", "phrase", "f", "score", "rank", "salt")})
    for top in (2000, 7):
        rows = collocation.collocations(df.repartition(4), least=30, top=top).collect()
        assert sorted(tuple(r) for r in rows) == plain_collocations(docs, 30, top)
    assert collocation.collocations(df.limit(0)).collect() == []
    assert sorted(tuple(r) for r in collocation.collocations(df, least=300).collect()) == plain_collocations(docs, 300, 2000)


class Sent:
    def __init__(self, value):
        self.value = value


def sketched(batches, bits, least, size):
    """The kept bits of both rows, as tasks and merging make them."""
    parts = [p for b in batches for p in collocation.sketch_parts(iter([b]), bits, 4, np.uint8, size)]
    rows = sorted((r["tile"], r["cells"]) for p in parts for r in p.to_pylist())
    sorted_rows = pa.RecordBatch.from_pylist([{"tile": t, "cells": c} for t, c in rows], pa.schema([("tile", pa.int64()), ("cells", pa.binary())]))
    kept = [bytearray((1 << bits) // 8) for _ in range(2)]
    step = (1 << collocation.TILE_BITS) // 8
    for m in collocation.merge_tiles(iter([sorted_rows.slice(0, len(rows) // 3), sorted_rows.slice(len(rows) // 3)]), least, np.uint8):
        for r in m.to_pylist():
            at = (r["tile"] & 0xFFFFFFFF) * step
            kept[r["tile"] >> 32][at : at + step] = r["bits"]
    return [bytes(k) for k in kept]


@pytest.mark.parametrize("crowded", [False, True])
def test_sketch_loses_nothing(monkeypatch, crowded):
    """Over many chunks and tiles, and with all phrases in two cells of each row: what is frequent stays, with its exact count."""
    if crowded:
        monkeypatch.setattr(collocation, "cell_of", lambda hashed, row, bits: (hashed >> np.uint64(8 + row) & np.uint64(1)).astype(np.uint32))
    docs = phrase_docs()
    batches = [pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in part]), pa.array([t for _, t in part], pa.string())], ["lang", "text"]) for part in (docs[:100], docs[100:])]
    kept = sketched(batches, 18, 30, 700)
    counts, plain = Counter(), Counter()
    for b in batches:
        for found in collocation.count_survivors(iter([b]), Sent(kept), 18, 4, 900):
            for r in found.to_pylist():
                counts[r["lang"], r["n"], r["phrase"]] += r["found"]
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            plain[lang or "und", 0, ""] += len(w)
            for m in range(1, 5):
                plain.update((lang or "und", m, " ".join(w[i : i + m])) for i in range(len(w) - m + 1))
    plain = Counter({k: v for k, v in plain.items() if v})
    assert {k: v for k, v in counts.items() if v >= 30} == {k: v for k, v in plain.items() if v >= 30}
    assert all(plain[k] == v for k, v in counts.items())
    assert (len(counts) == len(plain)) if crowded else (len(counts) < 0.5 * len(plain))


def test_texts_are_cut_where_pieces_end():
    text = b"ab cd. ef gh, " * 300 + b"z" * 5000 + b" tail"
    parts = list(collocation.cut_pieces(text, 1000))
    assert b"".join(parts) == text and all(p[-1:] in (b".", b",") for p in parts[:-1])


def plain_negatives(rows):
    rows = [(i, [int(np.floor(256 * x)) for x in v], k) for i, v, k in rows if i is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for at, (i, v, k) in enumerate(rows):
        if i % 100:
            continue
        others = sorted((-dot(v, w), j, m, b) for b, (j, w, m) in enumerate(rows) if b != at and len(w) == len(v))
        for s, j, m, _ in [o for o in others if o[2] == k][:5]:
            fit = [(n, t) for t, n, q, _ in others if q != k and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r + 1, n, -s, -t) for r, (n, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_are_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "ROWS_A_PIVOT", 16)
    monkeypatch.setattr(negatives, "TASK_ROWS", 64)
    pick = np.random.default_rng(seed)
    centres = pick.normal(0, 1, (6, 8))
    rows = []
    for i in range(700):
        c = int(pick.integers(6))
        v = (centres[c] + pick.normal(0, 0.3, 8)) * pick.choice([0.5, 1.0, 2.0])
        rows.append((int(i * 25), [float(x) for x in v], int(c if pick.random() < 0.7 else pick.integers(6))))
    rows += [(int(20_000 + i), [float(x) for x in centres[0]], int(i % 3)) for i in range(150)]  # one vector many times
    rows += [(100, rows[8][1], 2), (200, None, 1), (300, [1.0, None] * 4, 1), (400, [float("nan")] * 8, 1), (500, rows[3][1], None), (None, rows[4][1], 2), (600, [], 1), (700, [1.0, 2.0], 1), (701, [2.0, 2.0], 1), (702, [2.0, 1.5], 2), (800, [0.0] * 8, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("row", "cell", "kin", "score", "rank", "unit", "task")})
    found = negatives.hard_negatives(df.repartition(4), block_rows=16, group_rows=8)
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(none).collect() == []
    text = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.9, 0.1], "a"), (2, [0.8, 0.1], "b")], "vec_id long, embedding array<double>, label string")
    assert [tuple(r) for r in negatives.hard_negatives(text).collect()] == [(0, 1, 1, 2, 58880, 52224)]


def test_rings_leave_blocks_out(spark):
    """On vectors in clusters most blocks are served to no foreign group."""
    pick = np.random.default_rng(5)
    centres = pick.normal(0, 1, (40, 6))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = [(centres[i % 40] + pick.normal(0, 0.02, 6)) for i in range(4000)]
    space = negatives.Space([np.floor(256 * v) for v in vectors[:40]], float(max((np.floor(256 * v) ** 2).sum() for v in vectors)) * (1 + 1e-9))
    import pandas as pd

    a = np.floor(256 * vectors[0]).astype(np.int64)
    low = int(0.97 * (a * a).sum())
    asks = pd.DataFrame({"kin": [0], "dims": [6], "region": [0], "part": [0], "low": [low], "high": [negatives.ALL], "vector": [a.tobytes()]})
    assert len(negatives.rings(asks, space)) < 20


@pytest.mark.parametrize("name", ["op11_chat_windows", "op12_collocations", "op13_hard_negatives"])
def test_queries_equal_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want.select(*columns).fetchall())


FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License"
WORK = "This work is licensed under {}"
RELATIVES = [
    (FREE.format("GNU Lesser General Public License", 3), "lgpl-3"), (FREE.format("GNU Affero General Public License", 3), "agpl-3"), (FREE.format("GNU General Public License", 3), "gpl-3"), (FREE.format("GNU General Public License", 4), ""),
    (WORK.format("the GNU Lesser General Public License, version 3"), "lgpl-3"), (WORK.format("the GNU General Public License, version 1"), "gpl-1"), (WORK.format("the GNU General Public License, version 2"), "gpl-2"), (WORK.format("the GNU General Public License, version 3"), "gpl-3"), (WORK.format("the GNU General Public License, version 5"), ""),
    (WORK.format("a Creative Commons Attribution 4.0 International License"), "cc-by"), (WORK.format("a Creative Commons Attribution-NonCommercial 4.0 International License"), "cc-by-nc"), (WORK.format("a Creative Commons Attribution-ShareAlike 4.0 International License"), "cc-by-sa"),
    (WORK.format("a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), "cc-by-nc-sa"), (WORK.format("a Creative Commons Attribution-NoDerivatives 4.0 International License"), "cc-by-nd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", "mpl-1.1"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
]


def test_relatives_are_told_apart(spark):
    df = spark.createDataFrame([(i, f"Some words before. {t}. And words behind it.") for i, (t, _) in enumerate([*RELATIVES, *((t, label) for label, t in licenses.TEMPLATES)])], "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert [found[i] for i in range(len(RELATIVES))] == [label for _, label in RELATIVES]
    assert [found[len(RELATIVES) + i] for i in range(len(licenses.TEMPLATES))] == [label for label, _ in licenses.TEMPLATES]


def test_near_copy_pairs_are_pruned_by_chains_on_the_ring():
    """From some word every chain of a near pair is short; a pair is found from there, and not from where its differences lie."""
    rng, most = np.random.default_rng(3), simhash.bits_for(0.8, slack=2.5)
    found = lambda a, b, at: len(simhash.wide_tile_links(np.zeros(2, np.int64), np.arange(2), np.stack([a, b]), most, np.full(2, at))[0])
    for _ in range(60):
        a, flips = rng.integers(0, 2, simhash.WIDE_BITS), rng.choice(simhash.WIDE_BITS, rng.integers(most - 30, most + 31), replace=False)
        b = a.copy()
        b[flips] ^= 1
        a, b = (np.packbits(x).view("<u8") for x in (a, b))
        assert any(found(a, b, at) for at in range(simhash.WIDE_WORDS)) == (len(flips) <= most)
    a = np.zeros(simhash.WIDE_WORDS, np.uint64)
    b = a.copy()
    b[2] = 2**64 - 1  # 64 differences in one word
    assert not found(a, b, 2) and not found(a, b, 1) and found(a, b, 3)
    cuts = simhash.wide_segments(10_000, 0.8)
    assert all((cut // 64 == (i * cuts.shape[1]) // 64).any() for i, cut in enumerate(cuts))
