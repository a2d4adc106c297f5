"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 bytes of whole texts, blanks, digits and marks
included, in windows of WINDOW bytes of which each overlaps its neighbours by CONTEXT bytes
on either side, so both states have run over that much text before a byte counts. Every
byte gets a distribution over the learned languages; a document's distribution is the mean
over the bytes of its letters, as digits and marks belong to no language. Training is
backpropagation through time in numpy on a bounded, documented sample of labelled rows
(``sample_docs``, ``sample_windows``), all languages included.

Windows go through the network in batches of one fixed shape, so a text's score does not
depend on which texts it shares a batch with.

Edge cases: texts that are null or have no letter are ``und`` with score 0 (numerals such as
the half sign are no letters); with no labelled row to learn from, every text is; every row
gives one row; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CORE, CONTEXT, HIDDEN = 128, 12, 8
WINDOW = CORE + 2 * CONTEXT
BATCH = 1024
LETTER = re.compile(r"[^\W\d_]")
CALL_CHARS = 500_000
BROADCAST_LANGS = 100_000
#: Bytes that letters are made of once they are lower-cased.
OF_LETTERS = np.zeros(256, np.float32)
OF_LETTERS[97:123] = OF_LETTERS[128:] = 1


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of bytes, the text that each is of). Bytes beyond a text's ends are 0."""
    data, ends, at = [], [], 0
    for text in texts:
        raw = text.lower().encode("utf-8", "replace")
        n = -(-len(raw) // CORE)
        data.append(raw.ljust(n * CORE, b"\0"))
        ends.append(n)
    counts = np.array(ends, np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    if not len(of):
        return np.zeros((0, WINDOW), np.uint8), of
    core = np.frombuffer(b"".join(data), np.uint8).reshape(-1, CORE)
    out = np.zeros((len(core), WINDOW), np.uint8)
    out[:, CONTEXT:-CONTEXT] = core
    follows = of[1:] == of[:-1]  # the window before is of the same text
    out[1:, :CONTEXT][follows] = core[:-1, -CONTEXT:][follows]
    out[:-1, -CONTEXT:][follows] = core[1:, :CONTEXT][follows]
    return out, of


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteTagger:
    """Two GRUs and a softmax over their joined states at every byte."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        normal = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
        self.p = {"out": normal(2 * hidden, len(langs)), "bias": np.zeros(len(langs), np.float32)}
        for d in "fb":  # forward, backward: input rows by byte, recurrent weights for update+reset and for the candidate
            self.p |= {f"x{d}": normal(256, 3 * hidden), f"r{d}": normal(hidden, 2 * hidden), f"c{d}": normal(hidden, hidden)}

    def scan(self, codes: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, steps = codes.shape
        h, out = np.zeros((n, self.hidden), np.float32), np.zeros((steps, n, self.hidden), np.float32)
        x, r, c, k = self.p[f"x{d}"], self.p[f"r{d}"], self.p[f"c{d}"], self.hidden
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x[codes[:, t]]
            gates = sigmoid(a[:, : 2 * k] + h @ r)
            z, g = gates[:, :k], gates[:, k:]
            new = np.tanh(a[:, 2 * k :] + (g * h) @ c)
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, g, new, m))
            h = h + m * z * (new - h)
            out[t] = h
        return out

    def probabilities(self, codes: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(steps, windows, languages)"""
        kept = {d: [] for d in "fb"} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self.scan(codes, mask, d, kept[d]) for d in "fb"], axis=2)
        logits = states @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        if keep is not None:
            keep |= {"states": states, **kept}
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, codes: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Backpropagation through time of the mean cross entropy over all bytes."""
        keep: dict = {}
        p = self.probabilities(codes, mask, keep)
        live, k = mask.T[:, :, None], self.hidden
        target = np.eye(len(self.langs), dtype=np.float32)[y][None]
        total = mask.sum()
        loss = float(-(np.log(np.maximum((p * target).sum(2), 1e-9)) * live[:, :, 0]).sum() / total)
        delta = (p - target) * live / total
        g = {"out": np.einsum("tnh,tnl->hl", keep["states"], delta), "bias": delta.sum((0, 1))}
        back = delta @ self.p["out"].T
        for d, part in (("f", back[:, :, :k]), ("b", back[:, :, k:])):
            r, c = self.p[f"r{d}"], self.p[f"c{d}"]
            gx, gr, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(r), np.zeros_like(c)
            dh = np.zeros((codes.shape[0], k), np.float32)
            for t, h, z, s, new, m in reversed(keep[d]):
                dh = dh + part[t]
                dm = dh * m
                dnew = dm * z * (1 - new * new)
                dgh = dnew @ c.T
                dgates = np.concatenate([dm * (new - h) * z * (1 - z), dgh * h * s * (1 - s)], axis=1)
                gc += (s * h).T @ dnew
                gr += h.T @ dgates
                np.add.at(gx, codes[:, t], np.concatenate([dgates, dnew], axis=1))
                dh = dh - dm * z + dgh * s + dgates @ r.T
            g |= {f"x{d}": gx, f"r{d}": gr, f"c{d}": gc}
        return g, loss

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 11) -> list[float]:
        rng, moments, step, losses = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}, 0, []
        mask = (codes != 0).astype(np.float32)
        for epoch in range(epochs):
            order, total = rng.permutation(len(codes)), 0.0
            for at in range(0, len(codes), batch):
                rows = order[at : at + batch]
                g, loss = self.gradients(codes[rows], mask[rows], y[rows])
                step, total = step + 1, total + loss
                lr = rate * (1 - 0.9 * epoch / epochs)
                for k, v in g.items():
                    m1, m2 = moments[k]
                    m1 += 0.1 * (v - m1)
                    m2 += 0.01 * (v * v - m2)
                    self.p[k] -= lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            losses.append(total / max(1, -(-len(codes) // batch)))
        return losses

    def label_bytes(self, text: str) -> list[str]:
        """The language of each byte of the lower-cased text."""
        codes, _ = windows_of([text])
        best = self.probabilities(codes, (codes != 0).astype(np.float32)).argmax(2).T[:, CONTEXT:-CONTEXT]
        return [self.langs[i] for i in best.reshape(-1)[: len(text.lower().encode("utf-8", "replace"))]]

    def states(self, codes: np.ndarray, d: str) -> np.ndarray:
        """The states of ``scan``, in arrays that are written over; sigmoid(x) is (tanh(x / 2) + 1) / 2."""
        steps, n, k = codes.shape[1], len(codes), self.hidden
        x, r, c = self.p[f"x{d}"], self.p[f"r{d}"] / 2, self.p[f"c{d}"]
        xz, xg, xc, rz, rg = (np.ascontiguousarray(a) for a in (x[:, :k] / 2, x[:, k : 2 * k] / 2, x[:, 2 * k :], r[:, :k], r[:, k:]))
        at, whole = np.ascontiguousarray(codes.T), codes.all(axis=0)
        h, out = np.zeros((n, k), np.float32), np.empty((steps, n, k), np.float32)
        z, g, new, byte = (np.empty((n, k), np.float32) for _ in range(4))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            for gate, weights, table in ((z, rz, xz), (g, rg, xg)):
                np.matmul(h, weights, out=gate)
                gate += np.take(table, at[t], axis=0, out=byte, mode="clip")
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            g *= h
            np.matmul(g, c, out=new)
            new += np.take(xc, at[t], axis=0, out=byte, mode="clip")
            np.tanh(new, out=new)
            new -= h
            new *= z
            if not whole[t]:
                new *= (at[t] != 0)[:, None]
            h += new
            out[t] = h
        return out

    def pooled(self, texts: list[str]) -> np.ndarray:
        """For each text: the sum over the bytes of its letters of their distributions, and the number of these bytes."""
        codes, of = windows_of(texts)
        sums = np.zeros((len(codes), len(self.langs) + 1))
        for at in range(0, len(codes), BATCH):
            part = codes[at : at + BATCH]
            whole = np.concatenate([part, np.zeros((BATCH - len(part), WINDOW), np.uint8)]) if len(part) < BATCH else part
            k, inner = self.hidden, slice(CONTEXT, -CONTEXT)
            e = self.states(whole, "f")[inner] @ self.p["out"][:k] + self.states(whole, "b")[inner] @ self.p["out"][k:] + self.p["bias"]
            np.exp(np.minimum(e, 60, out=e), out=e)
            weight = OF_LETTERS[whole[:, inner]].T
            e *= (weight / e.sum(axis=2))[:, :, None]
            sums[at : at + BATCH, :-1] = e.sum(axis=0)[: len(part)]
            sums[at : at + BATCH, -1] = weight.sum(axis=0)[: len(part)]
        out = np.zeros((len(texts), sums.shape[1]))
        np.add.at(out, of, sums)
        return out


def in_calls(texts: list[str]):
    run, chars = [], 0
    for text in texts:
        run.append(text)
        chars += len(text)
        if chars >= CALL_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def train_tagger(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn=None, sample_docs: int = 400, sample_windows: int = 1000) -> ByteTagger | None:
    """Fit on windows of about ``sample_docs`` documents of each language, ``sample_windows`` of each at most.

    Documents and windows are chosen by hashes of what they hold, so reruns choose alike. Every
    learned language is a column of the network; their number is that of the labels in use.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.lit(True).alias("ok") if learn is None else learn.alias("ok"))
    rows = rows.filter("ok and text is not null and lang is not null")
    counts = rows.groupBy("lang").count()
    langs = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").collect()]
    if not langs:
        return None
    rates = counts.select("lang", F.ceil(1e6 * sample_docs / F.col("count")).alias("rate"))
    if len(langs) <= BROADCAST_LANGS:  # beyond that the texts are shuffled
        rates = F.broadcast(rates)
    sample = rows.join(rates, "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("rate"))

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        codes, of = windows_of(texts.tolist())
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        for i, code in zip(of, codes):
            if OF_LETTERS[code].sum() * 2 >= CORE // 2:
                out[i].append(code.tobytes())
        return pd.Series(out)

    spread = sample.select("lang", F.explode(cut("text")).alias("window")).distinct().withColumn("h", F.xxhash64("window"))
    # a window of some thousand rows a language: the sampled documents' windows
    ranked = spread.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "window"))).filter(F.col("place") <= sample_windows)
    picked = ranked.orderBy("lang", "place").select("lang", "window").collect()
    tagger = ByteTagger(langs)
    if picked:
        at = {lang: i for i, lang in enumerate(langs)}
        tagger.fit(np.frombuffer(b"".join(bytes(r["window"]) for r in picked), np.uint8).reshape(-1, WINDOW), np.array([at[r["lang"]] for r in picked]))
    return tagger


def least_score(tagger: ByteTagger | None, above_chance: float = 0.05) -> float:
    """A pooled probability that is ``above_chance`` of the way from an even guess to certainty."""
    even = 1 / len(tagger.langs) if tagger is not None else 1.0
    return even + above_chance * (1 - even) - 1e-6


def identify_languages(docs: DataFrame, tagger: ByteTagger | None, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out_col`` (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for part in in_calls(texts.where(texts.notna(), "").tolist()):
            known = [tagger is not None and has_letter(t) for t in part]
            sums = iter(tagger.pooled([t for t, k in zip(part, known) if k])) if any(known) else iter(())
            for k in known:
                row = next(sums) if k else None
                p = row[:-1] / row[-1] if k else None
                langs.append(tagger.langs[int(p.argmax())] if k else "und")
                scores.append(float(min(1.0, p.max())) if k else 0.0)
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    return docs.withColumn(out_col, predict(text_col))


def held_out_rows(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows held out take no part in learning."""
    held = held_out_rows(id_col)
    tagger = train_tagger(docs, text_col, lang_col, learn=~held & F.col(id_col).isNotNull())
    rows = identify_languages(docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")), tagger)
    return rows.select("doc_id", "held_out", "language.lang_pred", "language.score")
