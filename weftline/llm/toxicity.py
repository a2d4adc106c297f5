"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a whole text are densities of two lexicons (a short public word list, and
terms and stems that set labelled toxic documents apart), how near such words stand to
second-person words, and rates of capitals, exclamation marks, punctuation, obfuscated words
and stretched letters. Labelled rows, a bounded sample, are dealt by a hash of their texts
into three parts: one for the lexicon, one for the trees, one for the calibration.

Edge cases: null and empty texts have zero densities and are scored like any other; with no
usable label the score is the fixed ``prior``; every row gives one row; repeated labels
count as often as they stand; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import persist

#: Common insults in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting dumb jerk imbecile bastard bitch "
    "idioten dummkopf arschloch abschaum trottel idiota idiotas estúpido imbécil basura idiote stupide connard ordure crétin".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ti vosotros".split())
NAMES = ("learned_density", "learned_count", "learned_distinct", "learned_best", "insult_density", "insult_count", "near_second_person", "second_person", "capitals", "exclamations", "punctuation", "obfuscated", "stretched", "log_words")
WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$!*.\-_+|]+(?=[^\W\d_])[^\s]*")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None, "+": None})
CAPS, MARKS = bytes(range(65, 91)), b"\"#%&'()*,-./:;<=>?@[\\]^_`{|}~$+"
STEMS = (4, 5, 6)
REACH = 5


def terms_of(words: set[str]) -> set[str]:
    """Words and the stems of longer ones, which end in *."""
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n + 1}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    lowered = text.lower()
    words = WORD.findall(lowered)
    n, distinct = len(words) or 1, set(words)
    known = {w: lexicon[w] for w in lexicon.keys() & distinct}
    for w in distinct:
        for size in STEMS:
            if len(w) > size + 1 and (weight := lexicon.get(w[:size] + "*")) is not None:
                known[w] = max(weight, known.get(w, 0.0))
    obfuscated = OBFUSCATED.findall(lowered) if any(c in lowered for c in "0134578@$!*.-_+|") else []
    hidden = sum(1 for w in (m.group().translate(LEET) for m in OBFUSCATED.finditer(lowered)) if w.rstrip(",;:?") in INSULTS or w in lexicon) if obfuscated else 0
    insults = INSULTS & distinct
    marked = insults | known.keys()
    hits = insult_hits = near = second = 0
    if marked:
        places = [i for i, w in enumerate(words) if w in marked]
        hits = sum(words[i] in known for i in places)
        insult_hits = sum(words[i] in insults for i in places)
        near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - REACH) : i + REACH + 1]) for i in places)
    if not SECOND_PERSON.isdisjoint(distinct):
        second = sum(w in SECOND_PERSON for w in words)
    raw = text.encode("utf-8", "replace")
    size = len(raw) or 1
    return [
        hits / n, np.log1p(hits), float(len(known)), max(known.values(), default=0.0), (insult_hits + hidden) / n, np.log1p(insult_hits + hidden), near / n, second / n,
        (len(raw) - len(raw.translate(None, CAPS))) / size, raw.count(b"!") / size, (len(raw) - len(raw.translate(None, MARKS))) / size, len(obfuscated) / n, len(STRETCHED.findall(lowered)) / n, np.log1p(len(words)),
    ]


class BoostedTrees:
    """Logistic gradient boosting on binned features, with isotonic calibration of the margin."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.forest, self.cuts = 0.0, [], []
        self.knots = (np.array([0.0]), np.array([0.5]))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b, rate = self.binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self.grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            margin += self.walk(tree, b)
        return self

    def grow(self, b, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(self.rate * total_g / (total_h + 1.0), -2, 2))
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for f in range(b.shape[1]):
            codes = b[rows, f]
            sg, sh, sn = (np.cumsum(np.bincount(codes, w, self.bins))[:-1] for w in (g[rows], h[rows], None))
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(sn < self.least) | (len(rows) - sn < self.least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        if best[1] is None:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return best[1], best[2], self.grow(b, g, h, rows[left], depth - 1), self.grow(b, g, h, rows[~left], depth - 1)

    def walk(self, tree, b: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(b), tree)
        left = b[:, tree[0]] <= tree[1]
        out = np.empty(len(b))
        out[left], out[~left] = self.walk(tree[2], b[left]), self.walk(tree[3], b[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + sum((self.walk(t, b) for t in self.forest), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Pool adjacent violators over the margins of rows the trees have not seen."""
        m = self.margin(x)
        order = np.argsort(m, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
        for i in order:
            blocks.append([float(y[i]), 1.0, float(m[i])])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + c for a, c in zip(blocks[-1], last)]
        knots = np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])
        self.knots = (knots[0], np.maximum.accumulate(knots[1]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        m = self.margin(x)
        # a trace of the raw margin keeps the order within a calibrated step
        return np.clip(0.995 * np.interp(m, *self.knots) + 0.005 / (1 + np.exp(-m)), 0, 1)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None, sample_rows: int = 4000, max_terms: int = 4000) -> tuple[dict[str, float], BoostedTrees] | None:
    """(lexicon, model) from about ``sample_rows`` labelled rows of each class, chosen by a hash of the id.

    The chosen labels are few (``4 * sample_rows`` at most), so they are broadcast, and the
    texts are not shuffled. The learned lexicon is that of the ``max_terms`` terms that tell
    the classes apart best, a bound on what each task holds.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if learn is not None:
        marks = marks.filter(learn("doc_id"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    rate = F.when(F.col("y") == 1, F.lit(int(1e6 * sample_rows / counts[1]) + 1)).otherwise(F.lit(int(1e6 * sample_rows / counts[0]) + 1))
    chosen = marks.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1_000_000)) < rate)
    chosen = chosen.limit(4 * sample_rows)  # a bound for the broadcast; twice what is expected
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = persist(rows.select("text", "y", F.pmod(F.xxhash64("text", F.lit(9)), F.lit(10)).alias("part")))

    def tally(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch["text"], batch["y"]):
                for term in terms_of(set(WORD.findall(text.lower()))):
                    seen.setdefault(term, [0, 0])[y] += 1
            yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["term", "clean", "toxic"])

    sizes = {(r["lex"], r["y"]): r["count"] for r in sample.groupBy((F.col("part") < 4).alias("lex"), "y").count().collect()}
    clean, toxic = max(1, sizes.get((True, 0), 0)), max(1, sizes.get((True, 1), 0))
    found = sample.filter("part < 4").select("text", "y").mapInPandas(tally, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    terms = found.filter("toxic >= 4").withColumn("weight", weight).filter("weight >= 1.8").orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(max_terms)
    lexicon = {r["term"]: float(r["weight"]) for r in terms.select("term", "weight").collect()}

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon) for t in texts])

    table = sample.filter("part >= 4").select(measured("text").alias("x"), "y", "part", F.xxhash64("text").alias("h")).orderBy("h", "y").toPandas()
    if table["y"].nunique() < 2:
        return None
    x, y, own = np.vstack(table["x"]), table["y"].to_numpy(float), (table["part"] < 8).to_numpy()
    if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
        own = np.ones(len(y), bool)
    rest = ~own if (~own).any() else own
    return lexicon, BoostedTrees().fit(x[own], y[own]).calibrate(x[rest], y[rest])


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], BoostedTrees] | None, text_col: str = "text", prior: float = 0.0, out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out_col`` between 0 and 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), prior))
        return pd.Series(model[1].score(np.array([features(t or "", model[0]) for t in texts.where(texts.notna(), "")])))

    return docs.withColumn(out_col, score(text_col))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; rows held out take no part in learning."""
    model = train_toxicity(docs, labels, id_col, text_col, learn=lambda c: ~held_out(c))
    rows = score_toxicity(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
