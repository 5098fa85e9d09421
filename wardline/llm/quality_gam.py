"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting visits the features in turn, fits a shallow tree to
the residuals over the bins of one, and adds it to that feature's lookup table. Then pairs of
features with the most left to gain get tables of their own in the same way. A score is
the sum of a few table entries, added for a whole batch of documents at once, through a logistic function.

The model is fitted on at most ``PER_CLASS`` labelled rows of each class, taken in the order of a hash;
scoring covers every row and whole texts.

Defined cases: a null text counts as empty; an empty text gets a score like any other; conflicting labels of one id count as 1; labels
other than 0 and 1 and rows without an id are not learned from; without labels of both classes the score is the
share of ones among them (0.5 without any); repeated rows stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, map_texts, unpack_row
from .labelled import crc_mod, fit_ids

PER_CLASS = 8_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 6, 60, 20, 0.2, 3
FEATURES = ("log_words", "word_len", "symbols", "pipes", "bangs", "upper", "digits", "stops", "distinct", "next_same", "distinct_pairs", "dup_lines", "line_words", "long_words")
_SYMBOLS = re.compile(r"[#*$%&<>=~^_@{}\\]")


def features(text: str | None) -> list[float]:
    t = text or ""
    words = t.split()
    n = len(words) or 1
    chars = len(t) or 1
    lines = [x for x in t.split("\n") if x.strip()]
    low = [w.lower() for w in words]
    letters = sum(map(len, words)) or 1
    return [
        float(np.log1p(len(words))),
        letters / n,
        len(_SYMBOLS.findall(t)) / n,
        t.count("|") / n,
        t.count("!") / n,
        (chars - len(_UPPER.sub("", t))) / chars,
        (chars - len(_DIGITS.sub("", t))) / chars,
        (t.count(".") + t.count(",")) / n,
        len(set(low)) / n,
        sum(map(str.__eq__, low, low[1:])) / n,
        len(set(zip(low, low[1:], strict=False))) / n,
        1 - len(set(lines)) / (len(lines) or 1),
        float(np.log1p(n / (len(lines) or 1))),
        max(map(len, words), default=0) / 100,
    ]


_UPPER, _DIGITS = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+")


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # features, their coarse cuts, table

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The values of a tree of at most ``leaves`` leaves over ordered bins, given gradient and curvature a bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (gains[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best table with one cut in each of two features, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ra, rb = cg[:, -1:], ch[:, -1:]
    ca, cb = cg[-1:, :], ch[-1:, :]
    quads = [(cg, ch), (ra - cg, rb - ch), (ca - cg, cb - ch), (cg[-1, -1] - ra - ca + cg, ch[-1, -1] - rb - cb + ch)]
    total = sum(_gain(x, np.maximum(y, 0)) for x, y in quads)[:-1, :-1]
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    out = np.empty_like(g)
    (out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :]) = (_leaf(x[i, j], y[i, j]) for x, y in quads)
    return out, float(total[i, j] - _gain(cg[-1, -1], ch[-1, -1]))


def fit(x: np.ndarray, y: np.ndarray, prior: float | None = None) -> Gam:
    """``prior``: the share of ones where the sample comes from, if its classes were drawn at other rates."""
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(prior if prior is not None else (y.mean() if len(y) else 0.5), 1e-3, 1 - 1e-3)
        return Gam(float(np.log(p / (1 - p))))
    p = y.mean()
    model = Gam(float(np.log(p / (1 - p))))
    bins = []
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.cuts.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
        bins.append(np.searchsorted(cuts, x[:, j], side="right"))
    f = np.full(len(y), model.base)

    def slopes(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return np.bincount(index, y - q, n), np.bincount(index, q * (1 - q), n)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            step = RATE * _tree(*slopes(b, len(model.tables[j])))
            model.tables[j] += step
            f += step[b]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(c) else c for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    shapes = {(i, j): (len(coarse[i]) + 1, len(coarse[j]) + 1) for i, j in combinations(range(x.shape[1]), 2) if len(coarse[i]) and len(coarse[j])}

    def cross(i: int, j: int) -> tuple[np.ndarray, float]:
        n, m = shapes[i, j]
        g, h = slopes(at[i] * m + at[j], n * m)
        return _cross(g.reshape(n, m), h.reshape(n, m))

    for i, j in sorted(shapes, key=lambda p: -cross(*p)[1])[:PAIRS]:
        model.pairs.append((i, j, coarse[i], coarse[j], np.zeros(shapes[i, j])))
    for _ in range(PAIR_ROUNDS):
        for i, j, _a, _b, table in model.pairs:
            step = RATE * cross(i, j)[0]
            table += step
            f += step[at[i], at[j]]
    if prior is not None:
        model.base += float(np.log(prior / (1 - prior)) - np.log(p / (1 - p)))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, held: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    ids, prior = fit_ids(labels, label, crc_mod("doc_id", fold) != held, per_class)
    # At most 2 * per_class ids: the broadcast and what comes back are bounded.
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    made = map_texts(rows, [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda: lambda texts: [matrix(texts).tolist()])
    got = made.groupBy("row.doc_id", "row.y").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy().astype(float), prior)


def _scored(docs: DataFrame, model: Gam, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, [T.StructField("score", T.DoubleType())], lambda: lambda texts: [held.value.score(matrix(texts))], text_col)


def classify(docs: DataFrame, model: Gam, fold: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    s = _scored(id_and_text(docs, id_col, text_col), model, "text")
    return s.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(crc_mod("row.doc_id", fold) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """The table without the rows predicted 0."""
    return unpack_row(_scored(docs, model, text_col).where(F.col("score") >= THRESHOLD))


