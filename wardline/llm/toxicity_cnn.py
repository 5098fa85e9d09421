"""Toxicity: a convolutional text classifier in numpy.

Words have hashed embeddings: a word's vector is the sum of the rows of its hashed parts (the word, its first
characters, its last ones). Filters one, two and three words wide slide over the text, their
maxima over the whole text pass leaky units into a logistic one, and everything is trained together by gradient steps; through a maximum
the gradient reaches only the words that made it. Units start alive, so that what no single word shows is learned as well; word
parts start from their log-odds in one of the dimensions. Thresholds for flags are calibrated by language.

For scoring, each distinct word is multiplied with the filters once; a window is then a sum of looked-up rows.

The model is fitted on at most ``PER_CLASS`` labelled rows of each class in the order of a hash, none longer than ``FIT_CHARS``;
scoring covers every row and whole texts, and so do the thresholds by language: every labelled training row counts.

Defined cases: as for the quality classifier; a text without letters has the score of an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, map_texts
from .labelled import crc_mod, fit_ids, join_checked, one_label

PER_CLASS, FIT_CHARS = 3_000, 20_000
THRESHOLD = 0.3
DIM, FILTERS, WIDTHS = 12, 6, (1, 2, 3)
EPOCHS, BATCH, RATE, MIN_DOCS = 4, 32, 0.02, 4
#: Slope of a hidden unit below zero.
LEAK = 0.1
#: Steps of scores in which thresholds are sought, and labelled rows that a language needs for its own.
BINS, MIN_LABELLED = 1_000, 20
#: Words a worker remembers, and words scored at once.
MAX_WORDS, CHUNK = 200_000, 200_000
WORD = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[int]:
    """Hashed parts of a word."""
    p = [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k), *(f"{word[-k:]}$" for k in (4,) if len(word) > k)]
    return [xxhash.xxh32_intdigest(x) for x in p]


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Cnn:
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes with an embedding, sorted
    emb: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    filters: dict[int, np.ndarray] = field(default_factory=lambda: {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS})
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)  # of the logit, from calibration
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, words: list[str]) -> np.ndarray:
        hashes = [parts(w) for w in words]
        size = np.array([len(h) for h in hashes], np.int64)
        flat = np.fromiter((x for h in hashes for x in h), np.int64, int(size.sum()))
        v = np.zeros((len(words), DIM), np.float32)
        if len(self.rows):
            at = np.minimum(np.searchsorted(self.rows, flat), len(self.rows) - 1)
            hit = self.rows[at] == flat
            np.add.at(v, np.repeat(np.arange(len(words)), size)[hit], self.emb[at[hit]])
        return v


def leaky(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, LEAK * x)


class Scorer:
    def __init__(self, model: Cnn):
        self.m = model
        self.width = sum(WIDTHS) * FILTERS
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, self.width), np.float32)  # row 0 is beyond the text
        self.proj = np.concatenate([model.filters[w].transpose(1, 0, 2).reshape(DIM, w * FILTERS) for w in WIDTHS], axis=1)

    def _rows(self, docs: list[list[str]]) -> list[list[int]]:
        new = list({w for d in docs for w in d if w not in self.known})
        if len(self.known) + len(new) > MAX_WORDS:
            self.known.clear()
            self.table = self.table[:1]
            new = list({w for d in docs for w in d})
        if new:
            first = len(self.table)
            self.table = np.concatenate([self.table, self.m.vectors(new) @ self.proj])
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        get = self.known
        return [[get[w] for w in d] for d in docs]

    def pooled(self, docs: list[list[str]]) -> np.ndarray:
        """Maxima of the filters over each document; zero for one without words."""
        ids = self._rows(docs)
        gap = max(WIDTHS) - 1
        size = np.array([len(d) for d in ids], np.int64)
        start = np.concatenate([[0], np.cumsum(size + gap)[:-1]]) if len(ids) else np.zeros(0, np.int64)
        flat = np.zeros(int((size + gap).sum()), np.int64)
        for s, d in zip(start.tolist(), ids, strict=True):
            flat[s : s + len(d)] = d
        rows = self.table[flat]
        out = np.zeros((len(docs), FILTERS * len(WIDTHS)), np.float32)
        full = np.flatnonzero(size)
        if not len(full):
            return out
        inside = np.zeros(len(flat), bool)
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            inside[s : s + n] = True
        at = 0
        for k, w in enumerate(WIDTHS):
            y = rows[:, at : at + FILTERS].copy()
            for j in range(1, w):
                y[:-j] += rows[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            y[~inside] = -np.inf
            out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(y, start[full], axis=0)
        return out

    def logit(self, docs: list[list[str]]) -> np.ndarray:
        m = self.m
        hidden = leaky(self.pooled(docs) + m.bias)
        return (hidden @ m.out + m.base) * m.scale[0] + m.scale[1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        done, chunk, size = [], [], 0
        for t in texts:
            words = tokens(t)
            if chunk and size + len(words) > CHUNK:
                done.append(self.logit(chunk))
                chunk, size = [], 0
            chunk.append(words)
            size += len(words)
        done.append(self.logit(chunk))
        return (1 / (1 + np.exp(-np.clip(np.concatenate(done), -30, 30)))).astype(np.float64)


def fit(docs: list[list[str]], y: np.ndarray, prior: float | None = None, seed: int = 1, epochs: int = EPOCHS) -> Cnn:
    m = Cnn()
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(prior if prior is not None else (y.mean() if len(y) else 0.5), 1e-3, 1 - 1e-3))
        m.base = float(np.log(p / (1 - p)))
        return m
    rng = np.random.default_rng(seed)
    vocab = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    hashes = [parts(w) for w in vocab]
    seqs = [np.array([vocab[w] for w in d], np.int64) for d in docs]
    # Parts in enough documents get a row, which starts from how much likelier they are in class 1.
    count: list[Counter] = [Counter(), Counter()]
    for s, c in zip(seqs, y.astype(int).tolist(), strict=True):
        count[c].update({h for i in set(s.tolist()) for h in hashes[i]})
    both = count[0] + count[1]
    m.rows = np.array(sorted(h for h, n in both.items() if n >= MIN_DOCS), np.int64)
    del both
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = np.array([np.log((count[1][h] + 0.5) / (n1 + 1)) - np.log((count[0][h] + 0.5) / (n0 + 1)) for h in m.rows.tolist()], np.float32)
    m.emb = rng.normal(0, 0.05, (len(m.rows), DIM)).astype(np.float32)
    m.emb[:, 0] = np.clip(odds, -3, 5) / 4
    for w in WIDTHS:
        m.filters[w] = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
        m.filters[w][:, 0, :] += 1.0 / w
    m.out = np.full(FILTERS * len(WIDTHS), 0.5, np.float32)
    m.bias = np.full(FILTERS * len(WIDTHS), -0.5, np.float32)
    # Rows of each word's parts.
    size = np.array([len(h) for h in hashes], np.int64)
    flat = np.fromiter((x for h in hashes for x in h), np.int64, int(size.sum()))
    at = np.minimum(np.searchsorted(m.rows, flat), max(0, len(m.rows) - 1))
    row_of = np.where(m.rows[at] == flat, at, -1) if len(m.rows) else np.full(len(flat), -1)
    begin = np.concatenate([[0], np.cumsum(size)])
    calib = rng.random(len(docs)) < 0.2
    train = np.flatnonzero(~calib & np.array([len(s) > 0 for s in seqs]))
    moment: dict = {}

    def adam(name, value, grad, step, index=None):
        a, b = moment.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        if index is None:
            a[...] = 0.9 * a + 0.1 * grad
            b[...] = 0.99 * b + 0.01 * grad**2
            value -= step * a / (np.sqrt(b) + 1e-6)
        else:  # only the rows that got a gradient
            a[index] = 0.9 * a[index] + 0.1 * grad
            b[index] = 0.99 * b[index] + 0.01 * grad**2
            value[index] -= step * 0.3 * a[index] / (np.sqrt(b[index]) + 1e-6)

    base = np.zeros(1, np.float32)
    gap = max(WIDTHS) - 1
    for epoch in range(epochs):
        step = RATE / (1 + epoch)
        for cut in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            own = [seqs[i] for i in cut]
            lens = np.array([len(s) for s in own])
            start = np.concatenate([[0], np.cumsum(lens + gap)[:-1]])
            words, inv = np.unique(np.concatenate(own), return_inverse=True)
            # vectors of the words of this batch
            owner = np.repeat(np.arange(len(words)), size[words])
            rows = np.concatenate([row_of[begin[w] : begin[w + 1]] for w in words.tolist()])
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            v = np.zeros((len(words) + 1, DIM), np.float32)
            np.add.at(v, owner, m.emb[rows])
            seq = np.full(int((lens + gap).sum()), len(words), np.int64)
            inside = np.zeros(len(seq), bool)
            upto = 0
            for s, n in zip(start.tolist(), lens.tolist(), strict=True):
                seq[s : s + n] = inv[upto : upto + n]
                inside[s : s + n] = True
                upto += n
            x = v[seq]
            pooled = np.empty((len(cut), FILTERS * len(WIDTHS)), np.float32)
            where = np.empty(pooled.shape, np.int64)
            for k, w in enumerate(WIDTHS):
                conv = x @ m.filters[w][0]
                for j in range(1, w):
                    conv[:-j] += (x @ m.filters[w][j])[j:]
                conv[~inside] = -np.inf
                for d, (s, n) in enumerate(zip(start.tolist(), lens.tolist(), strict=True)):
                    top = conv[s : s + n].argmax(0)
                    where[d, k * FILTERS : (k + 1) * FILTERS] = s + top
                    pooled[d, k * FILTERS : (k + 1) * FILTERS] = conv[s + top, np.arange(FILTERS)]
            hidden = leaky(pooled + m.bias)
            q = 1 / (1 + np.exp(-np.clip(hidden @ m.out + base, -30, 30)))
            err = ((q - y[cut]) / len(cut)).astype(np.float32)
            g_out = hidden.T @ err + 1e-4 * m.out
            g_hidden = np.outer(err, m.out) * np.where(hidden > 0, 1, LEAK).astype(np.float32)
            g_word = np.zeros_like(v)
            for k, w in enumerate(WIDTHS):
                g = g_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                pos = where[:, k * FILTERS : (k + 1) * FILTERS]
                g_f = np.zeros_like(m.filters[w])
                for j in range(w):
                    p = np.minimum(pos + j, len(seq) - 1)
                    xs = x[p]  # documents, filters, DIM
                    g_f[j] = np.einsum("df,dfe->ef", g, xs)
                    np.add.at(g_word, seq[p].ravel(), (g[:, :, None] * m.filters[w][j].T[None]).reshape(-1, DIM))
                adam(("f", w), m.filters[w], g_f, step * 0.3)
            adam("bias", m.bias, g_hidden.sum(0), step * 0.5)
            adam("out", m.out, g_out, step)
            adam("base", base, np.array([err.sum()], np.float32), step)
            hot = np.flatnonzero(np.abs(g_word[:-1]).sum(1) > 0)
            touch = np.isin(owner, hot)
            if touch.any():
                got, back = np.unique(rows[touch], return_inverse=True)
                g_emb = np.zeros((len(got), DIM), np.float32)
                np.add.at(g_emb, back, g_word[owner[touch]])
                adam("emb", m.emb, g_emb, step, got)
    m.base = float(base[0])
    sample = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    shift = 0.0 if prior is None else float(np.log(prior / (1 - prior)) - np.log(sample / (1 - sample)))
    _calibrate(m, docs, y, calib, shift)
    return m


def _calibrate(m: Cnn, docs, y, calib, shift: float) -> None:
    """Scales the logit on rows kept apart."""
    s = Scorer(m)
    at = np.flatnonzero(calib)
    if len(at) >= 40 and 0 < y[at].sum() < len(at):
        z = s.logit([docs[i] for i in at])
        # Newton steps for slope and offset, held near what training gave.
        a, b = 1.0, 0.0
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((q - y[at]) * z).sum() + (a - 1), (q - y[at]).sum() + b])
            r = q * (1 - q)
            hess = np.array([[(r * z * z).sum() + 1, (r * z).sum()], [(r * z).sum(), r.sum() + 1]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, g)
        m.scale = (max(float(a), 0.1), float(b) + shift)
    else:
        m.scale = (1.0, shift)


def _base(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))


def _scores(base: DataFrame, model: Cnn) -> DataFrame:
    """doc_id, lang, score"""
    held = base.sparkSession.sparkContext.broadcast(model)

    def make():
        s = Scorer(held.value)
        return lambda texts: [s.score(texts)]

    return map_texts(base, [T.StructField("score", T.DoubleType())], make).select("row.doc_id", "row.lang", "score")


def thresholds(scores: DataFrame, labelled: DataFrame) -> dict[str, float]:
    """The threshold of the best F1 for each language, on all rows of (doc_id, lang, score) with a label (doc_id, y); the middle of ties.

    Scores are counted in thousandths by language, where the rows are. Languages with under ``MIN_LABELLED`` such rows, or with one class only, have none.
    """
    s = join_checked(scores, labelled, "doc_id")
    bins = s.groupBy("lang", F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    # At most BINS + 1 rows a language.
    lang = Window.partitionBy("lang")
    above = lang.orderBy(F.desc("bin"))
    f1 = bins.withColumns({"all": F.sum("n").over(lang), "all1": F.sum("n1").over(lang), "tp": F.sum("n1").over(above), "flagged": F.sum("n").over(above)})
    f1 = f1.where((F.col("all") >= MIN_LABELLED) & (F.col("all1") > 0) & (F.col("all1") < F.col("all"))).withColumn("f1", 2 * F.col("tp") / (F.col("flagged") + F.col("all1")))
    best = f1.withColumn("top", F.max("f1").over(lang)).where("f1 = top").groupBy("lang").agg(F.avg("bin").alias("bin"))
    return {r["lang"]: r["bin"] / BINS for r in best.collect()}


def _fit_sample(base: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int) -> Cnn:
    ids, prior = fit_ids(labels, label, training, per_class)
    # Bounded: 2 * per_class ids, one text each.
    some = base.withColumn("text", F.coalesce("text", F.lit(""))).where(F.length("text") <= FIT_CHARS)
    got = some.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").select("y", "text").toArrow()
    return fit([tokens(t) for t in got.column("text").to_pylist()], got.column("y").to_numpy().astype(float), prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 4, held: int = 2, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> Cnn:
    """A model for other tables than ``docs`` too; ``classify_corpus`` scores the corpus it learns from, once."""
    base, training = _base(docs, id_col, text_col, lang_col), crc_mod("doc_id", fold) != held
    model = _fit_sample(base, labels, label, training, per_class)
    labelled = one_label(labels, label).where(training)
    model.thresholds = thresholds(_scores(join_checked(base, labelled.select("doc_id"), "doc_id"), model), labelled)
    return model


def classify(docs: DataFrame, model: Cnn, fold: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged: the score against the threshold of the row's language."""
    return _judged(_scores(_base(docs, id_col, text_col, lang_col), model), model, fold, held)


def classify_corpus(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 4, held: int = 2, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``train`` and ``classify`` on one table, which is scored once."""
    base, training = _base(docs, id_col, text_col, lang_col), crc_mod("doc_id", fold) != held
    model = _fit_sample(base, labels, label, training, per_class)
    scores = checkpointed(_scores(base, model))
    model.thresholds = thresholds(scores, one_label(labels, label).where(training))
    return _judged(scores, model, fold, held)


def _judged(scores: DataFrame, model: Cnn, fold: int, held: int) -> DataFrame:
    limit = F.lit(THRESHOLD)
    if model.thresholds:
        by_lang = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
        limit = F.coalesce(F.element_at(by_lang, F.col("lang")), limit)
    return scores.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= limit).alias("flagged"),
    )
