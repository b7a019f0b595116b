"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a logistic model over the words of a text
and the probabilities of the categories before it. While training, those earlier
probabilities are out-of-fold: every training text is scored by models that have not seen it, so
that later models learn from probabilities as unreliable as those they will be given.

Training reads at most ``TRAIN_ROWS`` labelled texts of at most ``TRAIN_CHARS`` characters in all, those with the least hash of their id, as sets of
word hashes; each model keeps the ``FEATURES`` words that separate its category best. Scoring
reads every text, whole, in parallel, without a shuffle.

Edge cases: a null or wordless text gets each model's intercept; a category that has only one
label in training is predicted as that label's rate; no labels: probability 0. Label rows with a null are
left out; of several for one id each category takes its greatest label, and of several texts for one id the one with the least hash teaches. Ids that are null
teach nothing. Repeated rows are scored alike, and a very long text whole. Extra columns are not read, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import map_batches, slices
from matchloom.plans.durable import materialize

TRAIN_ROWS, TRAIN_CHARS, FEATURES, FOLDS, RIDGE, LEAST_TEXTS = 20_000, 100_000_000, 256, 3, 1.0, 4
#: Rows whose products are formed at a time while a model is fitted.
BLOCK = 2048
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> dict[int, int]:
    """Occurrences of a text's words, by their hash."""
    found: dict[int, int] = {}
    for w, n in Counter(_WORD.findall(text.lower()) if text else ()).items():
        h = crc32(w.encode("utf-8", "replace"))
        found[h] = found.get(h, 0) + n
    return found


def strength(n: int) -> float:
    """What ``n`` occurrences of a word count: 1 for one, 2 for three."""
    return math.log2(1 + n)


@dataclass(frozen=True)
class Link:
    """One model of the chain: weights of words, of the earlier probabilities, and the intercept."""

    words: tuple[int, ...]
    weights: tuple[float, ...]
    earlier: tuple[float, ...]
    intercept: float
    threshold: float = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Texts:
    """Training texts as rows of word hashes and what they count."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.words = np.concatenate([x for x, _ in sets]) if sets else np.zeros(0, np.uint32)
        self.values = np.concatenate([x for _, x in sets]) if sets else np.zeros(0, np.float32)
        self.rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x, _ in sets])
        self.n = len(sets)
        self.vocabulary, at = np.unique(self.words, return_inverse=True)
        self.at = at.astype(np.int32)
        del self.words

    def dense(self, features: np.ndarray) -> np.ndarray:
        place = np.full(len(self.vocabulary), -1)
        place[features] = np.arange(len(features))
        column = place[self.at]
        out = np.zeros((self.n, len(features)), dtype=np.float32)
        out[self.rows[column >= 0], column[column >= 0]] = self.values[column >= 0]
        return out

    def best(self, label: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
        """Words whose rates among positive and negative rows differ most, in standard errors."""
        inside = np.zeros(self.n, bool)
        inside[rows] = True
        use = inside[self.rows]
        all_ = np.bincount(self.at[use], minlength=len(self.vocabulary)).astype(float)
        hit = np.bincount(self.at[use & (label[self.rows] > 0)], minlength=len(self.vocabulary)).astype(float)
        p, n = float(label[rows].sum()), float(len(rows))
        a, b = hit / max(p, 1), (all_ - hit) / max(n - p, 1)
        rate = all_ / max(n, 1)
        z = np.abs(a - b) / np.sqrt(rate * (1 - rate) * (1 / max(p, 1) + 1 / max(n - p, 1)) + 1e-9)
        z[all_ < LEAST_TEXTS] = 0
        order = np.argsort(-z, kind="stable")[:most]
        return order[z[order] > 3.0]


def fit_link(texts: Texts, label: np.ndarray, earlier: np.ndarray, rows: np.ndarray, features: int = FEATURES) -> Link:
    rate = float(label[rows].mean()) if len(rows) else 0.0
    none = (0.0,) * earlier.shape[1]
    if rate in (0.0, 1.0):
        return Link((), (), none, 30.0 if rate else -30.0)
    chosen = texts.best(label, rows, features)
    x = np.hstack([texts.dense(chosen)[rows], earlier[rows].astype(np.float32), np.ones((len(rows), 1), np.float32)])
    y, w = label[rows].astype(float), np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(25):  # Newton steps with a ridge, summed over blocks of rows
        gradient, curve = penalty * w, np.diag(penalty)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK].astype(float)
            p = _sigmoid(part @ w)
            gradient = gradient + part.T @ (p - y[at : at + BLOCK])
            curve = curve + (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    k = len(chosen)
    return Link(tuple(int(v) for v in texts.vocabulary[chosen]), tuple(w[:k]), tuple(w[k:-1]), float(w[-1]))


def score_rows(link: Link, texts: Texts, earlier: np.ndarray) -> np.ndarray:
    place = {v: i for i, v in enumerate(texts.vocabulary.tolist())} if texts.n else {}
    total = np.full(texts.n, link.intercept) + earlier @ np.array(link.earlier)
    known = [(place[v], w) for v, w in zip(link.words, link.weights) if v in place]
    if known:
        total += texts.dense(np.array([i for i, _ in known])) @ np.array([w for _, w in known])
    return _sigmoid(total)


def fit_chain(sets: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, folds: np.ndarray, features: int = FEATURES, n_folds: int = FOLDS) -> list[Link]:
    """The models of all categories, in order; later ones are trained on out-of-fold probabilities."""
    texts = Texts(sets)
    earlier = np.zeros((texts.n, 0))
    chain = []
    everyone = np.arange(texts.n)
    for j in range(labels.shape[1]):
        y = labels[:, j]
        chain.append(fit_link(texts, y, earlier, everyone, features))
        unseen = np.zeros(texts.n)
        for k in range(n_folds):
            held = np.flatnonzero(folds == k)
            if len(held):
                own = fit_link(texts, y, earlier, np.flatnonzero(folds != k), features)
                unseen[held] = score_rows(own, texts, earlier)[held]
        chain[-1] = replace(chain[-1], threshold=best_threshold(y, unseen))
        earlier = np.hstack([earlier, unseen[:, None]])
    return chain


def best_threshold(label: np.ndarray, unseen: np.ndarray) -> float:
    """The probability, within 0.2 and 0.8, from which out-of-fold decisions have the best F1; ties go to the one nearest 0.5."""
    best = (-1.0, 0.0, 0.5)
    for t in np.linspace(0.2, 0.8, 25):
        said = unseen >= t
        hit = float((said & (label > 0)).sum())
        f1 = 2 * hit / max(1.0, said.sum() + label.sum())
        best = max(best, (round(f1, 6), -abs(t - 0.5), float(t)))
    return best[2]


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, rows: int, chars: int) -> DataFrame:
    """``h, text`` and the categories of the labelled texts to learn from: ``rows`` rows and ``chars`` characters at most, by the least hash of their id."""
    said = labels.select(labels[id_col].alias("id"), *(c.cast("int").alias(name) for name, c in categories.items())).dropna()
    known = said.groupBy("id").agg(*(F.max(name).alias(name) for name in categories)).withColumn("h", F.xxhash64("id"))
    known = known.orderBy("h", "id").limit(rows)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    least = texts.select("id", "t", F.length("text").alias("n")).join(F.broadcast(known), "id").groupBy("id", "h", *categories).agg(F.min(F.struct("t", "n")).alias("least"))
    upto = F.sum("least.n").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))  # ``rows`` rows at most
    chosen = materialize(least.withColumn("upto", upto).where(F.col("upto") <= chars).select("id", "h", "least.t", *categories), "toxicity-sample")
    return texts.join(F.broadcast(chosen), ["id", "t"]).dropDuplicates(["id", "t"]).select("h", "text", *categories)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
          rows: int = TRAIN_ROWS, features: int = FEATURES, n_folds: int = FOLDS, chars: int = TRAIN_CHARS) -> list[Link]:
    """Train on the sample of ``training_rows``; only its sets of word hashes reach the driver."""
    texts = training_rows(docs, labels, categories, id_col, text_col, rows, chars)
    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [sorted(word_counts(t).items()) for t in part.column(1).to_pylist()]
            words = [np.array([h for h, _ in x], dtype="<u4").tobytes() for x in found]
            values = [np.array([strength(n) for _, n in x], dtype="<f4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary()), pa.array(values, pa.binary()), *part.columns[2:]], names=["h", "words", "strengths", *names])

    found = map_batches(texts, run, "h long, words binary, strengths binary, " + ", ".join(f"{x} int" for x in names))
    held = sorted(found.toArrow().to_pylist(), key=lambda r: (r["h"], r["words"]))
    sets = [(np.frombuffer(r["words"], dtype="<u4"), np.frombuffer(r["strengths"], dtype="<f4")) for r in held]
    values = np.array([[r[x] for x in names] for r in held], dtype=float).reshape(len(held), len(names))
    return fit_chain(sets, values, np.array([r["h"] % n_folds for r in held], dtype=int), features, n_folds) if held else []


class Scorer:
    def __init__(self, chain: list[Link]) -> None:
        self.chain = chain
        self.weights = [dict(zip(x.words, x.weights)) for x in chain]
        self.known = set().union(*self.weights) if chain else set()

    def __call__(self, text: str | None) -> list[float]:
        counts = word_counts(text)
        hit = {h: strength(counts[h]) for h in sorted(self.known & counts.keys())}
        out: list[float] = []
        for link, weights in zip(self.chain, self.weights):
            total = link.intercept + sum(weights.get(h, 0.0) * x for h, x in hit.items()) + sum(w * p for w, p in zip(link.earlier, out))
            out.append(float(_sigmoid(np.float64(total))))
        return out


def predict(docs: DataFrame, chain: list[Link], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the probability ``p_<name>`` of every category, for every row."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for part in slices(batches):
            found = [score(t) or [0.0] * len(names) for t in part.column(1).to_pylist()]
            columns = [pa.array([x[j] for x in found], pa.float64()) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *(f"p_{x}" for x in names)])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"p_{x} double" for x in names))
