"""Language identification by word-first backoff.

A text's letters are lower-cased and split into words. A word the model knows adds its log
frequency in every language; an unseen word backs off to its character 5-grams, and, where
none of these is known, to 4-grams, 3-grams, 2-grams and single letters, the mean log
frequency of the known ones counting as the word's. A word of which nothing is known adds
nothing. The score is the probability of the best language, all being equally likely beforehand.

Training reads at most ``per_language`` labelled texts of each language (those with the least
hash of id and text, repeated rows counting once), and keeps the most frequent ``words`` words and ``grams`` n-grams of each
length and language; these documented bounds on the labelled sample make the model small enough to broadcast at
any corpus size. All languages are learned. The model stores, for each word and n-gram, the languages that have it only, so it grows with their number
and not with its square. Prediction reads every text, whole, in parallel, without a shuffle.

Edge cases: null text or a text without a letter gives ``und`` with score 0; a model without
languages gives ``und`` for all; ties go to the language first in order; repeated rows are
predicted alike; null ids are ids like others; rows without a language or text teach nothing; a very long text costs a number a word. Extra columns are ignored by ``identify`` and
kept by ``keep_identified``. No rows: no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import CACHE_CHARS, SLICE, bound_batches, map_batches, slices
from matchloom.plans.durable import materialize

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
PER_LANGUAGE, WORDS, GRAMS = 600, 30_000, 8_000
#: Words, and bytes of their frequencies, that a worker's cache holds before it starts anew.
CACHED, CACHED_BYTES = 200_000, 32 << 20
#: Words of a text that are looked up at a time.
PART = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
_JAVA_WORD = r"[\p{L}]+"


@dataclass
class Model:
    """Log frequencies by language. A word or n-gram with number ``k`` lies above the ``floor`` of its kind by ``above[k]`` in the languages ``where[k]`` that have it."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    starts: np.ndarray
    where: np.ndarray
    above: np.ndarray
    floor: np.ndarray

    def __post_init__(self) -> None:
        self._numbers: dict[str, int] = {}
        self._chars = 0
        self._cached = np.zeros((1024, len(self.languages)), dtype=np.float32)
        self._views = tuple(map(memoryview, (self.starts, self.where, self.above)))  # plain numbers by place, faster than from arrays
        self._most = max(1, min(CACHED, CACHED_BYTES // (4 * max(1, len(self.languages)))))

    def _mean(self, found: list[int], kind: int) -> np.ndarray:
        """Mean log frequency by language of known words or n-grams of one kind."""
        starts, where, above = self._views
        total = [0.0] * len(self.languages)
        for k in found:
            for j in range(starts[k], starts[k + 1]):
                total[where[j]] += above[j]
        return self.floor[kind] + np.array(total, dtype=np.float32) / np.float32(len(found))

    def vector(self, word: str) -> np.ndarray:
        """Log frequency by language: of the word, else of its longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return self._mean([known], 0)
        for n in ORDERS:
            padded = f" {word} " if n > 1 else word
            found = [v for i in range(len(padded) - n + 1) if (v := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return self._mean(found, n)
        return np.zeros(len(self.languages), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        """Number the words that the cache does not know; a full cache starts anew."""
        new = {w for w in words if w not in self._numbers}
        chars = sum(map(len, new))
        if len(self._numbers) + len(new) > self._most or self._chars + chars > CACHE_CHARS:
            self._numbers.clear()
            new, self._chars = set(words), 0
            chars = sum(map(len, new))
        self._chars += chars
        need = len(self._numbers) + len(new)
        if need > len(self._cached):
            grown = np.zeros((2 * need, len(self.languages)), dtype=np.float32)
            grown[: len(self._cached)] = self._cached
            self._cached = grown
        for w in new:
            n = self._numbers[w] = len(self._numbers)
            self._cached[n] = self.vector(w)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        try:
            at = [self._numbers[w] for w in words]
        except KeyError:
            self._learn(words)
            at = [self._numbers[w] for w in words]
        total = sum(self._cached[at[i : i + PART]].sum(axis=0, dtype=np.float64) for i in range(0, len(at), PART))
        best = int(np.argmax(total))
        share = float(1.0 / np.exp(np.minimum(total - total[best], 0)).sum())
        return self.languages[best], min(1.0, max(0.0, share))


def training_rows(docs: DataFrame, trainable: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, by the least hash of id and text; equal rows are one."""
    rows = docs.where(trainable & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    rows = rows.select(rows[lang_col].alias("lang"), rows[text_col].alias("text"), F.xxhash64(rows[id_col], rows[text_col]).alias("h"))
    many = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")  # a row a language; its measured size lets Catalyst decide on the join
    # The hash below which about eight times as many rows lie as are wanted: so few reach a language's one task, at any size.
    place = F.shiftrightunsigned("h", 1)
    share = F.least(F.lit(1.0), F.lit(8.0 * per_language) / F.col("n"))
    few = rows.select("lang", "h").join(many, "lang").where(place.cast("double") <= share * float(2**63)).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy(place, "h")
    chosen = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    chosen = materialize(chosen.select("lang", "h"), "language-sample", narrow=True)
    return rows.join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Count the sample's words in Spark, collect the most frequent, and derive n-grams from these."""
    trainable = F.lit(True) if trainable is None else trainable
    sample = training_rows(docs, trainable, id_col, text_col, lang_col, per_language)
    one = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_JAVA_WORD), F.lit(0))).alias("word"))
    counts = one.groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= words)
    return fit([(r["lang"], r["word"], r["n"]) for r in top.collect()], grams)


def fit(counts: list[tuple[str, str, int]], grams: int = GRAMS) -> Model:
    """A model from word counts by language."""
    languages = sorted({x for x, _, _ in counts})
    place = {x: i for i, x in enumerate(languages)}
    tables: list[dict[str, dict[int, int]]] = [{} for _ in range(max(ORDERS) + 1)]

    def count(items: dict[str, dict[int, int]], key: str, at: int, n: int) -> None:
        found = items.get(key)
        if found is None:
            items[key] = {at: n}
        else:
            found[at] = found.get(at, 0) + n

    for lang, word, n in counts:
        at = place[lang]
        count(tables[0], word, at, n)
        for size in ORDERS:
            padded = f" {word} " if size > 1 else word
            for i in range(len(padded) - size + 1):
                count(tables[size], padded[i : i + size], at, n)
    known: list[dict[str, int]] = []
    floor = np.zeros((len(tables), len(languages)), dtype=np.float32)
    starts, where, above = [0], [], []
    for size, items in enumerate(tables):
        whole = [0] * len(languages)
        by: list[list[tuple[int, str]]] = [[] for _ in languages]
        for key, found in items.items():
            for at, n in found.items():
                whole[at] += n
                by[at].append((-n, key))
        kept = items.keys() if not size else {key for mine in by for _, key in heapq.nsmallest(grams, mine)}
        floor[size] = [math.log(0.5 / (n + 0.5 * len(items))) if items else 0.0 for n in whole]
        numbered = {}
        for key in sorted(kept):
            numbered[key] = len(starts) - 1
            for at, n in sorted(items[key].items()):
                where.append(at)
                above.append(math.log((n + 0.5) / 0.5))
            starts.append(len(where))
        known.append(numbered)
    return Model(languages, known[0], {k: v for n in ORDERS for k, v in known[n].items()}, np.array(starts, np.int64), np.array(where, np.int32), np.array(above, np.float32), floor)


def _predictor(model: Model):  # noqa: ANN202
    """A function of Arrow batches ``(id, text)``; the model travels as a broadcast."""
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast((model.languages, model.words, model.grams, model.starts, model.where, model.above, model.floor))
    local: dict = {}

    def own() -> Model:
        if "model" not in local:
            local["model"] = Model(*held.value)
        return local["model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = own()
        for part in slices(batches):
            found = [mine.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return own, run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, _predictor(model)[1], "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has an identified language with enough confidence, all columns kept."""
    own, _ = _predictor(model)

    def confident(texts: pa.Array) -> pa.Array:
        mine, said = own(), []
        for at in range(0, len(texts), SLICE):
            said += [lang != UNKNOWN and score >= least for lang, score in map(mine.predict, texts.slice(at, SLICE).to_pylist())]
        return pa.array(said, pa.bool_())

    bound_batches(docs.sparkSession)
    sure = F.arrow_udf(confident, "boolean")
    return docs.where(sure(docs[text_col].cast("string")))
