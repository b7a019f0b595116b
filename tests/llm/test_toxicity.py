"""The classifier chain: recall on held-out texts, out-of-fold training, and edge cases."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import toxicity


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        words += rng.choices(["vile", "rotten", "nasty"], k=rng.randint(2, 4)) if toxic else []
        words += rng.choices(["spam", "buy"], k=3) if low else []
        rng.shuffle(words)
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, 0 if low else 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string, p_toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


NAMES = ["low_quality", "toxic"]


def categories():
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def test_held_out_documents(spark):
    docs, labels = corpus(random.Random(1), 900)
    odd = [(5000, None, "", 0.0), (5001, "", "", 0.0), (5002, "VILE rotten, nasty!", "", 0.0), (5002, "VILE rotten, nasty!", "", 0.0), (None, "plain words w1 w2", "", 0.0), (5003, "w1 " * 100_000 + "vile vile rotten nasty", "", 0.0)]
    d, l = frames(spark, docs + odd, labels[:600] + labels[:5] + [(7000, None, 1), (7001, 1, None)])
    chain = toxicity.train(d, l, categories())
    assert len(chain) == 2 and len(chain[1].earlier) == 1
    got = toxicity.predict(d, chain, NAMES).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r[c] <= 1 for r in got for c in ("p_low_quality", "p_toxic"))
    p = {r["doc_id"]: r for r in got}
    truth = [(i, t, 1 - q) for i, q, t in labels[600:]]
    said = [(p[i]["p_toxic"] >= chain[1].threshold) == bool(t) for i, t, _ in truth]
    low = [(p[i]["p_low_quality"] >= chain[0].threshold) == bool(q) for i, _, q in truth]
    assert sum(said) / len(said) > 0.97 and sum(low) / len(low) > 0.97
    assert p[5002]["p_toxic"] > 0.5 and p[5003]["p_toxic"] > 0.5 and p[5000]["p_toxic"] == p[5001]["p_toxic"] < 0.5 and p[None]["p_toxic"] < 0.5


def test_scores_of_training_and_serving_agree():
    rng = random.Random(2)
    docs, labels = corpus(rng, 200)
    pairs = [sorted(toxicity.word_counts(t).items()) for _, t, _, _ in docs]
    sets = [(np.array([h for h, _ in x], "<u4"), np.array([toxicity.strength(n) for _, n in x], "<f4")) for x in pairs]
    y = np.array([[1 - q, t] for _, q, t in labels], float)
    chain = toxicity.fit_chain(sets, y, np.arange(200) % 3)
    texts, score = toxicity.Texts(sets), toxicity.Scorer(chain)
    first = toxicity.score_rows(chain[0], texts, np.zeros((200, 0)))
    second = toxicity.score_rows(chain[1], texts, first[:, None])
    for i, (_, t, _, _) in enumerate(docs):
        assert np.allclose(score(t), [first[i], second[i]], atol=1e-6)


def test_out_of_fold_probabilities_come_from_models_that_have_not_seen_the_text():
    sets = [(np.array([i], "<u4"), np.array([1.0], "<f4")) for i in range(30)]  # words that only memorising could use
    y = np.array([[i % 2, i % 2] for i in range(30)], float)
    chain = toxicity.fit_chain(sets, y, np.arange(30) % 3)
    assert abs(chain[1].earlier[0]) < 1.0  # memorised probabilities would have given a large weight


def test_one_label_only_no_labels_and_no_rows(spark):
    docs, labels = corpus(random.Random(3), 60)
    d, l = frames(spark, docs, [(i, 1, 0) for i, _, _ in labels])
    chain = toxicity.train(d, l, categories())
    assert all(r["p_toxic"] < 0.01 for r in toxicity.predict(d, chain, NAMES).collect())
    none = toxicity.train(d, l.limit(0), categories())
    assert none == [] and {r["p_toxic"] for r in toxicity.predict(d, none, NAMES).collect()} == {0.0}
    assert toxicity.predict(d.limit(0), chain, NAMES).count() == 0


def test_training_rows_are_bounded(spark):
    docs, labels = corpus(random.Random(4), 120)
    d, l = frames(spark, docs, labels)
    few = toxicity.train(d, l, categories(), rows=10)
    again = toxicity.train(d.orderBy(F.desc("doc_id")), l, categories(), rows=10)
    assert few == again


def test_sample_with_repeated_ids_contradicting_labels_and_long_texts(spark):
    docs = [(1, "a text", "", 0.0)] * 400 + [(1, f"other {i}", "", 0.0) for i in range(100)] + [(2, "x" * 900, "", 0.0), (3, None, "", 0.0), (4, "fourth", "", 0.0), (None, "lost", "", 0.0)]
    labels = [(1, 1, 0), (1, 0, 0), (1, 1, 1), (2, 1, 0), (2, 1, 0), (3, 0, 1), (4, None, 1), (4, 1, 0), (None, 1, 1), (9, 1, 1)]
    d, l = frames(spark, docs, labels)
    take = lambda rows, chars: toxicity.training_rows(d, l, categories(), "doc_id", "text", rows, chars).collect()
    whole = take(100, 10_000)
    by = {r["text"]: (r["low_quality"], r["toxic"]) for r in whole if r["text"][:1] not in ("a", "o")}
    first = [r for r in whole if r["text"][:1] in ("a", "o")]
    assert len(whole) == 4 and len(first) == 1 and (first[0]["low_quality"], first[0]["toxic"]) == (1, 1)
    assert by == {"x" * 900: (0, 0), "": (1, 1), "fourth": (0, 0)}
    assert len(take(2, 10_000)) <= 2 and sum(len(r["text"]) for r in take(100, 100)) <= 100
    assert toxicity.train(d, l, categories(), rows=3) == toxicity.train(d.orderBy("text"), l.orderBy(F.desc("quality")), categories(), rows=3)
