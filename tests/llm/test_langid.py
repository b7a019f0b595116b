"""Language identification: held-out accuracy, backoff, bounds and edge cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.llm import langid

WORDS = {"xx": ["kala", "mira", "toso", "rika", "nuna"], "yy": ["ströff", "grünz", "blitz", "schaff", "kranz"], "zz": ["çelle", "éoire", "aux", "êtreau", "ouvoi"]}


def corpus(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice(WORDS[lang])]) for _ in range(rng.randint(4, 30))]
        out.append((i, " ".join(words).capitalize() + ".", lang, "src", 0.0))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(random.Random(1), 400)
    odd = [(900, None, "xx", "", 0.0), (901, "", None, "", 0.0), (902, " 12 ++ ²½ \n", "yy", "", 0.0), (903, "kala mira", None, "", 0.0), (903, "kala mira", None, "", 0.0), (None, "blitz", None, "", 0.0), (904, "éoire " * 60_000, None, "", 0.0)]
    df = frame(spark, rows + odd)
    model = langid.train(df, F.col("doc_id") % 3 != 1)
    assert model.languages == sorted(WORDS)
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    held = {r["doc_id"]: r for r in got}
    right = [held[d]["lang_pred"] == lang for d, _, lang, _, _ in rows if d % 3 == 1]
    assert sum(right) / len(right) > 0.97
    assert all(held[d]["lang_pred"] == "und" and held[d]["score"] == 0 for d in (900, 901, 902))
    assert held[903]["lang_pred"] == "xx" and held[904]["lang_pred"] == "zz" and held[None]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_unseen_words_back_off_to_ever_shorter_grams():
    model = langid.fit([("xx", "kala", 9), ("xx", "mira", 5), ("yy", "grünz", 7)])
    same = lambda word, row, kind: model.vector(word).tolist() == model._mean([row], kind).tolist()
    assert same("kala", model.words["kala"], 0)
    assert same("kalax", model.grams[" kala"], 5)  # of its 5-grams only this one is known
    assert "xkalx" not in model.words and same("qqü", model.grams["ü"], 1)
    assert model.vector("ж").tolist() == [0.0, 0.0] and " " not in model.grams
    assert model.predict("kalak")[0] == "xx" and model.predict("zgrün")[0] == "yy"


def test_sample_bound_and_no_labels(spark):
    df = frame(spark, corpus(random.Random(2), 200))
    sample = langid.training_rows(df, F.lit(True), "doc_id", "text", "lang", 7)
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == dict.fromkeys(WORDS, 7)
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(bare)
    assert {r["lang_pred"] for r in langid.identify(bare, model).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def plain_vector(counts, word, languages):
    """Log frequencies by the definition, over all words and n-grams."""
    tables = {k: {} for k in (0, 5, 4, 3, 2, 1)}
    for lang, w, n in counts:
        for k in tables:
            padded = w if k < 2 else f" {w} "
            for g in [w] if k == 0 else [padded[i : i + k] for i in range(len(padded) - k + 1)]:
                tables[k].setdefault(g, dict.fromkeys(languages, 0))[lang] += n
    for k, table in tables.items():
        padded = word if k < 2 else f" {word} "
        found = [g for g in ([word] if k == 0 else [padded[i : i + k] for i in range(len(padded) - k + 1)]) if g in table]
        if found:
            whole = {x: sum(v[x] for v in table.values()) for x in languages}
            return [sum(math.log((table[g][x] + 0.5) / (whole[x] + 0.5 * len(table))) for g in found) / len(found) for x in languages]
    return [0.0] * len(languages)


def test_sparse_model_against_the_definition():
    rng = random.Random(4)
    counts = [(lang, w, rng.randint(1, 9)) for lang in WORDS for w in {rng.choice(WORDS[lang]) + rng.choice(["", "a", "k"]) for _ in range(9)}]
    model = langid.fit(counts)
    for word in [*(w for _, w, _ in counts), "kalaz", "zzgrü", "q", "ströffe", "eee"]:
        assert model.vector(word).tolist() == pytest.approx(plain_vector(counts, word, model.languages), abs=1e-4)
    text = "kala grünz ouvoix " * 3
    total = [sum(plain_vector(counts, w, model.languages)[i] for w in text.split()) for i in range(3)]
    share = 1 / sum(math.exp(x - max(total)) for x in total)
    assert model.predict(text)[1] == pytest.approx(share, abs=1e-3)


def test_null_and_repeated_rows_neither_crowd_out_nor_multiply(spark):
    words = [f"kala{k}" for k in range(700)]
    rows = [(None, f"mira {w}", "xx", "", 0.0) for w in words] + [(i, f"toso {w}", "xx", "", 0.0) for i, w in enumerate(words)]
    rows += [(9, "ströff", "yy", "", 0.0)] * 3000 + [(10 + i, f"blitz {i} kranz", "yy", "", 0.0) for i in range(30)]
    df = frame(spark, rows)
    sample = langid.training_rows(df, F.lit(True), "doc_id", "text", "lang", 600)
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"xx": 600, "yy": 31}
    few = langid.training_rows(df, F.lit(True), "doc_id", "text", "lang", 10)
    assert {r["lang"]: r["count"] for r in few.groupBy("lang").count().collect()} == {"xx": 10, "yy": 10}
    assert langid.train(df).languages == ["xx", "yy"]


def test_every_language_is_learned(spark):
    own = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04d}")
    rows = [(i, f"wort{own(i)} ding{own(i)}", f"l{i:04d}", "", 0.0) for i in range(1200)]
    model = langid.train(frame(spark, rows))
    assert len(model.languages) == 1200 and model.above.nbytes < 1 << 20
    assert model.predict(f"ding{own(77)} wort{own(77)}")[0] == "l0077"


def test_cache_changes_nothing(monkeypatch):
    texts = ["kala grünz neu", "ganz andere worte", "kala"] * 3
    counts = [("xx", "kala", 9), ("yy", "grünz", 7)]
    model = langid.fit(counts)
    first = [model.predict(t) for t in texts]
    monkeypatch.setattr(langid, "CACHED", 1)
    assert [langid.fit(counts).predict(t) for t in texts] == first
    small = langid.fit(counts)
    assert [small.predict(t) for t in texts] == first
