"""The pipeline's rows against a plain run of the same decisions."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_simhash import brute_components, brute_print

import corpus_pipeline
from matchloom.llm import langid, packing, quality
from matchloom.llm.queries import held_out, vocabulary


def documents(rng):
    rows = []
    kinds = {"en": ["the", "tion", "ing", "wh", "ou"], "de": ["sch", "ein", "ung", "ö", "keit"]}
    for i in range(120):
        lang = rng.choice(list(kinds))
        words = ["".join(rng.choices(kinds[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 90))]
        rows.append((i, " ".join(words), lang, f"src{i % 4}", None))
    rows += [(9, "unlike " + rows[30][1], "en", "src2", 3), (9, "other " + rows[31][1] + " more", "de", "src3", 4), (None, "lost " + rows[32][1], "en", "src0", 5), (None, "gone " + rows[33][1], None, None, 6)]
    rows += [(200 + k, rows[5][1], "en", "src1", 1) for k in range(6)] + [(300, None, None, None, None), (301, "12 34 " * 30, "en", None, 5), (302, "&&& ### " * 40, "en", "src0", 2), (200, rows[5][1], "en", "src1", 1)]
    return rows


def test_pipeline_matches_a_plain_run(spark, tmp_path):
    rows = documents(random.Random(9))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = langid.train(docs, ~F.coalesce(held_out(), F.lit(False)))
    kept = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= 0.5]
    kept = [r for r in kept if quality.verdict(r[1])]
    prints = [(r[0], brute_print(r[1])) for r in kept]
    least = brute_components(prints)
    kept = {(r[0], r[1]) for i, r in enumerate(kept) if least[i] == r[0]}  # equal rows are one; no component has one id over unlike texts
    encoder = packing.WordEncoder(vocabulary("word_bpe_49k.json"))
    sizes = [(d, len(np.frombuffer(encoder.encode([t])[0], encoder.kind)) + 1) for d, t in kept]
    want, tokens = {}, {}
    for d, n in sizes:
        want[d] = want.get(d, 0) + n
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == want and {(r["doc_id"], r["doc_tokens"]) for r in got} == set(sizes)
    assert sum(d == 9 for d, _ in sizes) == 3 and sum(d is None for d, _ in sizes) == 2
    assert 5 in want and not {300, 301, 302} & set(want) and not set(range(200, 206)) & set(want)


def test_stages_keep_the_columns_of_documents(spark):
    rows = documents(random.Random(10))
    clash = ("__m", "__id", "__fp", "__rank", "measured", "failed_bits", "first_hash", "fingerprint", "rank", "place", "component")
    docs = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]
    assert corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0
