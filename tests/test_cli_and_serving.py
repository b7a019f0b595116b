"""The command line and the serving plan, end to end on a small catalogue."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from matchloom import cli
from matchloom.operators import fusion as X
from matchloom.operators import pairs as P
from matchloom.operators.canonical import canonicalize
from matchloom.operators.scoring import token_overlap_scorer
from matchloom.plans.serving import predict_pairs
from matchloom.schemas import RAW_ITEM


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("catalogue"))
    rng = random.Random(2)
    items = [(i, f"{rng.choice(['red', 'blue', 'green'])} {rng.choice(['bolt', 'nut', 'ring'])} m{i // 2}", json.dumps({"Бренд": f"b{i // 2 % 7}", "Вес": f"{i // 2} кг", "Цвет": "красный"}, ensure_ascii=False), "AB"[i // 2 % 2]) for i in range(160)]
    spark.createDataFrame(items, RAW_ITEM).write.parquet(f"{at}/items")
    pairs = [(2 * i, 2 * i + 1, 1.0) for i in range(50)] + [(2 * i, 2 * (i + 2 * rng.randint(1, 10)) + 1, 0.0) for i in range(50)]
    spark.createDataFrame(pairs, "id1 long, id2 long, target double").write.parquet(f"{at}/matches")
    return at


def run(spark, capsys, *arguments):
    assert cli.main(list(arguments), spark) == 0
    return json.loads(capsys.readouterr().out)


def test_preparation_to_fusion(spark, catalogue, capsys):
    at = catalogue
    assert run(spark, capsys, "doctor", "--inputs", f"{at}/items")["inputs"][0]["rows"] == 160
    assert cli.main(["doctor", "--inputs", f"{at}/none"], spark) == 2
    capsys.readouterr()
    assert run(spark, capsys, "canonicalize", "--items", f"{at}/items", "--ids-from", f"{at}/matches", "--output", f"{at}/canonical")["parse_errors"] == 0
    folds = run(spark, capsys, "make-folds", "--items", f"{at}/items", "--matches", f"{at}/matches", "--output", f"{at}/folds", "--folds", "3")
    assert folds["rows"] == 100 and len(folds["folds"]) == 3
    assert run(spark, capsys, "prepare-pairs", "--items", f"{at}/canonical", "--pairs", f"{at}/folds", "--output", f"{at}/pairs")["rows"] == 100
    assert run(spark, capsys, "prepare-pairs", "--items", f"{at}/items", "--pairs", f"{at}/folds", "--output", f"{at}/texts", "--text-only")["rows"] == 100
    assert run(spark, capsys, "score-pairs", "--pairs", f"{at}/pairs", "--output", f"{at}/scores")["rows"] == 100
    assert run(spark, capsys, "mine-hard-negatives", "--gold", f"{at}/pairs", "--oof", f"{at}/scores", "--output", f"{at}/hard")["rows"] > 0
    same = run(spark, capsys, "research-assess-candidate", "--gold", f"{at}/pairs", "--control", f"{at}/scores", "--candidate", f"{at}/scores", "--samples", "10")
    assert same["verdict"] == "inconclusive" and same["difference"] == 0
    assert run(spark, capsys, "research-compare", "--gold", f"{at}/pairs", "--control", f"{at}/scores", "--candidate", f"{at}/scores", "--samples", "10")["ci95_low"] == 0
    d = run(spark, capsys, "research-diagnose-scores", "--gold", f"{at}/pairs", "--oof", f"{at}/scores", "--final", f"{at}/scores", "--top-fraction", "0.1")
    assert all(c["overlap"] == 1.0 for c in d["categories"])
    assert run(spark, capsys, "research-graph-diagnostics", "--gold", f"{at}/pairs", "--scores", f"{at}/scores")["edges"] == 100
    facts = run(spark, capsys, "train-fusion", "--pairs", f"{at}/pairs", "--oof", f"{at}/scores", "--output", f"{at}/fusion", "--depths", "2", "--trees", "3")
    assert facts["macro_ap"] > 0.8 and len(facts["digest"]) == 64
    hold = run(spark, capsys, "evaluate-holdout", "--pairs", f"{at}/pairs", "--text", f"{at}/scores", "--hybrid", f"{at}/scores")
    assert hold["mode"] == "text"
    assert run(spark, capsys, "materialize-augmentation", "--kind", "attribute-dropout", "--pairs", f"{at}/pairs", "--output", f"{at}/dropout")["rows"] == 150
    shifted = spark.read.parquet(f"{at}/pairs").withColumn("source", F.when(F.col("row_id") % 2 == 0, "x").otherwise("y"))
    shifted.write.parquet(f"{at}/shifted")
    s = run(spark, capsys, "research-proxy-shift", "--pairs", f"{at}/shifted", "--features", "name_token_jaccard", "name_char_jaccard", "--least", "5")
    assert s["sources"] == ["x", "y"] and 0 <= s["overlap"]["name_token_jaccard"] <= 1


def test_holdouts(spark, catalogue, capsys):
    at = catalogue
    spark.createDataFrame([(0, 1, 1.0)], "id1 long, id2 long, target double").write.parquet(f"{at}/gold")
    common = ("--items", f"{at}/items", "--matches", f"{at}/matches", "--gold", f"{at}/gold")
    assert run(spark, capsys, "make-novel-holdout", *common, "--output", f"{at}/novel", "--max-rows", "20")["rows"] == 20
    assert run(spark, capsys, "make-public-proxy", *common, "--output", f"{at}/proxy")["rows"] > 50
    assert run(spark, capsys, "research-llm-diagnostics", *common, "--output", f"{at}/slices")["rows"] >= 2
    assert run(spark, capsys, "sample-silver", "--matches", f"{at}/matches", "--output", f"{at}/silver", "--max-rows", "30")["rows"] == 30


def test_serving(spark, catalogue):
    items = spark.read.schema(RAW_ITEM).parquet(f"{catalogue}/items")
    pairs = spark.read.parquet(f"{catalogue}/matches").select(F.monotonically_increasing_id().alias("row_id"), "id1", "id2", "target").cache()
    text = predict_pairs(items, pairs, [token_overlap_scorer])
    assert text.count() == 100
    both = {r["row_id"]: r["predict"] for r in predict_pairs(items, pairs, [token_overlap_scorer, token_overlap_scorer]).collect()}
    assert all(abs(both[r["row_id"]] - r["predict"]) < 1e-6 for r in text.collect())
    canon = canonicalize(items)
    made = P.features(P.join_items(pairs.withColumn("fold", (F.col("row_id") % 2).cast("int")), P.prepared_items(canon))).withColumn("text_score", F.col("name_token_jaccard")).withColumn("transductive_identifier_df", F.lit(0.0))
    facts, _, model = X.train_oof(made, depths=(2,), trees=2)
    fused = predict_pairs(items, pairs, [token_overlap_scorer], model, facts["features"], constant_categories=["B"], constant=0.25)
    assert fused.count() == 100 and fused.where("predict = 0.25").count() >= 1
    with pytest.raises(ValueError):
        predict_pairs(items.where("id > 3"), pairs, [token_overlap_scorer])
    for bad in ({"two_scores": True}, {"constant_categories": ["A"], "constant": 1.0}):
        with pytest.raises(ValueError):
            predict_pairs(items, pairs, [token_overlap_scorer], **bad)
