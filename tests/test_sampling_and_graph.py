"""Holdouts, quotas, folds, components, augmentation, scoring and fusion on small tables."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom.operators import augmentation as A
from matchloom.operators import canonical as C
from matchloom.operators import fusion as X
from matchloom.operators import graph
from matchloom.operators import sampling as B
from matchloom.operators import scoring
from matchloom.schemas import RAW_ITEM


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + edges[:5] + [(None, 3), (7777, 7777)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.connected_components(df).collect()} == brute_components(edges)
    assert graph.connected_components(df.limit(0)).collect() == []


def test_balanced_quotas():
    q = B.balanced_quotas({"a": 100, "b": 1, "c": 100, "d": 100}, 16)
    assert sum(q.values()) == 16 and q["b"] == 1 and q["a"] >= q["d"]
    assert sum(B.balanced_quotas({"a": 3, "b": 9}, 5).values()) == 5 and sum(B.balanced_quotas({"a": 3, "b": 9}, 50).values()) == 12
    for bad in (({}, 5), ({"a": 3}, 0)):
        with pytest.raises(ValueError):
            B.balanced_quotas(*bad)


def test_quotas_are_even_and_whole():
    rng = random.Random(3)
    for _ in range(200):
        caps = {k: rng.randint(0, 30) for k in "abcdefg"[: rng.randint(1, 7)]}
        most = rng.randint(1, 120)
        if not any(caps.values()):
            continue
        q = B.balanced_quotas(caps, most)
        assert sum(q.values()) == min(most, sum(caps.values())) and all(0 < caps[k] >= n for k, n in q.items())
        open_ = sorted(k for k in q if q[k] < caps[k])
        assert not open_ or [q[k] for k in open_] == sorted((q[k] for k in open_), reverse=True) and max(q.values()) - min(q[k] for k in open_) <= 1
        levels = {k / 9: rng.randint(1, 40) for k in range(rng.randint(1, 9))}
        take = B.level_quotas(levels, most)
        assert sum(take.values()) == min(most, sum(levels.values())) and all(take[k] <= levels[k] for k in levels)
        assert all(take[k] >= min(levels[k], most // len(levels)) for k in levels)


def test_level_quotas():
    counts = {0.0: 1000, 0.5: 30, 1.0: 5}
    take = B.level_quotas(counts, 100)
    assert sum(take.values()) == 100 and take[1.0] == 5 and take[0.5] == 30 and all(take[k] <= counts[k] for k in counts)
    assert B.level_quotas(counts, 10_000) == counts


def pairs_of(spark):
    rows = [(10, 11, 1.0, "A"), (10, 11, 1.0, "A"), (12, 13, 0.0, "A"), (14, 15, 1.0, "B"), (16, 17, 0.0, "B"), (18, 19, 0.0, "B"), (20, 21, 1.0, "C"), (1, 30, 1.0, "A"), (31, 2, 0.0, "B"), (32, 33, 1.0, "")]
    return spark.createDataFrame(rows, "id1 long, id2 long, target double, category string"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")


def test_novel_holdout(spark):
    pairs, seen = pairs_of(spark)
    got = B.novel_holdout(pairs, seen, 4, 1).collect()
    assert len(got) == 4 and {r["category"] for r in got} == {"A", "B"} and [r["row_id"] for r in sorted(got, key=lambda r: r["row_id"])] == [0, 1, 2, 3]
    assert not {1, 2, 3, 4} & {i for r in got for i in (r["id1"], r["id2"])} and sum(r["target"] for r in got) == 2
    assert B.novel_holdout(pairs, seen, 50, 1).count() == 5


def test_natural_rate_and_slices(spark):
    votes = [(10 + 2 * i, 11 + 2 * i, k / 9, "A" if i % 2 else "B") for i, k in enumerate((9, 9, 4, 5, 0, 0, 3, 9))] + [(90, 91, 1.0, "C"), (1, 95, 4 / 9, "A")]
    df, (_, seen) = spark.createDataFrame(votes, "id1 long, id2 long, target double, category string"), pairs_of(spark)
    proxy = B.natural_rate_proxy(df, seen, 3, 1).collect()
    assert len(proxy) == 6 and {r["category"] for r in proxy} == {"A", "B"} and {r["target"] for r in proxy} <= {0.0, 1.0}
    slices = {(r["slice"], r["category"]): r["rows"] for r in B.label_slices(df, seen).collect()}
    assert slices["hard", "A"] == 1 and slices["hard", "B"] == 1 and slices["natural", "C"] == 1


def test_hard_negatives_and_repeats(spark):
    rows = [(0, "A", 1.0, 0.9, 0), (1, "A", 0.0, 0.2, 0), (2, "A", 0.0, 0.8, 1), (3, "A", 0.0, 0.8, 1), (11, "B", 0.0, 0.1, 0), (12, "B", 0.0, 0.4, 1)]
    df = spark.createDataFrame(rows, "row_id long, category string, target double, score double, fold int")
    mined = B.hard_negatives(df, 0.4)
    assert sorted(r["row_id"] for r in mined.collect()) == [2, 12]
    assert sorted(r["row_id"] for r in B.hard_negatives(df, 0.4, train_fold=1).collect()) == [1, 11]
    assert B.repeated(df, mined, 2).count() == 6 + 4


def test_folds_do_not_leak(spark):
    rng = random.Random(4)
    rows = [(1, 2, 1.0, "A"), (2, 3, 0.0, "A"), (5, 5, 1.0, "A")] + [(100 + rng.randrange(150), 300 + rng.randrange(150), float(rng.random() < 0.4), rng.choice("AB")) for _ in range(120)]
    folded = B.component_folds(spark.createDataFrame(rows, "id1 long, id2 long, target double, category string"), 3, 1).cache()
    assert folded.count() == len(rows) and B.fold_leaks(folded).count() == 0
    fold = {(r["id1"], r["id2"]): r["fold"] for r in folded.collect()}
    assert fold[1, 2] == fold[2, 3]
    sizes = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
    assert len(sizes) == 3 and sizes[0] > 0.1 * len(rows)
    leaky = spark.createDataFrame([(1, 2, 0), (2, 3, 1)], "id1 long, id2 long, fold int")
    assert [(r["id"], r["folds"]) for r in B.fold_leaks(leaky).collect()] == [(2, 2)]


def test_small_components_are_dealt_in_turn(spark):
    """Beyond the largest, strata stay balanced whatever their number."""
    rows = [(2 * i, 2 * i + 1, float(i % 4 == 0), "AB"[i % 2]) for i in range(400)] + [(5000, 5001 + k, 1.0, "A") for k in range(9)]
    folded = B.component_folds(spark.createDataFrame(rows, "id1 long, id2 long, target double, category string"), 4, 1, largest=0).collect()
    assert len(folded) == len(rows)
    by = Counter((r["category"], r["target"], r["fold"]) for r in folded if r["id1"] < 5000)
    for stratum in {k[:2] for k in by}:
        sizes = [by[(*stratum, f)] for f in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert len({r["fold"] for r in folded if r["id1"] == 5000}) == 1


def test_category_uniform_batches_and_replay(spark):
    rows = spark.createDataFrame([(i, "A" if i < 50 else "B" if i < 57 else "C", 0.0) for i in range(70)], "row_id long, category string, target double")
    got = B.category_uniform_batches(rows, 8, 3, 2).collect()
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r)
    assert sorted(batches) == list(range(9)) and all(sorted(r["slot"] for r in b) == list(range(8)) and sorted(Counter(r["category"] for r in b).values()) == [4, 4] for b in batches.values())
    assert max(Counter(r["row_id"] for r in got if r["category"] == "A").values()) == 1
    for bad in ((8, 3), (8, 4)):
        with pytest.raises(ValueError):
            B.category_uniform_batches(rows, bad[0], 3, bad[1])
    fixed = spark.createDataFrame([(b, s, b * 10 + s) for b in range(6) for s in range(4)], "batch long, slot int, row_id long")
    again = B.replayed(fixed, 3).collect()
    assert sorted((r["batch"], r["slot"], r["row_id"]) for r in again) == [(b // 3, b % 3 * 4 + s, b * 10 + s) for b in range(6) for s in range(4)]
    for bad in (B.replayed, lambda d, n: B.replayed(d.where("batch < 5 or slot < 3"), 3), lambda d, n: B.replayed(d.limit(0), n)):
        with pytest.raises(ValueError):
            bad(fixed, 4)


def test_degrees(spark):
    df = spark.createDataFrame([(1, 2), (3, 4), (3, 5)], "id1 long, id2 long")
    assert [(r["degree1"], r["degree2"], r["isolated"]) for r in B.degree_stats(df).orderBy("id1", "id2").collect()] == [(1, 1, True), (2, 1, False), (2, 1, False)]


def test_silver_sample_and_micro_batches(spark):
    votes = spark.createDataFrame([(i, i + 1, (i % 10) / 9) for i in range(300)], "id1 long, id2 long, target double")
    sample = B.silver_sample(votes, 50, 1).collect()
    assert len(sample) == 50 and sorted(r["row_id"] for r in sample) == list(range(50)) and len({r["target"] for r in sample}) == 10
    rows = spark.createDataFrame([(i, "AB"[i % 2], float(i % 3 == 0)) for i in range(60)], "row_id long, category string, target double")
    batches = B.micro_batches(rows, 0.3, 10, 1)
    seen = {r["batch"]: r for r in batches.groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("int")).alias("p"), F.countDistinct("category").alias("c")).collect()}
    assert len(seen) == 10 and all(r["n"] == 16 and r["c"] == 1 and r["p"] in (4, 5) for r in seen.values()) and sum(r["p"] for r in seen.values()) == 48


def serialised(spark):
    text = lambda p, n: f"category_{p}: c\nattributes_{p}: " + "; ".join(f"k{i}={i}" for i in range(n)) + "\nend"
    rows = [(i, i, i + 50, float(i != 2), "A" if i < 3 else "B", i % 2, text("a", n), text("b", m)) for i, (n, m) in enumerate([(6, 2), (4, 4), (5, 1), (2, 8)])]
    return spark.createDataFrame(rows, "row_id long, id1 long, id2 long, target double, category string, fold int, text_a string, text_b string")


def test_attribute_dropout(spark):
    df = serialised(spark)
    out = A.attribute_dropout(df, 7).cache()
    made = {r["source_row_id"]: r for r in out.where("is_synthetic").collect()}
    assert out.count() == 7 and set(made) == {0, 1, 3} and sorted(r["row_id"] for r in made.values()) == [4, 5, 6]
    source = {r["row_id"]: r for r in df.collect()}
    for i, r in made.items():
        assert r["fold"] == source[i]["fold"] and r["target"] == 1.0 and "attributes_a: \n" not in r["text_a"]
        assert set(r["text_a"].split("attributes_a: ")[1].split("\n")[0].split("; ")) <= set(source[i]["text_a"].split("attributes_a: ")[1].split("\n")[0].split("; "))
    assert made[0]["text_a"].count("=") == 2 and made[1]["text_a"] == source[1]["text_a"] and made[3]["text_b"] == source[3]["text_b"]


def test_attribute_permutation(spark):
    df = serialised(spark)
    out = {r["row_id"]: r for r in A.attribute_permutation(df, 1.0, 3).collect()}
    for r in df.collect():
        mine = out[r["row_id"]]
        assert mine["selected"] and mine["changed"] and mine["text_a"] != r["text_a"] and sorted(mine["text_a"]) == sorted(r["text_a"])
    assert sorted(map(tuple, A.attribute_permutation(df, 1.0, 3).collect())) == sorted(map(tuple, out.values()))
    assert not any(r["selected"] or r["changed"] for r in A.attribute_permutation(df, 0.0, 3).collect())
    same = df.withColumn("text_a", F.lit("attributes_a: x; x")).withColumn("text_b", F.lit("none"))
    assert not any(r["changed"] for r in A.attribute_permutation(same, 1.0, 3).collect())


def test_near_misses(spark):
    items = C.canonicalize(spark.createDataFrame([(1, "phone rs07c", None, "p"), (2, "phone other zz9", None, "p"), (3, "phone rs07cst4", None, "p"), (4, "phone rs07c", None, "p")] + [(i, f"filler {i}x", None, "f") for i in range(10, 40)], RAW_ITEM))
    pairs = spark.createDataFrame([(1, 2, 1.0, 100, 0), (2, 4, 0.0, 101, 1)], "id1 long, id2 long, target double, row_id long, fold int")
    assert sorted(map(tuple, A.near_misses(pairs, items, 0.1, 0.6).collect())) == [(1, 3)]
    made = A.hard_identifier_negatives(pairs, items, 0.1, 0.6, 10).collect()
    assert [(r["id1"], r["id2"], r["target"], r["fold"], r["source_row_id"], r["row_id"], r["is_synthetic"]) for r in made] == [(1, 3, 0.0, 0, 100, 102, True)]
    assert made[0]["text_a"].startswith("category: p") and made[0]["category"] == "p"
    with pytest.raises(ValueError):
        A.hard_identifier_negatives(pairs, items, 0.1, 0.6, 0)
    assert A.near_misses(pairs, items, 0.1, 0.9).count() == 0


def test_hard_identifier_negatives_search_all_positives(spark):
    """The registered query against a loop over all anchors and donors."""
    from matchloom.plans import sampling_queries as Q

    sf = "/root/testdata/sf0.001"
    edges = sorted((r["id1"], r["id2"]) for r in Q.brand_edges(spark, sf).collect())
    tokens = {r["id"]: set(r["identifier_tokens"] or []) for r in C.canonicalize(Q.raw_items(spark, sf)).select("id", "identifier_tokens").collect()}
    df = Counter(t for own in tokens.values() for t in own)
    rare = {i: [t for t in own if math.log(len(tokens) / df[t]) / math.log(len(tokens)) >= 0.5] for i, own in tokens.items()}
    first = {}
    for row_id, pair in enumerate(edges):
        for i in pair:
            first.setdefault(i, row_id)

    def near(s, t):
        return s != t and len(os.path.commonprefix([s, t])) / max(len(s), len(t)) >= 0.8

    want = {(a, d, first[a]) for a in first for d in tokens if d not in first and any(near(s, t) for s in rare[a] for t in rare[d])}
    got = Q.hard_identifier_negatives(spark, sf).collect()
    assert len(got) == len(want) > 0 and {(r["id1"], r["id2"], r["source_row_id"]) for r in got} == want
    assert sorted(r["row_id"] for r in got) == list(range(len(edges), len(edges) + len(got)))


def test_scorer_takes_real_rows_of_a_fold(spark):
    df = serialised(spark).withColumn("is_synthetic", F.col("row_id") == 0)
    got = scoring.score_pairs(df, scoring.token_overlap_scorer, fold=0).collect()
    assert [r["row_index"] for r in got] == [2] and 0 < got[0]["text_score"] < 1
    assert scoring.score_pairs(df, scoring.token_overlap_scorer).count() == 4
    with pytest.raises(ValueError):
        scoring.score_pairs(df.withColumn("is_synthetic", F.lit(None).cast("boolean")), scoring.token_overlap_scorer, fold=0)


def test_fusion(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i % 3, "AB"[i % 2], float(t), t + rng.gauss(0, 0.4), rng.random()) for i in range(240) for t in [rng.random() < 0.4]]
    df = spark.createDataFrame(rows, "row_id long, fold int, category string, target double, text_score double, noise double")
    facts, out, model = X.train_oof(df, depths=(2, 3), rates=(0.3,), trees=4)
    assert facts["features"] == ["noise", "text_score"] and facts["macro_ap"] > 0.8 and out.count() == 240
    assert X.round_trip_gap(model, df, f"{tmp_path}/model") < 1e-6
    assert X.predict(model, df.drop("noise"), facts["features"]).count() == 240
    with pytest.raises(ValueError):
        X.predict(model, df.drop("noise"), facts["features"], strict=True)
    assert X.two_sample_auc(df, ["text_score"], "category", "A") < 0.65 and X.two_sample_auc(df, ["text_score"], "category", "none") is None
    shifted = df.withColumn("text_score", F.col("text_score") + F.when(F.col("category") == "A", 9).otherwise(0))
    assert X.two_sample_auc(shifted, ["text_score"], "category", "A") > 0.95
    moved = df.withColumns({"oof": F.col("text_score"), "final": F.col("text_score") * 2 + 1})
    shift = {(r["what"], r["slice"]): r for r in X.fusion_shift(model, moved, facts["features"], "oof", "final", fraction=0.1).collect()}
    assert len(shift) == 12 and shift["input", "*"]["spearman"] == pytest.approx(1) and shift["output", "A"]["n"] == 120
    parts = X.ablations(df, depth=2, rate=0.3, trees=4)
    assert parts["score_only"] > 0.8 > parts["features_only"] and parts["fusion"] > 0.8
