"""Metrics, ranks, cascades, score joins, bootstraps and gates on worked numbers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import gates as G
from matchloom.operators import metrics as M
from matchloom.operators import ranking as R


def rows_of(spark, target, score, category, other=None):
    data = [(i, float(t), float(s), c, float(o)) for i, (t, s, c, o) in enumerate(zip(target, score, category, other or score))]
    return spark.createDataFrame(data, "row_id long, target double, score double, category string, other double")


def brute_ap(target, score):
    order = sorted(set(score), reverse=True)
    total, ap, tp, k = sum(t > 0.5 for t in target), 0.0, 0, 0
    for s in order:
        here = [t for t, x in zip(target, score) if x == s]
        pos = sum(t > 0.5 for t in here)
        tp, k = tp + pos, k + len(here)
        ap += pos / total * tp / k
    return ap


def test_average_precision(spark):
    rng = random.Random(1)
    t, s, c = [rng.random() < 0.4 for _ in range(300)], [rng.randrange(20) / 20 for _ in range(300)], [rng.choice("AB") for _ in range(300)]
    got = {r["category"]: r["ap"] for r in M.average_precision(rows_of(spark, t, s, c), ["category"]).collect()}
    for name in "AB":
        assert got[name] == pytest.approx(brute_ap([x for x, y in zip(t, c) if y == name], [x for x, y in zip(s, c) if y == name]))
    assert M.macro_average_precision(rows_of(spark, [1, 0, 1, 0], [0.9, 0.1, 0.8, 0.3], "AABB")).first()["macro_ap"] == 1.0
    assert M.macro_average_precision(rows_of(spark, [0, 1, 0, 1, 0], [0.9, 0.5, 0.9, 0.2, 0.5], "AAABB")).first()["macro_ap"] == pytest.approx((brute_ap([0, 1, 0], [0.9, 0.5, 0.9]) + brute_ap([1, 0], [0.2, 0.5])) / 2)
    assert M.macro_average_precision(rows_of(spark, [0, 1], [0.9, 0.5], "AB")).first()["without_positives"] == 1


def test_weights_count_as_copies(spark):
    df = rows_of(spark, [1, 0, 1, 0], [0.9, 0.8, 0.8, 0.1], "AAAA").withColumn("w", F.col("row_id") + 1)
    copies = df.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("w"))))
    assert M.average_precision(df, ["category"], weight=F.col("w")).first()["ap"] == pytest.approx(M.average_precision(copies, ["category"]).first()["ap"])


def test_percentile_rank(spark):
    df = rows_of(spark, [0] * 7, [0.2, 0.2, 0.8, 0.4, 0.1, 0.9, 0.3], ["A", "A", "A", None, "m", "m", "s"])
    got = [r["r"] for r in R.percentile_rank(df, "score", ("category",), "r").orderBy("row_id").collect()]
    assert got == pytest.approx([0.5, 0.5, 1, 1, 0.5, 1, 1])
    assert R.percentile_rank(df.limit(0), "score", ("category",), "r").count() == 0


def test_cascade(spark):
    df = rows_of(spark, [0] * 6, [0.1, 0.9, 0.5, 0.9, 0.3, 0.7], "A" * 6)
    assert [r["row_id"] for r in R.cascade_select(df, 0.0, 0.5).orderBy(F.desc("score"), "row_id").collect()] == [1, 3, 5]
    assert R.cascade_select(df, 0.8, 0.5).count() == 2 and R.cascade_select(df, 0.95, 1.0).count() == 0
    cheap = rows_of(spark, [0] * 4, [0.9, 0.2, 0.7, 0.1], "A" * 4)
    dear = spark.createDataFrame([(0, 0.95), (2, 0.60)], "row_id long, expensive_score double")
    fill = lambda m: [r["second_score"] for r in R.cascade_fill(cheap, dear, m).orderBy("row_id").collect()]
    assert fill("substitute") == [0.95, 0.2, 0.6, 0.1] and fill("zero") == [0.95, 0, 0.6, 0] and np.isnan(fill("nan")[1])
    with pytest.raises(ValueError):
        R.cascade_fill(cheap, dear, "other")
    assert R.calibrate(df, 0.5).first()["threshold"] == pytest.approx(np.quantile([0.1, 0.9, 0.5, 0.9, 0.3, 0.7], 0.5))


def test_strict_join(spark):
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "row_id long, id1 long, id2 long")
    score = lambda rows: spark.createDataFrame(rows, "row_index long, id1 long, id2 long, text_score double")
    good = [(0, 1, 2, 0.5), (1, 3, 4, 0.25)]
    assert R.strict_score_join(pairs, score(good)).count() == 2
    for bad in (good + good[:1], good[:1], good + [(2, 5, 6, 0.1)], [(0, 1, 9, 0.5), good[1]], [(0, 1, 2, float("nan")), good[1]]):
        with pytest.raises(ValueError):
            R.strict_score_join(pairs, score(bad))


def test_combine_and_masks(spark):
    df = rows_of(spark, [0] * 4, [0.1, 0.9, 0.2, 0.8], "AABB", [0.3, 0.7, 0.4, 0.6])
    got = [r[0] for r in df.orderBy("row_id").select(R.combine([F.col("score"), F.col("other")])).collect()]
    assert got == pytest.approx([0.2, 0.8, 0.3, 0.7])
    for weights in ([0.5], [0.7, 0.7], [-0.5, 1.5]):
        with pytest.raises(ValueError):
            R.combine([F.col("score"), F.col("other")], weights)
    masked = R.constant_categories(df.withColumn("predict", F.col("score")), ["A"]).orderBy("row_id").collect()
    assert [r["predict"] for r in masked] == [0, 0, 0.2, 0.8]
    with pytest.raises(ValueError):
        R.constant_categories(df.withColumn("predict", F.col("score")), ["A", "B"])
    with pytest.raises(ValueError):
        R.require_finite(df.withColumn("score", F.lit(float("nan"))), "score")
    assert R.key_mismatch(df, df.where("row_id > 0"), ["row_id"]).first().asDict() == {"only_left": 1, "only_right": 0}


def test_distributions(spark):
    rng = random.Random(2)
    xs, ys = [rng.gauss(0, 1) for _ in range(200)], [round(rng.gauss(0, 1), 1) for _ in range(200)]
    df = rows_of(spark, [rng.random() < 0.5 for _ in xs], xs, ["A"] * 200, ys)
    q = M.quantile_profile(df, "score").first()
    assert (q["p10"], q["p50"], q["deviation"]) == pytest.approx((np.quantile(xs, 0.1), np.quantile(xs, 0.5), np.std(xs)))
    rank = lambda v: [sum(a < x for a in v) + (sum(a == x for a in v) + 1) / 2 for x in v]
    assert M.spearman(df, "score", "other", ["category"]).first()["spearman"] == pytest.approx(np.corrcoef(rank(xs), rank(ys))[0, 1])
    t = [r["target"] for r in df.orderBy("row_id").collect()]
    wins = [(a > b) + 0.5 * (a == b) for a, x in zip(ys, t) if x for b, y in zip(ys, t) if not y]
    assert M.roc_auc(df, ["category"], score="other").first()["auc"] == pytest.approx(np.mean(wins))
    assert M.top_overlap(df, "score", "score", "row_id", ["category"], 0.1).first()["overlap"] == 1.0
    halves = df.withColumn("source", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b"))
    assert M.histogram_overlap(halves.withColumn("score", F.lit(1.0)), "score", "source").first()["overlap"] == 1.0
    assert M.histogram_overlap(halves.withColumn("score", F.when(F.col("source") == "a", 0.0).otherwise(F.col("row_id") + 1.0)), "score", "source").first()["overlap"] < 0.01
    s = M.support_summary(halves, ["score"], "source", "a", "b").first()
    assert 0.8 < s["a_in_b"] <= 1 and s["median_a"] == pytest.approx(np.median(xs[::2]))


def test_prevalence(spark):
    counts = {"A": (80, 20), "B": (10, 90)}
    kept = M.proportional_positives(counts, 0.2)
    assert np.mean([kept[c] / (kept[c] + n) for c, (_, n) in counts.items()]) == pytest.approx(0.2, abs=0.01)
    assert M.proportional_positives(counts, 0.9) == {"A": 80, "B": 10}
    rng = random.Random(9)
    for _ in range(50):
        some = {k: (rng.randint(1, 500), rng.choice([0, 1, 7, 900])) for k in range(rng.randint(1, 6))}
        want = rng.uniform(0.01, 0.99)
        mean = lambda s: np.mean([p * s / (p * s + n) if n else 1.0 for p, n in some.values()])
        low, high = 0.0, 1.0
        for _ in range(80):  # by halving
            low, high = ((low + high) / 2, high) if mean((low + high) / 2) < want else (low, (low + high) / 2)
        got = M.proportional_positives(some, want)
        assert all(abs(got[k] - some[k][0] * low) <= 0.500001 for k in some), (some, want)
    rng = random.Random(3)
    df = rows_of(spark, [rng.random() < 0.6 for _ in range(300)], [rng.random() for _ in range(300)], ["A"] * 300)
    r = M.prevalence_matched(df, ["row_id"], prevalence=0.2, mode="uniform", repeats=4).first()
    negatives = df.where("target < 0.5").count()
    assert r["kept_positives"] == round(negatives * 0.25) and 0 < r["ap"] < 0.5
    for bad in ({"prevalence": 0.0}, {"mode": "x"}, {"repeats": 0}):
        with pytest.raises(ValueError):
            M.prevalence_matched(df, ["row_id"], **bad)
    with pytest.raises(ValueError):
        M.prevalence_matched(df.withColumn("target", F.lit(0.0)), ["row_id"])


def gate_rows(spark, shift):
    rng = random.Random(5)
    out = []
    for i in range(400):
        t = rng.random() < 0.3
        base = rng.gauss(1.0 if t else 0.0, 1.0)
        out.append((i, float(t), base, base + shift * (1 if t else -1), rng.choice("AB")))
    return spark.createDataFrame(out, "row_id long, target double, control double, candidate double, category string")


@pytest.mark.parametrize("shift,verdict", [(0.6, "improvement"), (0.0, "inconclusive"), (-0.6, "regression")])
def test_gate_verdicts(spark, shift, verdict):
    g = G.compare(gate_rows(spark, shift), samples=20)
    assert g.verdict == verdict and g.passed == (verdict != "regression")
    assert G.ordinary(g) == (shift >= 0) and G.stress(g) == (shift > 0) and G.paired_fusion(g) == (shift > 0)
    assert g.ci95_low <= g.difference + 0.05 and g.ci95_high >= g.difference - 0.05
    assert G.combined(g, g) == (shift > 0)


def test_gate_contracts(spark):
    with pytest.raises(ValueError):
        G.compare(gate_rows(spark, 0.0), samples=5)
    with pytest.raises(ValueError):
        G.compare(gate_rows(spark, 0.0).withColumn("target", F.lit(0.0)), samples=10)
    assert G.score_mode(0.50, 0.5019) == "text" and G.score_mode(0.50, 0.503) == "hybrid"
    assert not G.may_submit(0.45, 0.40) and G.may_submit(0.4501, 0.40)


def test_bootstrap_draws_as_many_rows_as_there_are(spark):
    df = gate_rows(spark, 0.1)
    w = M.bootstrap_weights(df, "category", "row_id", 5, 3)
    sizes = {r["category"]: r["count"] for r in df.groupBy("category").count().collect()}
    for r in w.groupBy("category", "sample").agg(F.sum("weight").alias("n"), F.max("place").alias("top")).collect():
        assert r["n"] == sizes[r["category"]] and r["top"] < r["n"]
    a, b = (M.paired_bootstrap(d, "control", "candidate", samples=5, seed=3).orderBy("sample").collect() for d in (df, df.repartition(5)))
    assert [r["difference"] for r in a] == pytest.approx([r["difference"] for r in b])


def test_places_sums_and_quantiles_over_ranged_parts(spark):
    from matchloom.operators import ordering as O

    rng = random.Random(8)
    rows = [(i, rng.choice(["A", "A", "B", None]), rng.randrange(12) / 4, rng.randrange(5)) for i in range(300)] + [(900, "C", 1.5, 1)]
    df = spark.createDataFrame(rows, "i long, g string, x double, w long").repartition(5)
    placed = O.place_within(df, ["g"], [F.desc("x"), F.asc("i")], "p").collect()
    for name in ("A", "B", None, "C"):
        mine = sorted((r for r in placed if r["g"] == name), key=lambda r: r["p"])
        assert [r["p"] for r in mine] == list(range(len(mine))) and [(-r["x"], r["i"]) for r in mine] == sorted((-r["x"], r["i"]) for r in mine)
    levels = df.groupBy("g", "x").agg(F.sum("w").alias("w"))
    for r in O.running_sum(levels, ["g"], "x", "w", "upto").collect():
        assert r["upto"] == sum(w for _, g, x, w in rows if g == r["g"] and x <= r["x"])
    fractions = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    for r in M.exact_quantiles(df, "x", fractions, ["g"]).collect():
        assert r["q"] == pytest.approx(np.quantile([x for _, g, x, _ in rows if g == r["g"]], fractions).tolist())
    assert M.exact_quantiles(df, "x", (0.5,)).first()["q"] == pytest.approx([np.quantile([r[2] for r in rows], 0.5)])
    assert M.exact_quantiles(df.limit(0), "x", (0.5,), ["g"]).collect() == []


def test_finite_scores_folds_and_three_ways(spark):
    df = rows_of(spark, [0, 1], [0.1, 0.2], "AB")
    for bad in (float("inf"), float("-inf"), float("nan"), None):
        with pytest.raises(ValueError):
            R.percentile_rank(df.withColumn("score", F.when(F.col("row_id") == 0, F.lit(bad)).otherwise(F.col("score"))), "score")
    pairs = spark.createDataFrame([(0, 1, 2, 0), (1, 3, 4, 1)], "row_id long, id1 long, id2 long, fold int")
    score = lambda rows: spark.createDataFrame(rows, "row_index long, id1 long, id2 long, text_score double, fold int")
    good = [(1, 3, 4, 0.25, 1), (0, 1, 2, 0.5, 0)]
    assert [r["row_id"] for r in R.strict_score_join(pairs, score(good), ordered=True).collect()] == [0, 1]
    for bad in ([(0, 1, 2, 0.5, 1), good[0]], [(0, 1, 2, float("inf"), 0), good[0]]):
        with pytest.raises(ValueError):
            R.strict_score_join(pairs, score(bad))
    assert R.three_way(pairs, score(good), score(good)).count() == 2
    for bad in (good[:1], good + good[:1]):
        with pytest.raises(ValueError):
            R.three_way(pairs, score(good), score(bad))


def test_release_gates(spark):
    rows = gate_rows(spark, 0.6).withColumns({"id1": F.col("row_id"), "id2": F.col("row_id") + 1})
    gold = rows.select("row_id", "id1", "id2", "target", "category")
    table = lambda c: rows.select(F.col("row_id").alias("row_index"), "id1", "id2", F.col(c).alias("text_score"))
    better, worse = G.ordinary_gate(gold, table("control"), table("candidate")), G.ordinary_gate(gold, table("candidate"), table("control"))
    assert better.passed and not worse.passed and set(worse.failing) == {"A", "B"} and better.gain == pytest.approx(-worse.gain)
    fused = G.fusion_gate(gold, table("control"), table("candidate"), samples=10)
    assert fused.passed and fused.interval[0] > 0 and fused.positive_rate == 1.0
    before = {r["category"]: r["ap"] for r in M.average_precision(rows, ["category"], score="control").collect()}
    assert G.stress_gate(gold, before, table("candidate")).passed and not G.stress_gate(gold, before, table("control")).passed
    assert G.combined_gate(better, better) and not G.combined_gate(better, worse)
    for wrong in (lambda: G.stress_gate(gold, {"A": 0.1}, table("candidate")), lambda: G.ordinary_gate(gold, table("control"), table("candidate").limit(3)), lambda: G.fusion_gate(gold, table("control"), table("candidate"), samples=3)):
        with pytest.raises(ValueError):
            wrong()


def test_samples_without_positives_are_drawn_anew(spark):
    rows = [(i, "A" if i < 12 else "B", float(i in (3, 15)), i / 30, (i * 7 % 30) / 30) for i in range(24)]
    df = spark.createDataFrame(rows, "row_id long, category string, target double, score double, other double")
    got = M.paired_bootstrap(df, "score", "other", samples=12, seed=2, redraws=100).collect()
    assert len(got) == 12 and all(r["difference"] is not None for r in got)
    with pytest.raises(ValueError):
        M.paired_bootstrap(df, "score", "other", samples=12, seed=2, redraws=1)


def test_score_shift_and_means(spark):
    df = rows_of(spark, [0] * 40, [i / 40 for i in range(40)], "AB" * 20, [(i * 7 % 40) / 40 for i in range(40)])
    shift = {r["slice"]: r for r in M.score_shift(df, "score", "score", fraction=0.1).collect()}
    assert set(shift) == {"*", "A", "B"} and all(r["spearman"] == pytest.approx(1) and r["overlap"] == 1 for r in shift.values()) and shift["*"]["take"] == 4
    with pytest.raises(ValueError):
        M.score_shift(df, "score", "other", fraction=0)
    means = {(r["category"], r["feature"]): r["mean"] for r in M.profile_means(df, ["score", "other"], "category").collect()}
    assert means["A", "score"] == pytest.approx(np.mean([i / 40 for i in range(0, 40, 2)]))
