"""Queries of ranking metrics, ranks, cascades, score joins, bootstraps and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import gates as G
from matchloom.operators import metrics as M
from matchloom.operators import ranking as R
from matchloom.plans.catalogue import CO_ORDERED, LABELLED, SCORED, labelled, scored, table
from matchloom.plans.registry import query


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def ap_sql(source: str, score: str, by: str = "category", weight: str = "1") -> str:
    """Average precision by group, with ties."""
    return f"""(SELECT {by}, sum(pos * 1.0 / nullif(all_pos, 0) * tp / k) AS ap, max(all_pos) AS positives, max(all_n) AS n FROM (
      SELECT {by}, pos, sum(pos) OVER d AS tp, sum(n) OVER d AS k, sum(pos) OVER e AS all_pos, sum(n) OVER e AS all_n FROM (
        SELECT {by}, {score} AS s, sum(CASE WHEN target > 0.5 THEN {weight} ELSE 0 END)::DOUBLE AS pos, sum({weight})::DOUBLE AS n FROM {source} GROUP BY {by}, {score})
      WINDOW d AS (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY {by})) GROUP BY {by})"""


_PAIR_SCORE = """pair_scores AS (SELECT id1, id2, target, category, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS score
  FROM (SELECT l.*, list_distinct(regexp_extract_all(lower(a.p_name), '[0-9a-zа-я]+')) AS x, list_distinct(regexp_extract_all(lower(b.p_name), '[0-9a-zа-я]+')) AS y
  FROM labelled l JOIN part a ON a.p_partkey = id1 JOIN part b ON b.p_partkey = id2 WHERE NOT contains(category, '|')))"""


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-type pairs with the Jaccard similarity of their names' tokens."""
    from matchloom.functions import similarity as S
    from matchloom.functions import text as T

    p = table(spark, sf_dir, "part").select("p_partkey", T.tokens(F.lower("p_name")).alias("t"))
    a, b = (p.select(F.col("p_partkey").alias(f"id{i}"), F.col("t").alias(f"t{i}")) for i in (1, 2))
    same = labelled(spark, sf_dir).where("not contains(category, '|')")
    return same.join(a, "id1").join(b, "id2").select("id1", "id2", "target", "category", S.jaccard(F.col("t1"), F.col("t2")).alias("score"))


@query("macro_ap", f"WITH {LABELLED}, {_PAIR_SCORE} SELECT category, positives::BIGINT AS positives, n::BIGINT AS rows, round(ap, 6) AS ap FROM {ap_sql('pair_scores', 'score')}")
def macro_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.average_precision(pair_scores(spark, sf_dir), ["category"])
    return _round(per, "ap")


@query("macro_ap_total", f"WITH {SCORED} SELECT count(*) AS categories, sum((positives = 0)::INT) AS without_positives, round(avg(ap), 6) AS macro_ap FROM {ap_sql('scored', 'score')}", bigint="without_positives")
def macro_ap_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.macro_average_precision(scored(spark, sf_dir)), "macro_ap")


@query("roc_auc", f"""WITH {SCORED}, r AS (SELECT category, target, rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0 AS rk FROM scored)
  SELECT category, sum((target > 0.5)::INT) AS positives, sum((target <= 0.5)::INT) AS negatives,
  round((sum(rk) FILTER (target > 0.5) - sum((target > 0.5)::INT) * (sum((target > 0.5)::INT) + 1) / 2.0) / nullif(sum((target > 0.5)::INT) * sum((target <= 0.5)::INT), 0), 6) AS auc FROM r GROUP BY category""", bigint="positives negatives")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.roc_auc(scored(spark, sf_dir), ["category"]), "auc")


@query("label_rates", f"WITH {SCORED} SELECT category, count(*) AS rows, sum(target)::DOUBLE AS positives, round(avg(target), 6) AS rate FROM scored GROUP BY category")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("category").agg(F.count("*").alias("rows"), F.sum("target").alias("positives"), F.round(F.avg("target"), 6).alias("rate"))


@query("score_quantiles", f"""WITH {SCORED} SELECT category, count(*) AS n, min(score) AS least, round(quantile_cont(score, 0.01), 6) AS p01, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS p50,
  round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99, max(score) AS most, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation FROM scored GROUP BY category""")
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.quantile_profile(scored(spark, sf_dir), "score", ["category"]), "p01", "p10", "p50", "p90", "p99", "mean", "deviation")


@query("spearman", f"""WITH {SCORED}, r AS (SELECT category, rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY category ORDER BY other) + (count(*) OVER (PARTITION BY category, other) - 1) / 2.0 AS b FROM scored) SELECT category, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY category""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.spearman(scored(spark, sf_dir), "score", "other", ["category"]), "spearman")


@query("top_overlap", f"""WITH {SCORED}, r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY score DESC, row_id) AS a, row_number() OVER (PARTITION BY category ORDER BY other DESC, row_id) AS b,
  ceil(count(*) OVER (PARTITION BY category) * 0.1::DOUBLE)::BIGINT AS take FROM scored)
  SELECT category, max(take) AS take, sum((a <= take AND b <= take)::INT) AS shared, sum((a <= take OR b <= take)::INT) AS united, round(sum((a <= take AND b <= take)::INT)::DOUBLE / sum((a <= take OR b <= take)::INT), 6) AS overlap FROM r GROUP BY category""", bigint="shared united")
def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.top_overlap(scored(spark, sf_dir), "score", "other", "row_id", ["category"], 0.1), "overlap")


@query("score_shift", f"""WITH {SCORED}, l AS (SELECT category AS slice, row_id, score, other FROM scored UNION ALL SELECT '*', row_id, score, other FROM scored),
  r AS (SELECT slice, rank() OVER (PARTITION BY slice ORDER BY score) + (count(*) OVER (PARTITION BY slice, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY slice ORDER BY other) + (count(*) OVER (PARTITION BY slice, other) - 1) / 2.0 AS y,
  row_number() OVER (PARTITION BY slice ORDER BY score DESC, row_id) AS a, row_number() OVER (PARTITION BY slice ORDER BY other DESC, row_id) AS b, ceil(count(*) OVER (PARTITION BY slice) * 0.1::DOUBLE)::BIGINT AS take FROM l)
  SELECT slice, count(*) AS n, round(corr(x, y), 6) AS spearman, max(take) AS take, round(sum((a <= take AND b <= take)::INT)::DOUBLE / sum((a <= take OR b <= take)::INT), 6) AS overlap FROM r GROUP BY slice""")
def score_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.score_shift(scored(spark, sf_dir), "score", "other", fraction=0.1), "spearman", "overlap")


_TWO = f"{SCORED}, two AS (SELECT *, CASE WHEN row_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM scored)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("source", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b"))


@query("histogram_overlap", f"""WITH {_TWO}, e AS (SELECT list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM two),
  p AS (SELECT source, len(edges) AS edges, least(len(list_filter(edges, lambda x: x <= score)), len(edges) - 1) AS bin FROM two, e),
  s AS (SELECT edges, source, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS share FROM p GROUP BY edges, source, bin),
  m AS (SELECT edges, bin, CASE WHEN count(*) = 2 THEN min(share) ELSE 0 END AS share FROM s GROUP BY edges, bin) SELECT edges, round(sum(share), 6) AS overlap FROM m GROUP BY edges""", integer="edges")
def histogram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.histogram_overlap(_two(spark, sf_dir), "score", "source"), "overlap")


@query("support_summary", f"""WITH {_TWO}, l AS (SELECT source, 'score' AS feature, score AS x FROM two UNION ALL SELECT source, 'other', other FROM two),
  q AS (SELECT feature, source, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.99) AS hi FROM l GROUP BY ALL),
  i AS (SELECT l.feature, l.source, avg((x BETWEEN o.lo AND o.hi)::INT) AS inside FROM l JOIN q o ON o.feature = l.feature AND o.source <> l.source GROUP BY ALL)
  SELECT i.feature, round(max(inside) FILTER (i.source = 'a'), 6) AS a_in_b, round(max(inside) FILTER (i.source = 'b'), 6) AS b_in_a, round(max(med) FILTER (i.source = 'a'), 6) AS median_a, round(max(med) FILTER (i.source = 'b'), 6) AS median_b
  FROM i JOIN q USING (feature, source) GROUP BY i.feature""")
def support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.support_summary(_two(spark, sf_dir), ["score", "other"], "source", "a", "b"), "a_in_b", "b_in_a", "median_a", "median_b")


@query("batch_percentile_rank", f"""WITH {SCORED} SELECT row_id, round((((rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0)::DOUBLE / count(*) OVER (PARTITION BY category))::FLOAT)::DOUBLE, 5) AS rank_share FROM scored""")
def batch_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.percentile_rank(scored(spark, sf_dir), "score", ("category",), "r")
    return ranked.select("row_id", F.round(F.col("r").cast("double"), 5).alias("rank_share"))


@query("cascade_gate", f"WITH {SCORED} SELECT row_id, score FROM scored WHERE score >= 0.6 ORDER BY score DESC, row_id LIMIT (SELECT floor(0.3 * count(*))::BIGINT FROM scored)")
def cascade_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cascade_select(scored(spark, sf_dir), 0.6, 0.3).select("row_id", "score")


@query("cascade_fill", f"""WITH {SCORED}, g AS (SELECT row_id, other FROM scored WHERE score >= 0.6 ORDER BY score DESC, row_id LIMIT (SELECT floor(0.3 * count(*))::BIGINT FROM scored))
  SELECT row_id, coalesce(g.other, score) AS substituted, coalesce(g.other, 0.0) AS zeroed FROM scored LEFT JOIN g USING (row_id)""")
def cascade_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    best = R.cascade_select(rows, 0.6, 0.3).select("row_id", F.col("other").alias("expensive_score"))
    one = R.cascade_fill(rows, best, "substitute", out="substituted").select("row_id", "substituted")
    return one.join(R.cascade_fill(rows, best, "zero", out="zeroed").select("row_id", "zeroed"), "row_id")


@query("threshold_calibrate", f"WITH {SCORED} SELECT round(quantile_cont(score, 0.7), 6) AS threshold FROM scored")
def threshold_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.calibrate(scored(spark, sf_dir), 0.3), "threshold")


@query("strict_score_join", "SELECT doc_id AS row_id, doc_id AS id1, doc_id + 1 AS id2, quality::DOUBLE AS target, (doc_id * 37 % 101) / 101.0::DOUBLE AS text_score FROM labels")
def strict_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    keys = l.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("id1"), (F.col("doc_id") + 1).alias("id2"), F.col("quality").cast("double").alias("target"))
    scores = keys.select(F.col("row_id").alias("row_index"), "id1", "id2", (F.col("id1") * 37 % 101 / 101.0).alias("text_score"))
    return R.strict_score_join(keys, scores)


@query("score_join_faults", """WITH s AS (SELECT doc_id + 1 AS row_id FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id FROM labels) SELECT
  (SELECT count(*) FROM (SELECT row_id FROM s GROUP BY 1 HAVING count(*) > 1)) AS duplicate, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT row_id FROM s)) AS missing,
  (SELECT count(*) FROM s WHERE row_id NOT IN (SELECT doc_id FROM labels)) AS extra, 0 AS not_finite""", bigint="not_finite")
def score_join_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    shape = lambda d: d.select("row_id", F.col("row_id").alias("id1"), F.col("row_id").alias("id2"))
    scores = shape(ids.where("row_id % 3 = 0").select((F.col("row_id") + 1).alias("row_id")).unionByName(ids)).withColumn("text_score", F.lit(0.5))
    return R.join_faults(shape(ids), scores)


@query("score_ensemble", f"WITH {SCORED} SELECT row_id, round(((0.6::DOUBLE * score + 0.4::DOUBLE * other)::FLOAT)::DOUBLE, 5) AS combined FROM scored")
def score_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("row_id", F.round(R.combine([F.col("score"), F.col("other")], [0.6, 0.4]).cast("double"), 5).alias("combined"))


@query("key_mismatch", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right")
def key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.key_mismatch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("constant_categories", f"WITH {SCORED} SELECT row_id, CASE WHEN category IN ('de', 'fr') THEN 0.0 ELSE score END AS predict FROM scored")
def constant_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.constant_categories(scored(spark, sf_dir).select("row_id", "category", F.col("score").alias("predict")), ["de", "fr"]).select("row_id", "predict")


@query("union_dedupe", f"WITH {CO_ORDERED} SELECT id, count(*) AS sides FROM (SELECT id1 AS id, 1 AS side FROM co_ordered UNION SELECT id2, 2 FROM co_ordered) GROUP BY id")
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.plans.catalogue import co_ordered

    p = co_ordered(spark, sf_dir)
    both = p.select(F.col("id1").alias("id"), F.lit(1).alias("side")).unionByName(p.select(F.col("id2").alias("id"), F.lit(2).alias("side"))).dropDuplicates()
    return both.groupBy("id").agg(F.count("*").alias("sides"))


_SAMPLES, _SEED = 40, 11
_DRAWS = f"""sizes AS (SELECT category, count(*) AS n FROM scored GROUP BY category), placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) - 1 AS place FROM scored),
  draws AS (SELECT category, sample, ('0x' || substr(md5(concat_ws('|', category, sample, i, {_SEED})), 1, 8))::BIGINT % n AS place FROM sizes, (SELECT unnest(range(1, {_SAMPLES} + 1)) AS sample), LATERAL (SELECT unnest(range(0, n)) AS i)),
  w AS (SELECT category, sample, place, count(*) AS weight FROM draws GROUP BY ALL), drawn AS (SELECT * FROM placed JOIN w USING (category, place))"""


@query("paired_bootstrap", f"""WITH {SCORED}, {_DRAWS}, a AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'score', 'category, sample', 'weight')} GROUP BY sample), b AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'other', 'category, sample', 'weight')} GROUP BY sample)
  SELECT sample, round(b.ap - a.ap, 6) AS difference FROM a JOIN b USING (sample)""", integer="sample")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.paired_bootstrap(scored(spark, sf_dir), "score", "other", samples=_SAMPLES, seed=_SEED), "difference")


@query("bootstrap_summary", f"""WITH {SCORED}, {_DRAWS}, a AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'score', 'category, sample', 'weight')} GROUP BY sample), b AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'other', 'category, sample', 'weight')} GROUP BY sample)
  SELECT count(*) AS samples, round(quantile_cont(b.ap - a.ap, 0.025), 6) AS ci95_low, round(quantile_cont(b.ap - a.ap, 0.975), 6) AS ci95_high, round(avg((b.ap > a.ap)::INT), 6) AS positive_rate FROM a JOIN b USING (sample)""")
def bootstrap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.bootstrap_summary(M.paired_bootstrap(scored(spark, sf_dir), "score", "other", samples=_SAMPLES, seed=_SEED)), "ci95_low", "ci95_high", "positive_rate")


@query("prevalence_matched_ap", f"""WITH {SCORED}, keep AS (SELECT category, greatest(5, least(count(*) FILTER (target > 0.5), round_even(count(*) FILTER (target <= 0.5) * 0.3 / 0.7, 0)::BIGINT)) AS k FROM scored GROUP BY category),
  d AS (SELECT s.*, draw, row_number() OVER (PARTITION BY s.category, draw, target > 0.5 ORDER BY md5(concat_ws('|', row_id, draw, 5)), row_id) AS r FROM scored s, (SELECT unnest(range(0, 8)) AS draw)),
  kept AS (SELECT d.* FROM d JOIN keep USING (category) WHERE target <= 0.5 OR r <= k) SELECT category, max(positives)::BIGINT AS kept_positives, round(avg(ap), 6) AS ap FROM {ap_sql('kept', 'score', 'category, draw')} GROUP BY category""")
def prevalence_matched_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.prevalence_matched(scored(spark, sf_dir), ["row_id"], prevalence=0.3, mode="uniform", repeats=8, seed=5), "ap")


@query("prevalence_proportional_ap", f"""WITH RECURSIVE {SCORED}, c AS (SELECT category, count(*) FILTER (target > 0.5)::DOUBLE AS p, count(*) FILTER (target <= 0.5)::DOUBLE AS n FROM scored GROUP BY category),
  newton AS (SELECT 0::DOUBLE AS s, 0 AS i UNION ALL SELECT s + greatest(0, 0.3 - (SELECT avg(CASE WHEN n > 0 THEN p * s / (p * s + n) ELSE 1 END) FROM c)) / (SELECT avg(CASE WHEN n > 0 THEN p * n / ((p * s + n) * (p * s + n)) ELSE 0 END) FROM c), i + 1 FROM newton WHERE i < 60),
  keep AS (SELECT category, greatest(5, least(p, round_even(p * least(1, (SELECT max(s) FROM newton)), 0)))::BIGINT AS k FROM c),
  d AS (SELECT s.*, draw, row_number() OVER (PARTITION BY s.category, draw, target > 0.5 ORDER BY md5(concat_ws('|', row_id, draw, 5)), row_id) AS r FROM scored s, (SELECT unnest(range(0, 8)) AS draw)),
  kept AS (SELECT d.* FROM d JOIN keep USING (category) WHERE target <= 0.5 OR r <= k) SELECT category, max(positives)::BIGINT AS kept_positives, round(avg(ap), 6) AS ap FROM {ap_sql('kept', 'score', 'category, draw')} GROUP BY category""")
def prevalence_proportional_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.prevalence_matched(scored(spark, sf_dir), ["row_id"], prevalence=0.3, repeats=8, seed=5), "ap")


def _resampled(samples: int, seed: int) -> str:
    return _DRAWS.replace(f"range(1, {_SAMPLES} + 1)", f"range(1, {samples} + 1)").replace(f"i, {_SEED})", f"i, {seed})")


_BY = f"per AS (SELECT a.category, a.ap AS a, b.ap AS b FROM {ap_sql('scored', 'score')} a JOIN {ap_sql('scored', 'other')} b USING (category))"


@query("oof_gate", f"""WITH {SCORED}, {_resampled(20, 20260812)}, {_BY}, m AS (SELECT avg(a) AS control, avg(b) AS candidate FROM per), lost AS (SELECT category, b - a AS d FROM per ORDER BY d, category LIMIT 1),
  x AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'score', 'category, sample', 'weight')} GROUP BY sample), y AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'other', 'category, sample', 'weight')} GROUP BY sample),
  b AS (SELECT quantile_cont(y.ap - x.ap, 0.025) AS lo, quantile_cont(y.ap - x.ap, 0.975) AS hi, avg((y.ap > x.ap)::INT) AS rate FROM x JOIN y USING (sample)),
  v AS (SELECT CASE WHEN d < -0.02 OR candidate - control < -0.005 THEN 'regression' WHEN candidate - control >= 0.002 THEN 'improvement' ELSE 'inconclusive' END AS verdict FROM m, lost)
  SELECT verdict, verdict <> 'regression' AS passed, round(control, 6) AS control, round(candidate, 6) AS candidate, category AS worst_category, round(d, 6) AS worst_difference, round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high, round(rate, 6) AS positive_rate FROM v, m, lost, b""")
def oof_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumnsRenamed({"score": "control", "other": "candidate"})
    g = G.compare(rows, samples=20)
    values = (g.verdict, g.passed, *(round(x, 6) for x in (g.control, g.candidate)), g.worst_category, *(round(x, 6) for x in (g.worst_difference, g.ci95_low, g.ci95_high, g.positive_rate)))
    return spark.createDataFrame([values], "verdict string, passed boolean, control double, candidate double, worst_category string, worst_difference double, ci95_low double, ci95_high double, positive_rate double")


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold rows and two score tables of them."""
    rows = scored(spark, sf_dir).select("row_id", F.col("row_id").alias("id1"), (F.col("row_id") + 1).alias("id2"), "target", "category", "score", "other")
    score = lambda c: rows.select(F.col("row_id").alias("row_index"), "id1", "id2", F.col(c).alias("text_score"))
    return rows.drop("score", "other"), score("score"), score("other")


@query("ordinary_gate", f"WITH {SCORED}, {_BY}, m AS (SELECT avg(a) AS a, avg(b) AS b, count(*) FILTER (b - a < -0.02) AS failing FROM per) SELECT b >= a AND failing = 0 AS passed, (SELECT count(*) FROM scored) AS rows, round(b - a, 6) AS gain, failing FROM m")
def ordinary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.ordinary_gate(*_gold(spark, sf_dir))
    return spark.createDataFrame([(g.passed, g.rows, round(g.gain, 6), len(g.failing))], "passed boolean, rows long, gain double, failing long")


@query("stress_gate", f"WITH {SCORED}, {_BY}, m AS (SELECT avg(b) AS a, avg(a) AS b, count(*) FILTER (a - b < -0.5) AS failing FROM per) SELECT b > a AND failing = 0 AS passed, (SELECT count(*) FROM scored) AS rows, round(b - a, 6) AS gain, failing FROM m")
def stress_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score against the average precisions that the other was reported with."""
    gold, one, two = _gold(spark, sf_dir)
    before = {r["category"]: r["ap"] for r in M.average_precision(scored(spark, sf_dir), ["category"], score="other").collect()}  # a row a category
    g = G.stress_gate(gold, before, one.unionByName(two.withColumn("row_index", -1 - F.col("row_index"))), 0.5)
    return spark.createDataFrame([(g.passed, g.rows, round(g.gain, 6), len(g.failing))], "passed boolean, rows long, gain double, failing long")


@query("three_way_scores", f"WITH {SCORED} SELECT row_id, row_id AS id1, row_id + 1 AS id2, target, category, score AS control, other AS candidate FROM scored")
def three_way_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.three_way(*_gold(spark, sf_dir)).select("row_id", "id1", "id2", "target", "category", "control", "candidate")


@query("profile_means", f"WITH {_TWO}, l AS (SELECT source, 'score' AS feature, score AS x FROM two UNION ALL SELECT source, 'other', other FROM two) SELECT source, feature, round(avg(x), 6) AS mean FROM l GROUP BY ALL")
def profile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.profile_means(_two(spark, sf_dir), ["score", "other"], "source"), "mean")


_FRACTIONS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


@query("lowest_overlaps", f"""WITH {_TWO}, l AS (SELECT source, 'score' AS feature, score AS x FROM two UNION ALL SELECT source, 'other', other FROM two UNION ALL SELECT source, 'target', target FROM two), e AS (SELECT feature, list_distinct(quantile_cont(x, {_FRACTIONS})) AS edges FROM l GROUP BY feature),
  p AS (SELECT source, feature, len(edges) AS edges, least(len(list_filter(edges, lambda y: y <= x)), len(edges) - 1) AS bin FROM l JOIN e USING (feature)), s AS (SELECT feature, edges, source, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY feature, source) AS share FROM p GROUP BY feature, edges, source, bin),
  m AS (SELECT feature, edges, bin, CASE WHEN count(*) = 2 THEN min(share) ELSE 0 END AS share FROM s GROUP BY feature, edges, bin) SELECT feature, round(sum(share), 6) AS overlap FROM m GROUP BY feature ORDER BY sum(share), feature LIMIT 2""")
def lowest_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two of three features whose histograms overlap least between the sources."""
    return _round(M.lowest_overlaps(_two(spark, sf_dir), ["score", "other", "target"], "source", "a", "b", 2), "overlap").select("feature", "overlap")


_REDRAWN = 6


@query("redrawn_bootstrap", f"""WITH {SCORED}, few AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY category, target > 0.5 ORDER BY row_id) <= CASE WHEN target > 0.5 THEN 2 ELSE 20 END), sizes AS (SELECT category, count(*) AS n, count(*) OVER () AS cats FROM few GROUP BY category),
  placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) - 1 AS place FROM few),
  draws AS (SELECT category, cats, sample, attempt, ('0x' || substr(md5(concat_ws('|', category, sample, i, CASE WHEN attempt = 0 THEN '{_REDRAWN}' ELSE '{_REDRAWN}-' || attempt END)), 1, 8))::BIGINT % n AS place
    FROM sizes, (SELECT unnest(range(1, 21)) AS sample), (SELECT unnest(range(0, 101)) AS attempt), LATERAL (SELECT unnest(range(0, n)) AS i)),
  whole AS (SELECT sample, attempt FROM draws JOIN placed USING (category, place) WHERE target > 0.5 GROUP BY sample, attempt, cats HAVING count(DISTINCT category) = cats), chosen AS (SELECT sample, min(attempt) AS attempt FROM whole GROUP BY sample),
  w AS (SELECT category, sample, place, count(*) AS weight FROM draws JOIN chosen USING (sample, attempt) GROUP BY ALL), drawn AS (SELECT * FROM placed JOIN w USING (category, place)),
  a AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'score', 'category, sample', 'weight')} GROUP BY sample), b AS (SELECT sample, avg(ap) AS ap FROM {ap_sql('drawn', 'other', 'category, sample', 'weight')} GROUP BY sample)
  SELECT sample, round(b.ap - a.ap, 6) AS difference FROM a JOIN b USING (sample)""", integer="sample")
def redrawn_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap differences over rows of few positives: a sample in which a category lost them all is drawn anew."""
    from pyspark.sql import Window

    rows = scored(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("category", F.col("target") > 0.5).orderBy("row_id"))
    few = rows.withColumn("r", place).where(F.col("r") <= F.when(F.col("target") > 0.5, 2).otherwise(20)).drop("r")
    return _round(M.paired_bootstrap(few, "score", "other", samples=20, seed=_REDRAWN, redraws=100), "difference")
