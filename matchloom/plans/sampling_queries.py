"""Queries of holdouts, samples, graphs, folds, augmentation, scoring and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import augmentation as A
from matchloom.operators import canonical as C
from matchloom.operators import fusion as X
from matchloom.operators import graph
from matchloom.operators import metrics as M
from matchloom.operators import pairs as P
from matchloom.operators import sampling as B
from matchloom.operators import scoring
from matchloom.plans.catalogue import BRAND_EDGES, LABELLED, SCORED, SEEN, VOTES, brand_edges, labelled, raw_items, scored, seen_ids, table, votes
from matchloom.plans.durable import materialize
from matchloom.plans.registry import query
from matchloom.plans.text_queries import FEATURE_ITEM, all_features_sql, item_sql

_UNSEEN = "id1 NOT IN (SELECT id FROM seen) AND id2 NOT IN (SELECT id FROM seen)"


@query("stratified_sample", f"WITH {LABELLED} SELECT id1, id2, category, target FROM labelled QUALIFY row_number() OVER (PARTITION BY category, target ORDER BY md5(concat_ws('|', id1, id2, 3)), id1, id2) <= 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stratified(labelled(spark, sf_dir), ["category", "target"], F.lit(50), ["id1", "id2"], 3).select("id1", "id2", "category", "target")


@query("novel_holdout", f"""WITH {LABELLED}, {SEEN}, e AS (SELECT DISTINCT id1, id2, target, category FROM labelled WHERE {_UNSEEN}), c AS (SELECT category FROM e GROUP BY 1 HAVING count(DISTINCT target) = 2),
  f AS (SELECT * FROM e WHERE category IN (SELECT category FROM c)), s AS (SELECT category, target, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category, target ORDER BY md5(concat_ws('|', id1, id2, 3)), id1, id2) AS rk FROM f)
  SELECT id1, id2, target, category, row_number() OVER (ORDER BY category, target, id1, id2) - 1 AS row_id FROM r WHERE rk <= (SELECT least(20, min(n)) FROM s)""")
def novel_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as give every stratum as many as the smallest has, twenty at most: the quotas are then equal, which SQL can say."""
    eligible = B.eligible_pairs(labelled(spark, sf_dir), seen_ids(spark, sf_dir))
    size, least = eligible.groupBy("category", "target").count().agg(F.count("*"), F.min("count")).first()
    return B.balanced_sample(eligible, max(1, size * min(20, least or 0)), 3).select("id1", "id2", "target", "category", "row_id")


@query("natural_rate_proxy", f"""WITH {VOTES}, {SEEN}, e AS (SELECT DISTINCT id1, id2, (round(target * 9)::INT = 9)::INT::DOUBLE AS target, category FROM votes WHERE {_UNSEEN}), c AS (SELECT category FROM e GROUP BY 1 HAVING count(DISTINCT target) = 2)
  SELECT id1, id2, target, category FROM e WHERE category IN (SELECT category FROM c) QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', id1, id2, 4)), id1, id2) <= 200""")
def natural_rate_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.natural_rate_proxy(votes(spark, sf_dir), seen_ids(spark, sf_dir), 200, 4).select("id1", "id2", "target", "category")


@query("label_slices", f"""WITH {VOTES}, {SEEN}, k AS (SELECT *, round(target * 9)::INT AS k FROM votes WHERE {_UNSEEN}), s AS (SELECT 'natural' AS slice, * FROM k UNION ALL SELECT 'hard', * FROM k WHERE k IN (4, 5))
  SELECT slice, category, count(*) AS rows, sum((k >= 5)::INT) AS positives, round(avg((k >= 5)::INT), 6) AS rate FROM s GROUP BY ALL""", bigint="positives")
def label_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.label_slices(votes(spark, sf_dir), seen_ids(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query("category_quotas", f"""WITH {LABELLED}, s AS (SELECT category, CASE WHEN id1 % 2 = 0 THEN 'x' ELSE 'y' END AS source, count(*) AS n FROM labelled GROUP BY ALL)
  SELECT category, least(min(n), 500) AS take FROM s GROUP BY category HAVING count(*) = 2 AND least(min(n), 500) >= 100""")
def category_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.common_category_quotas(labelled(spark, sf_dir).withColumn("source", F.when(F.col("id1") % 2 == 0, "x").otherwise("y")), 500, 100)


@query("hard_negatives", f"""WITH {SCORED}, n AS (SELECT * FROM scored WHERE target <= 0.5), q AS (SELECT greatest(1, floor(count(*) * 0.5 / count(DISTINCT category))::BIGINT) AS k FROM n)
  SELECT row_id, category, score FROM n, q QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, row_id) <= k""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hard_negatives(scored(spark, sf_dir), 0.5).select("row_id", "category", "score")


@query("repeated_negatives", f"""WITH {SCORED}, n AS (SELECT * FROM scored WHERE target <= 0.5), q AS (SELECT greatest(1, floor(count(*) * 0.5 / count(DISTINCT category))::BIGINT) AS k FROM n),
  m AS (SELECT row_id FROM n, q QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, row_id) <= k) SELECT row_id, 1 + 2 * (row_id IN (SELECT row_id FROM m))::INT AS times FROM scored""", bigint="times")
def repeated_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return B.repeated(rows, B.hard_negatives(rows, 0.5), 2).groupBy("row_id").agg(F.count("*").alias("times"))


@query("silver_sample", f"""WITH {VOTES}, c AS (SELECT target, count(*) AS n FROM votes GROUP BY target), b AS (SELECT *, least(n, 20000, 5000 // (SELECT count(*) FROM c)) AS base FROM c),
  r AS (SELECT *, n - base AS spare, least(5000 - sum(base) OVER (), sum(n - base) OVER ()) AS rest, sum(n - base) OVER () AS room FROM b), p AS (SELECT *, (rest * spare // greatest(1, room))::BIGINT AS share FROM r),
  q AS (SELECT target, base + share + (share < spare AND count(*) FILTER (share < spare) OVER (ORDER BY target ROWS UNBOUNDED PRECEDING) <= rest - sum(share) OVER ())::INT AS take FROM p),
  x AS (SELECT v.*, row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws('|', id1, id2, 9)), id1, id2) AS rk FROM votes v)
  SELECT id1, id2, target, category, row_number() OVER (ORDER BY md5(concat_ws('|', id1, id2, '9-order')), id1, id2) - 1 AS row_id FROM x JOIN q USING (target) WHERE rk <= take""")
def silver_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.silver_sample(votes(spark, sf_dir), 5000, 9)


@query("connected_components", f"""WITH RECURSIVE {BRAND_EDGES}, e AS (SELECT id1 AS a, id2 AS b FROM brand_edges UNION SELECT id2, id1 FROM brand_edges), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
  SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(brand_edges(spark, sf_dir), "id1", "id2")


@query("component_degree", f"""WITH {BRAND_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT id1 AS id FROM brand_edges UNION ALL SELECT id2 FROM brand_edges) GROUP BY id)
  SELECT count(*) AS edges, sum((a.degree = 1 AND b.degree = 1)::INT) AS isolated, sum((least(a.degree, b.degree) = 1)::INT) AS with_leaf, max(greatest(a.degree, b.degree)) AS most FROM brand_edges JOIN d a ON a.id = id1 JOIN d b ON b.id = id2""", bigint="isolated with_leaf")
def component_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.degree_stats(brand_edges(spark, sf_dir))
    return d.agg(F.count("*").alias("edges"), F.sum(F.col("isolated").cast("int")).alias("isolated"), F.sum((F.least("degree1", "degree2") == 1).cast("int")).alias("with_leaf"), F.max(F.greatest("degree1", "degree2")).alias("most"))


@query("fold_leak_check", f"""WITH {BRAND_EDGES}, f AS (SELECT id1, id2, (id1 + id2) % 3 AS fold FROM brand_edges) SELECT id, count(DISTINCT fold) AS folds FROM (SELECT id1 AS id, fold FROM f UNION ALL SELECT id2, fold FROM f) GROUP BY id HAVING count(DISTINCT fold) > 1""")
def fold_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold_leaks(brand_edges(spark, sf_dir).withColumn("fold", (F.col("id1") + F.col("id2")) % 3))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = brand_edges(spark, sf_dir).withColumn("target", F.pmod(F.col("id1") + F.col("id2"), F.lit(2)).cast("double"))
    return B.component_folds(edges, 5, 13)


@query("component_folds")
def component_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir)


@query("component_folds_leaks", "SELECT 0::BIGINT AS id, 0::BIGINT AS folds WHERE false")
def component_folds_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No item of the component folds is in two of them."""
    return B.fold_leaks(_folded(spark, sf_dir))


@query("fold_stats")
def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("rows"), F.avg("target").alias("rate"), F.countDistinct("component").alias("components"))


_MICRO = f"""{SCORED}, pools AS (SELECT category, sum((target > 0.5)::INT) AS p, sum((target <= 0.5)::INT) AS m FROM scored GROUP BY category HAVING sum((target > 0.5)::INT) > 0 AND sum((target <= 0.5)::INT) > 0),
  ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', category, 17)), category) - 1 AS c, count(*) OVER () AS cats FROM pools),
  sched AS (SELECT r.*, batch, (floor((batch + 1) * 4.8::DOUBLE) - floor(batch * 4.8::DOUBLE))::BIGINT AS want, slot, batch // cats AS turn FROM ranked r, (SELECT unnest(range(0, 40)) AS batch), (SELECT unnest(range(0, 16)) AS slot) WHERE batch % cats = c),
  asked AS (SELECT batch, slot, category, slot < want AS pos, CASE WHEN slot < want THEN (turn * 16 + slot) % p ELSE (turn * 16 + slot - want) % m END AS place FROM sched),
  placed AS (SELECT category, target > 0.5 AS pos, row_id, row_number() OVER (PARTITION BY category, target > 0.5 ORDER BY md5(concat_ws('|', row_id, 17)), row_id) - 1 AS place FROM scored),
  micro AS (SELECT batch, slot, category, row_id, pos FROM asked JOIN placed USING (category, pos, place))"""


@query("micro_batches", f"WITH {_MICRO} SELECT * FROM micro", integer="batch slot")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.micro_batches(scored(spark, sf_dir), 0.3, 40, 17)


@query("replayed_batches", f"WITH {_MICRO} SELECT batch // 4 AS batch, batch % 4 * 16 + slot AS slot, category, row_id, pos FROM micro", bigint="batch", integer="slot")
def replayed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The micro-batches again, four as one."""
    fixed = materialize(B.micro_batches(scored(spark, sf_dir), 0.3, 40, 17), "micro-batches")
    return B.replayed(fixed, 4)


@query("category_uniform_batches", f"""WITH {SCORED}, sizes AS (SELECT category, count(*) AS n FROM scored GROUP BY category), ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', category, 19)), category) - 1 AS c, count(*) OVER () AS cats, sum(n) OVER () AS whole FROM sizes),
  asked AS (SELECT category, n, cats, ask, k, ((ask // cats) * 16 + k) % n AS place FROM (SELECT unnest(range(0, ((max(whole) + 31) // 32 * 2)::BIGINT)) AS ask FROM ranked) a, ranked, (SELECT unnest(range(0, 16)) AS k) WHERE ask % cats = c),
  placed AS (SELECT category, row_id, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', row_id, 19)), row_id) - 1 AS place FROM scored)
  SELECT ask // 2 AS batch, ask % 2 * 16 + k AS slot, category, row_id FROM asked JOIN placed USING (category, place)""", bigint="batch slot")
def category_uniform_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 rows, half from each of two categories in turn."""
    return B.category_uniform_batches(scored(spark, sf_dir), 32, 19, 2)


_TOKEN = "CASE WHEN p_partkey % 9 = 0 THEN 'ab' || (p_partkey % 97) || 'c' ELSE 'ab' || (p_partkey % 97) || 'cst' || (p_partkey % 7) END"


def _token_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.expr(_TOKEN)).alias("identifier_tokens"))


@query("prefix_near_miss_join", f"""WITH {BRAND_EDGES}, members AS (SELECT id1 AS id FROM brand_edges UNION SELECT id2 FROM brand_edges), i AS (SELECT p_partkey AS id, {_TOKEN} AS token FROM part), df AS (SELECT token, count(*) AS df FROM i GROUP BY token),
  n AS (SELECT count(*)::DOUBLE AS n FROM part), rare AS (SELECT id, token FROM i JOIN df USING (token), n WHERE ln(n / df) / ln(n) >= 0.3),
  x AS (SELECT a.id AS anchor, a.token AS s, b.id AS donor, b.token AS t FROM rare a JOIN rare b ON left(a.token, ceil(length(a.token) * 0.6::DOUBLE)::INT) = left(b.token, ceil(length(a.token) * 0.6::DOUBLE)::INT) AND a.token <> b.token
    WHERE a.id IN (SELECT id FROM members) AND b.id NOT IN (SELECT id FROM members))
  SELECT DISTINCT anchor, donor FROM x WHERE len(list_filter(range(1, least(length(s), length(t)) + 1), lambda k: left(s, k) = left(t, k)))::DOUBLE / greatest(length(s), length(t)) >= 0.6""")
def prefix_near_miss_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.near_misses(brand_edges(spark, sf_dir), _token_items(spark, sf_dir), 0.3, 0.6)


_HARD = f"""{FEATURE_ITEM}, {BRAND_EDGES}, edge AS (SELECT id1, id2, row_number() OVER (ORDER BY id1, id2) - 1 AS row_id FROM brand_edges), members AS (SELECT id1 AS id, row_id FROM edge UNION ALL SELECT id2, row_id FROM edge),
  first AS (SELECT id, min(row_id) AS source_row_id FROM members GROUP BY id), i AS (SELECT id, unnest(idt) AS token FROM feat), df AS (SELECT token, count(*) AS df FROM i GROUP BY token), n AS (SELECT count(*)::DOUBLE AS n FROM part),
  rare AS (SELECT id, token FROM i JOIN df USING (token), n WHERE ln(n / df) / ln(n) >= 0.5),
  x AS (SELECT a.id AS id1, a.token AS s, b.id AS id2, b.token AS t FROM rare a JOIN rare b ON left(a.token, ceil(length(a.token) * 0.8::DOUBLE)::INT) = left(b.token, ceil(length(a.token) * 0.8::DOUBLE)::INT) AND a.token <> b.token
    WHERE a.id IN (SELECT id FROM first) AND b.id NOT IN (SELECT id FROM first)),
  near AS (SELECT DISTINCT id1, id2 FROM x WHERE len(list_filter(range(1, least(length(s), length(t)) + 1), lambda k: left(s, k) = left(t, k)))::DOUBLE / greatest(length(s), length(t)) >= 0.8),
  made AS (SELECT id1, id2, 0.0::DOUBLE AS target, 0 AS fold, source_row_id, (SELECT max(row_id) FROM edge) + row_number() OVER (ORDER BY source_row_id, id1, id2) AS row_id FROM near JOIN first ON id = id1)"""


@query("hard_identifier_negatives", f"""WITH {_HARD} SELECT row_id, id1, id2, target, fold, source_row_id, CASE WHEN a.category = b.category THEN a.category ELSE least(a.category, b.category) || ' | ' || greatest(a.category, b.category) END AS category,
  'category: ' || a.category || chr(10) || {item_sql('a', 'a')} AS text_a, {item_sql('b', 'b')} AS text_b, true AS is_synthetic FROM made JOIN feat a ON a.id = least(id1, id2) JOIN feat b ON b.id = greatest(id1, id2)""")
def hard_identifier_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic negatives of near misses of article numbers that differ in their last digits, for all brand pairs."""
    items = materialize(C.canonicalize(raw_items(spark, sf_dir)), "canonical-items")
    positives = B.with_row_id(brand_edges(spark, sf_dir), "id1", "id2").withColumn("fold", F.lit(0))
    return A.hard_identifier_negatives(positives, items, 0.5, 0.8, None)


def _serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' labels as serialised pairs with attribute lines of different lengths."""
    s = scored(spark, sf_dir)
    parts = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit("="), (F.col("row_id") * i % 10).cast("string"))), "; ")
    a, b = (F.col("row_id") % 5 + 1).cast("int"), (F.col("row_id") % 3 + 1).cast("int")
    return s.select("row_id", F.col("row_id").alias("id1"), (F.col("row_id") + 1).alias("id2"), "target", "category", F.lit(0).alias("fold"),
                    F.concat(F.lit("category: "), F.col("category"), F.lit("\nattributes_a: "), parts(a)).alias("text_a"), F.concat(F.lit("name_b: x\nattributes_b: "), parts(b)).alias("text_b"))


_PARTS = "array_to_string(list_transform(range(1, {n} + 1), lambda i: 'k' || i || '=' || (row_id * i % 10)), '; ')"
_SERIAL = f"""serial AS (SELECT row_id, target, category, list_transform(range(1, row_id % 5 + 2), lambda i: 'k' || i || '=' || (row_id * i % 10)) AS fa, list_transform(range(1, row_id % 3 + 2), lambda i: 'k' || i || '=' || (row_id * i % 10)) AS fb FROM scored)"""


@query("attribute_dropout", f"""WITH {SCORED}, {_SERIAL}, p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY category) AS n, least(len(fa), len(fb))::DOUBLE / greatest(len(fa), len(fb), 1) AS ratio FROM serial WHERE target > 0.5),
  q AS (SELECT *, (place + ('0x' || substr(md5(concat_ws('|', 21, row_id, 'donor')), 1, 8))::BIGINT % greatest(n - 1, 1) + (n > 1)::INT) % n AS donor FROM p),
  m AS (SELECT q.*, d.ratio AS wanted, greatest(len(q.fa), len(q.fb)) AS more, least(len(q.fa), len(q.fb)) AS less FROM q JOIN p d ON d.category = q.category AND d.place = q.donor),
  k AS (SELECT *, more - least(more, greatest(less, floor(less / wanted + 0.5)))::BIGINT AS gone FROM m)
  SELECT row_id AS source_row_id, len(fa) - CASE WHEN len(fa) > len(fb) THEN gone ELSE 0 END AS parts_a, len(fb) - CASE WHEN len(fb) > len(fa) THEN gone ELSE 0 END AS parts_b FROM k""")
def attribute_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.attribute_dropout(_serialized(spark, sf_dir), 21).where("is_synthetic")
    return made.select("source_row_id", F.size(A.fragments(F.col("text_a"), A.PREFIX_A)).cast("long").alias("parts_a"), F.size(A.fragments(F.col("text_b"), A.PREFIX_B)).cast("long").alias("parts_b"))


@query("attribute_permutation", f"""WITH {SCORED}, {_SERIAL}, x AS (SELECT *, ('0x' || substr(md5(concat_ws('|', 22, row_id, 'pair')), 1, 8))::BIGINT < (0.5 * 4294967296)::BIGINT AS selected FROM serial)
  SELECT row_id, selected, array_to_string(list_sort(fa), ';') AS sorted_a, selected AND (len(list_distinct(fa)) > 1 OR len(list_distinct(fb)) > 1) AS changed FROM x""")
def attribute_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.attribute_permutation(_serialized(spark, sf_dir), 0.5, 22)
    return made.select("row_id", "selected", F.array_join(F.array_sort(A.fragments(F.col("text_a"), A.PREFIX_A)), ";").alias("sorted_a"), "changed")


@query("permutation_summary", f"""WITH {SCORED}, {_SERIAL}, x AS (SELECT *, ('0x' || substr(md5(concat_ws('|', 22, row_id, 'pair')), 1, 8))::BIGINT < (0.5 * 4294967296)::BIGINT AS selected FROM serial)
  SELECT count(*) AS rows, sum(selected::INT) AS selected, sum((selected AND (len(list_distinct(fa)) > 1 OR len(list_distinct(fb)) > 1))::INT) AS changed, sum((NOT selected)::INT) AS clean FROM x""", bigint="selected changed clean")
def permutation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.permutation_summary(A.attribute_permutation(_serialized(spark, sf_dir), 0.5, 22))


@query("stub_scorer", f"""WITH {SCORED}, {_SERIAL}, w AS (SELECT row_id, target, list_distinct(list_concat(['category:', category, 'attributes_a:'], list_transform(fa, lambda x, i: x || CASE WHEN i < len(fa) THEN ';' ELSE '' END))) AS a,
  list_distinct(list_concat(['name_b:', 'x', 'attributes_b:'], list_transform(fb, lambda x, i: x || CASE WHEN i < len(fb) THEN ';' ELSE '' END))) AS b FROM serial)
  SELECT row_id AS row_index, row_id AS id1, row_id + 1 AS id2, target, 0 AS fold, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS text_score FROM w""")
def stub_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pluggable scorer with its stand-in model."""
    return scoring.score_pairs(_serialized(spark, sf_dir), scoring.token_overlap_scorer, fold=0)


@query("fusion_gbt")
def fusion_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold fusion scores of labelled documents."""
    rows = scored(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"))
    facts, out, _ = X.train_oof(rows.withColumnRenamed("score", "text_score"), depths=(3,), rates=(0.2,), trees=5)
    return out.select("row_id", "fold", "category", "target", "score")


@query("fusion_shift")
def fusion_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a fusion's ranks when its text score is replaced."""
    rows = scored(spark, sf_dir).withColumns({"fold": F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"), "size": F.pmod(F.col("row_id"), F.lit(13)).cast("double")})
    facts, _, model = X.train_oof(rows.withColumnRenamed("score", "text_score").drop("other"), depths=(3,), rates=(0.2,), trees=5)
    return X.fusion_shift(model, rows, facts["features"], "score", "other", fraction=0.1, strict=False)


@query("covariate_shift")
def covariate_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, overlap and two-sample AUC of the scores of even and odd rows."""
    rows = scored(spark, sf_dir).withColumn("source", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b"))
    auc = X.two_sample_auc(rows, ["score", "other"], "source", "b")
    return M.support_summary(rows, ["score", "other"], "source", "a", "b").withColumn("two_sample_auc", F.lit(auc))


@query("text_pair_counts", f"WITH {LABELLED} SELECT category, count(*) AS pairs, sum(target)::DOUBLE AS positives FROM labelled GROUP BY category")
def text_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("category").agg(F.count("*").alias("pairs"), F.sum("target").alias("positives"))


@query("length_sorted", "SELECT doc_id, length(text) AS length FROM documents", integer="length")
def length_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.operators.ranking import length_sorted as sort

    return sort(table(spark, sf_dir, "documents").select("doc_id", "text"), 8, "text").select("doc_id", F.length("text").alias("length"))


@query("prepared_pairs", f"""WITH {FEATURE_ITEM}, {BRAND_EDGES}, edge AS (SELECT id1, id2, target, row_number() OVER (ORDER BY id1, id2) - 1 AS row_id FROM brand_edges)
  {all_features_sql('edge', f", target, row_id, 'category: ' || a.category || chr(10) || {item_sql('a', 'a')} AS text_a, {item_sql('b', 'b')} AS text_b")}""")
def prepared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand pairs with all features and both texts."""
    pairs = B.with_row_id(brand_edges(spark, sf_dir), "id1", "id2")
    made = P.prepare_pairs(pairs, C.canonicalize(raw_items(spark, sf_dir)))
    return made.select(*(F.round(c, 6).alias(c) if kind == "double" and c != "target" else c for c, kind in made.dtypes))
