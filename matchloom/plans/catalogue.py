"""The driver's tables as a catalogue: parts are items, co-ordered parts are pairs. Each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.metrics import hash_int
from matchloom.plans.durable import bounded, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw items with a JSON object of attributes; the brand has one key or two."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    color = F.element_at(F.array(*(F.lit(c) for c in COLORS)), (F.col("p_size") % 4 + 1).cast("int"))
    attributes = F.to_json(F.struct(
        F.col("p_brand").alias("Производитель"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("Марка"), F.concat(F.lit("AB-"), F.col("p_partkey")).alias("Артикул"),
        color.alias("Цвет"), F.col("p_size").cast("string").alias("Российский размер"), F.col("p_type").alias("Материал"), F.concat(F.col("p_size").cast("string"), F.lit(" кг")).alias("Вес"),
        (F.col("p_size") % 5 + 1).cast("string").alias("Количество в упаковке, шт")))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), attributes.alias("attributes"), F.col("p_type").alias("category"))


COLORS = ("Чёрный / Black", "красный", "сине-зелёный", "матовый")


def co_ordered(spark: SparkSession, sf_dir: str, alike: tuple[str, ...] = ()) -> DataFrame:
    """Distinct unordered pairs of parts of one order; with ``alike``, those of which some rows are equal in these columns of ``part``, so that no others are made.

    Lines are dealt out by order once, for their distinct parts and for both sides of the join.
    """
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id1"))
    if alike:
        one = one.join(bounded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id1"), *alike)), "id1")
    one = one.repartition("l_orderkey", *alike).distinct()
    two = one.withColumnRenamed("id1", "id2")
    return one.join(two, ["l_orderkey", *alike]).where("id1 < id2").select("id1", "id2").distinct()


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parts of each order of several, as sorted ``ids``: ``co_ordered`` are the pairs within them."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select("l_orderkey", "l_partkey").repartition("l_orderkey")
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("ids")).where("size(ids) > 1").select("ids")


CO_ORDERED = """co_ordered AS (SELECT DISTINCT a.l_partkey AS id1, b.l_partkey AS id2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""


def labelled(spark: SparkSession, sf_dir: str, alike: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with ``category`` (both parts' types, in order) and ``target`` (same brand); ``alike`` as in ``co_ordered``."""
    p = bounded(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"))
    a, b = (p.select(F.col("p_partkey").alias(f"id{i}"), F.col("p_brand").alias(f"brand{i}"), F.col("p_type").alias(f"type{i}")) for i in (1, 2))
    joined = co_ordered(spark, sf_dir, alike).join(a, "id1").join(b, "id2")
    category = F.when(F.col("type1") == F.col("type2"), F.col("type1")).otherwise(F.concat(F.least("type1", "type2"), F.lit(" | "), F.greatest("type1", "type2")))
    return joined.select("id1", "id2", (F.col("brand1") == F.col("brand2")).cast("double").alias("target"), category.alias("category"))


LABELLED = CO_ORDERED + """, labelled AS (SELECT id1, id2, CASE WHEN a.p_brand = b.p_brand THEN 1.0 ELSE 0.0 END::DOUBLE AS target,
  CASE WHEN a.p_type = b.p_type THEN a.p_type ELSE least(a.p_type, b.p_type) || ' | ' || greatest(a.p_type, b.p_type) END AS category
  FROM co_ordered JOIN part a ON a.p_partkey = id1 JOIN part b ON b.p_partkey = id2)"""


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-ordered parts of equal brand and type."""
    return labelled(spark, sf_dir, ("p_brand", "p_type")).where("target > 0.5 and not contains(category, '|')").select("id1", "id2", "target", "category")


BRAND_EDGES = LABELLED + """, brand_edges AS (SELECT id1, id2, target, category FROM labelled WHERE target > 0.5 AND NOT contains(category, '|'))"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-type pairs with ``target`` of k ninths, k by hash."""
    same = labelled(spark, sf_dir).where("not contains(category, '|')")
    return same.select("id1", "id2", (F.pmod(hash_int(F.col("id1"), F.col("id2"), F.lit("vote")), F.lit(10)) / 9.0).alias("target"), "category")


VOTES = LABELLED + """, votes AS (SELECT id1, id2, (('0x' || substr(md5(concat_ws('|', id1, id2, 'vote')), 1, 8))::BIGINT % 10) / 9.0::DOUBLE AS target, category
  FROM labelled WHERE NOT contains(category, '|'))"""


def seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that training has seen: every 20th part, and the partners it is ordered with for brand and type."""
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"))


SEEN = "seen AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 20 = 0)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: ``row_id, category`` (language)``, target`` (quality) and two scores with ties."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("category"), F.col("quality").cast("double").alias("target"),
                                      (F.col("n_chars") % 1000 / 1000.0).alias("score"), ((F.col("n_chars") * 7 + F.col("doc_id")) % 500 / 500.0).alias("other"))


SCORED = """scored AS (SELECT doc_id AS row_id, lang AS category, quality::DOUBLE AS target, (n_chars % 1000) / 1000.0::DOUBLE AS score, ((n_chars * 7 + doc_id) % 500) / 500.0::DOUBLE AS other
  FROM documents JOIN labels USING (doc_id))"""
