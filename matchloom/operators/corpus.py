"""Corpus statistics over whole catalogues, and items annotated with them.

Document frequencies are counted over every item, never over the items of some pairs only: the counts are a
branch of their own off the canonical items, so no id filter is pushed below them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.plans.durable import materialize

BASE = tuple(f"transductive_{x}" for x in ("rarest_shared_token_idf", "mean_shared_token_idf", "max_unshared_token_idf", "brand_frequency_percentile_min", "brand_frequency_percentile_max", "identifier_df"))
CATEGORY = tuple(f"transductive_category_{x}" for x in ("rarest_shared_token_idf", "mean_shared_token_idf", "max_unshared_token_idf"))
ATTRIBUTE = tuple(f"aligned_attribute_{x}" for x in ("common_key_idf_sum", "common_key_idf_max", "key_idf_weighted_jaccard"))
PROFILES = {"h12-v1": BASE, "h12-v1-c1": BASE + CATEGORY, "h12-v1-c2": BASE + ATTRIBUTE, "h12-v1-c1-c2": BASE + CATEGORY + ATTRIBUTE}


def schema_digest(names: list[str]) -> str:
    """SHA-256 of the sorted feature names, whatever their order."""
    return hashlib.sha256(json.dumps(sorted(names), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def fingerprint(spec: dict) -> str:
    """SHA-256 of a specification or recipe, whatever the order of its keys: equal settings have equal fingerprints."""
    return hashlib.sha256(json.dumps(spec, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def resolve_profile(columns: list[str], profile: str | None = None) -> str | None:
    """The profile whose features are among the columns; an explicit one must match exactly, and families beyond the base need one."""
    known = {c for names in PROFILES.values() for c in names}
    seen = known & set(columns)
    if profile is not None:
        if profile not in PROFILES or set(PROFILES[profile]) != seen:
            raise ValueError(f"columns do not match profile {profile}")
        return profile
    if not seen:
        return None
    if seen != set(BASE):
        raise ValueError("features beyond the base profile need an explicit profile")
    return "h12-v1"


def document_frequency(rows: DataFrame, items: Column, *by: str) -> DataFrame:
    """``(by..., item, df)``: records that hold an item, each counted once per record. Partial counts merge by addition."""
    return rows.select(*by, F.explode(F.array_distinct(items)).alias("item")).groupBy(*by, "item").agg(F.count("*").alias("df"))


def brand_percentiles(brand_df: DataFrame) -> DataFrame:
    """``(item, df, percentile)``: share of brands with at most this frequency. The global window sees distinct frequencies only."""
    levels = brand_df.groupBy("df").agg(F.count("*").alias("brands"))
    upto = F.sum("brands").over(Window.orderBy("df").rowsBetween(Window.unboundedPreceding, 0))
    whole = levels.agg(F.sum("brands").alias("every"))
    ranked = levels.select("df", upto.alias("upto")).crossJoin(F.broadcast(whole)).select("df", (F.col("upto") / F.col("every")).alias("percentile"))
    return brand_df.join(ranked, "df").select("item", "df", "percentile")


def spread(items: DataFrame, profile: str) -> DataFrame:
    """``(id, kind, scope, item)``: everything of an item that a profile counts, from one pass: its tokens, identifiers and brand, its tokens in its category, its attribute keys."""
    given = F.col("category") != ""
    tokens = T.tokens(F.col("name_norm"))
    facts = lambda kind, scope, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), k.alias("item")))
    none = F.lit("")
    parts = [facts("token", none, tokens), facts("identifier", none, F.col("identifier_tokens")), facts("brand", none, F.filter(F.array("brand_norm"), lambda x: x != ""))]
    if CATEGORY[0] in PROFILES[profile]:
        parts.append(F.when(given, facts("category", F.col("category"), tokens)).otherwise(F.array().cast("array<struct<kind:string,scope:string,item:string>>")))
    if ATTRIBUTE[0] in PROFILES[profile]:
        parts.append(facts("key", none, F.map_keys(T.attribute_map(F.col("remaining_attributes")))))
    return items.select("id", F.explode(F.concat(*parts)).alias("x")).select("id", "x.kind", "x.scope", "x.item")


def statistics(items: DataFrame, profile: str = "h12-v1-c1-c2") -> dict[str, DataFrame]:
    """The counters a profile needs, over all canonical items: one aggregation of everything counted, kept as a table."""
    counts = materialize(spread(items, profile).groupBy("kind", "scope", "item").agg(F.count("*").alias("df")), "item-counts", narrow=True)
    of = lambda kind, *by: counts.where(F.col("kind") == kind).select(*by, "item", "df")
    out = {"total": materialize(items.agg(F.count("*").alias("n")), "item-total"), "counts": counts, "token": of("token"), "brand": of("brand"), "identifier": of("identifier")}
    if CATEGORY[0] in PROFILES[profile]:
        sizes = items.where("category <> ''").groupBy("category").agg(F.count("*").alias("n"))
        out |= {"category": materialize(sizes, "category-sizes"), "category_token": of("category", F.col("scope").alias("category"))}
    if ATTRIBUTE[0] in PROFILES[profile]:
        out["key"] = of("key")
    return out


def annotate(items: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """Items with maps of token IDF and identifier frequency, the brand's percentile and, where counted, category and key IDFs. Ids must be unique.

    One explode of what items hold, one join with all values, one regroup by id.
    """
    profile = "h12-v1" + "-c1" * ("category_token" in stats) + "-c2" * ("key" in stats)
    counts = stats["counts"].crossJoin(F.broadcast(stats["total"]))  # one row
    if "category" in stats:
        local = stats["category"].select(F.lit("category").alias("kind"), F.col("category").alias("scope"), F.col("n").alias("__local"))
        counts = counts.join(local, ["kind", "scope"], "left").withColumn("n", F.coalesce("__local", "n"))
    value = F.when(F.col("kind") == "identifier", S.normalized_df(F.col("n"), F.col("df"))).otherwise(S.normalized_idf(F.col("n"), F.col("df")))
    values = counts.where("kind <> 'brand'").select("kind", "scope", "item", value.alias("value"))
    brand = brand_percentiles(stats["brand"]).select(F.lit("brand").alias("kind"), F.lit("").alias("scope"), "item", F.col("percentile").alias("value"))
    values = materialize(values.unionByName(brand), "item-values", narrow=True)
    held = spread(items, profile).join(values, ["kind", "scope", "item"], "left").groupBy("id").agg(F.collect_list(F.struct("kind", "item", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("__held"))
    held = held.select(F.col("id").alias("__id"), "__held")
    out = items.join(held, F.col("id") == F.col("__id"), "left").withColumn("__held", F.coalesce("__held", F.array().cast("array<struct<kind:string,item:string,value:double>>")))
    of = lambda kind: F.map_from_entries(F.transform(F.filter("__held", lambda x: x["kind"] == kind), lambda x: F.struct(x["item"], x["value"])))
    names = {"name_idf": "token", "identifier_share": "identifier"} | ({"category_idf": "category"} if "category_token" in stats else {}) | ({"key_idf": "key"} if "key" in stats else {})
    percentile = F.coalesce(F.get(F.filter("__held", lambda x: x["kind"] == "brand"), F.lit(0))["value"], F.lit(0.0))
    return out.select(*items.columns, *(of(kind).alias(name) for name, kind in names.items()), percentile.alias("brand_percentile"))


def transductive_features(joined: DataFrame) -> dict[str, Column]:
    """The features of the families that the joined items are annotated for; always given, 0 without shared items."""
    have = joined.schema["left"].dataType.names
    side = lambda n: (F.col(f"left.{n}"), F.col(f"right.{n}"))
    out = dict(zip(BASE[:3], S.shared_idf(*side("name_idf"))))
    a, b = side("brand_percentile")
    out |= {BASE[3]: F.least(a, b), BASE[4]: F.greatest(a, b)}
    shared = F.map_values(F.map_filter(F.map_zip_with(*side("identifier_share"), lambda _, x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y))), lambda _, v: v.isNotNull()))
    out[BASE[5]] = F.coalesce(F.array_min(shared), F.lit(0.0))
    if "category_idf" in have:
        out |= dict(zip(CATEGORY, S.shared_idf(*side("category_idf"))))
    if "key_idf" in have:
        out |= dict(zip(ATTRIBUTE, S.key_idf_block(*side("key_idf"))))
    return out
