"""Batch ranks, cascades, score joins and combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.metrics import exact_quantiles, with_average_rank
from matchloom.operators.ordering import numbered


def not_finite(column: str) -> Column:
    """Whether a value is null, NaN or infinite."""
    x = F.col(column).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def require_finite(df: DataFrame, *columns: str) -> None:
    """Raise if a value is null, NaN or infinite: one aggregate."""
    bad = df.agg(*(F.sum(not_finite(c).cast("int")).alias(c) for c in columns)).first()
    if any(bad[c] for c in columns):
        raise ValueError(f"not finite: {[c for c in columns if bad[c]]}")


def percentile_rank(df: DataFrame, score: str = "text_score", by: tuple[str, ...] = ("category",), out: str = "text_score_category_rank") -> DataFrame:
    """Average-tie rank over group size: 1 for a group of one; nulls form a group. Ranks come from distinct values, so a group of any size is spread. Raises on a score that is not finite."""
    require_finite(df, score)
    ranked = with_average_rank(df, score, list(by), "__rank")
    sizes = df.groupBy(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by))).agg(F.count("*").alias("__size"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)))
    return ranked.join(sizes, same).select(*df.columns, (F.col("__rank") / F.col("__size")).cast("float").alias(out))


def cascade_select(df: DataFrame, threshold: float, fraction: float, score: str = "score", row: str = "row_id") -> DataFrame:
    """At most ``floor(fraction * rows)`` rows at or above the threshold, by descending score, then row; ``fraction`` counts all rows."""
    most = int(fraction * df.count())
    ranked = numbered(df.where(F.col(score) >= threshold), [F.desc(score), F.asc(row)], "__place")
    return ranked.where(F.col("__place") < most).drop("__place")


def cascade_fill(df: DataFrame, expensive: DataFrame, fill: str = "substitute", score: str = "score", row: str = "row_id", value: str = "expensive_score", out: str = "second_score") -> DataFrame:
    """The expensive score where there is one, else the cheap one, zero or NaN."""
    other = {"substitute": F.col(score).cast("double"), "zero": F.lit(0.0), "nan": F.lit(float("nan"))}
    if fill not in other:
        raise ValueError(f"unknown fill {fill}")
    return df.join(expensive.select(row, value), row, "left").select(*(df[c] for c in df.columns), F.coalesce(F.col(value), other[fill]).alias(out))


def calibrate(df: DataFrame, fraction: float, score: str = "score") -> DataFrame:
    """One row ``threshold``: the score that ``fraction`` of the rows reach."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction lies in (0, 1]")
    return exact_quantiles(df, score, (1.0 - fraction,)).select(F.col("q")[0].alias("threshold"))


def combine(scores: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean; weights are at least 0 and sum to 1."""
    weights = weights or [1.0 / len(scores)] * len(scores)
    if len(weights) != len(scores) or min(weights) < 0 or abs(sum(weights) - 1) > 1e-12:
        raise ValueError("weights must be one for each score, not negative, and sum to 1")
    return reduce(lambda a, b: a + b, (s * F.lit(float(w)) for s, w in zip(scores, weights))).cast("float")


def join_faults(pairs: DataFrame, scores: DataFrame, score: str = "text_score") -> DataFrame:
    """One row of counts: duplicate, missing, extra and non-finite score rows of a strict one-to-one join on (row_id, id1, id2), and, where both sides have a fold, rows whose folds differ."""
    keys = ["row_id", "id1", "id2"]
    s = scores.withColumnRenamed("row_index", "row_id") if "row_index" in scores.columns else scores
    duplicate = s.groupBy("row_id").count().where("count > 1").agg(F.count("*").alias("duplicate"))
    missing = pairs.join(s, keys, "left_anti").agg(F.count("*").alias("missing"))
    extra = s.join(pairs, keys, "left_anti").agg(F.count("*").alias("extra"))
    bad = s.agg(F.coalesce(F.sum(not_finite(score).cast("int")), F.lit(0)).alias("not_finite"))
    out = duplicate.crossJoin(missing).crossJoin(extra).crossJoin(bad)  # four single rows
    if "fold" in s.columns and "fold" in pairs.columns:
        both = pairs.select(*keys, "fold").join(s.select(*keys, F.col("fold").alias("__fold")), keys)
        out = out.crossJoin(both.agg(F.count(F.when(~F.col("fold").eqNullSafe(F.col("__fold")), 1)).alias("other_fold")))
    return out


def strict_score_join(pairs: DataFrame, scores: DataFrame, score: str = "text_score", ordered: bool = False) -> DataFrame:
    """Pairs with their scores; raises unless the scores cover exactly the pairs, once, are finite, and agree on the fold. ``ordered`` sorts the rows as ``row_id`` numbers them."""
    faults = join_faults(pairs, scores, score).first().asDict()
    if any(faults.values()):
        raise ValueError(f"scores do not match the pairs: {faults}")
    s = scores.withColumnRenamed("row_index", "row_id") if "row_index" in scores.columns else scores
    out = pairs.join(s.select("row_id", "id1", "id2", score), ["row_id", "id1", "id2"])
    return out.orderBy("row_id") if ordered else out


def three_way(gold: DataFrame, control: DataFrame, candidate: DataFrame, score: str = "text_score") -> DataFrame:
    """Gold pairs with both scores as ``control`` and ``candidate``, by (id1, id2); raises unless each pair has each score exactly once."""
    keys = ["id1", "id2"]
    a, b = (s.select(*keys, F.col(score).cast("double").alias(n)) for s, n in ((control, "control"), (candidate, "candidate")))
    out = gold.join(a, keys).join(b, keys)
    wanted, got, pairs = gold.count(), out.count(), out.select(*keys).distinct().count()
    if not wanted == got == pairs:
        raise ValueError(f"{got} rows of {pairs} pairs for {wanted} gold pairs")
    require_finite(out, "control", "candidate")
    return out


def key_mismatch(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys on one side only."""
    x, y = a.select(*keys).distinct().withColumn("__a", F.lit(1)), b.select(*keys).distinct().withColumn("__b", F.lit(1))
    return x.join(y, keys, "full_outer").agg(F.sum(F.col("__b").isNull().cast("int")).alias("only_left"), F.sum(F.col("__a").isNull().cast("int")).alias("only_right"))


def constant_categories(df: DataFrame, categories: list[str], out: str = "predict", value: float = 0.0) -> DataFrame:
    """Blank the predictions of some categories; raises if that leaves none."""
    barred = F.col("category").isin(*categories)
    if df.where(~F.coalesce(barred, F.lit(False))).isEmpty():
        raise ValueError("every row's category is blanked")
    return df.withColumn(out, F.when(barred, F.lit(value)).otherwise(F.col(out)))


def length_sorted(df: DataFrame, partitions: int, *texts: str) -> DataFrame:
    """Rows ranged by total text length and sorted within partitions, for batches of like length."""
    length = reduce(lambda a, b: a + b, (F.length(F.coalesce(F.col(t), F.lit(""))) for t in texts))
    return df.withColumn("__length", length).repartitionByRange(partitions, "__length").sortWithinPartitions("__length").drop("__length")
