"""Positions in a global order without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.plans.durable import materialize


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: its position from 0 in the order, which must be total for the result to be unique.

    Rows are ranged by the order into parts, a durable table as range bounds are sampled; a part's first position
    is a prefix sum over part sizes, and the rest is a row number within the part.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))  # a row a part
    starts = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    ranked = placed.withColumn("__within", within).join(F.broadcast(starts), "__part")
    return ranked.select(*df.columns, (F.col("__start") + F.col("__within")).cast("long").alias(out))


def place_within(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: its position from 0 within its group, in the order, which must be total. A group of any size is many parts; nulls form a group."""
    whole = numbered(df, [*(F.asc(c) for c in by), *order], "__global")
    whole = materialize(whole, "placed")
    starts = whole.groupBy(*(F.col(c).alias(f"__b{i}") for i, c in enumerate(by))).agg(F.min("__global").alias("__first"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    return whole.join(starts, same).select(*df.columns, (F.col("__global") - F.col("__first")).alias(out))


def running_sum(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to a row within its group, by ``order``, whose values differ in a group.

    Rows are ranged by group and order into parts, a durable table; the sums of the parts before come from one row a group and part.
    """
    placed = materialize(df.repartitionByRange(*(F.col(c) for c in by), F.col(order)).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = placed.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = sums.select(*(F.col(c).alias(f"__b{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), (F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__sum")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    return placed.withColumn("__within", within).join(before, same).select(*df.columns, (F.col("__before") + F.col("__within")).alias(out))
