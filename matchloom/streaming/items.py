"""Our extension: canonicalisation and running document frequencies under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators.canonical import canonicalize
from matchloom.schemas import RAW_ITEM


def item_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Raw items as files arrive in a directory."""
    return spark.readStream.schema(RAW_ITEM).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def canonical_stream(items: DataFrame) -> DataFrame:
    """Canonicalisation is local to a row, so the batch plan serves the stream."""
    return canonicalize(items)


def running_token_df(items: DataFrame) -> DataFrame:
    """Token document frequencies so far; for output mode ``update`` or ``complete``."""
    return canonicalize(items).select(F.explode(T.tokens(F.col("name_norm"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def start(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):  # noqa: ANN201
    """Append to Parquet with exactly-once file commits."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
