"""A training-data pipeline over ``documents``: language, quality, near duplicates, packing.

Each stage takes the rows that its predecessor kept and, but for the last, returns the
columns of ``documents``; ``run`` writes each result as Parquet in the shared folder and reads
it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import langid, packing, quality, simhash
from matchloom.llm.queries import held_out, vocabulary
from matchloom.plans.durable import materialize

#: SQL cannot express the trained language model or the tokens; a brute-force version tests the rows.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has an identified language."""
    model = langid.train(docs, ~F.coalesce(held_out(), F.lit(False)))
    return langid.keep_identified(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current quality policy keeps."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group."""
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of one source mixture."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
