"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

#: The seven canonical fields, in canonical and in serialised order.
FIELDS = ("type", "brand", "model", "article", "color", "size", "quantity")
SERIAL_FIELDS = ("brand", "model", "article", "type", "size", "quantity", "color")
#: Pair features by field, in feature order.
PAIR_FIELDS = ("brand", "model", "article", "type", "color", "size", "quantity")

RAW_ITEM = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("attributes", StringType()), StructField("category", StringType())])
MATCH = StructType([StructField("id1", LongType()), StructField("id2", LongType()), StructField("target", DoubleType())])
SCORE = StructType([StructField("row_index", LongType()), StructField("id1", LongType()), StructField("id2", LongType()), StructField("text_score", DoubleType())])
CANONICAL = StructType(
    [StructField("id", LongType()), *(StructField(x, StringType()) for x in ("category", "name_raw", "name_norm", "name_translit")), StructField("attribute_count", IntegerType()), StructField("parse_error", IntegerType())]
    + [StructField(f"{f}_{x}", StringType()) for f in FIELDS for x in ("raw", "norm")]
    + [StructField("brand_translit", StringType()), StructField("numeric_tokens", ArrayType(StringType())), StructField("identifier_tokens", ArrayType(StringType())),
       StructField("measurements", MapType(StringType(), ArrayType(DoubleType()))), StructField("remaining_attributes", StringType())]
)
