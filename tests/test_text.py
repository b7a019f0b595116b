"""Text functions on literal inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T


def one(spark, value, build, of="x"):
    """``build`` applied to the raw (x), folded (f) or normal (n) text."""
    df = spark.createDataFrame([(value,)], "x string").withColumn("f", T.fold("x")).withColumn("n", T.plain(F.col("f")))
    return df.select(build(F.col(of)).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [("  ЧЁРНЫЙ—Samsung  ", "черный samsung"), (None, ""), ("ﬁ STRAßE ①", "fi strasse 1"), ("a_b-c", "a b c"), ("½ кг", "1 2 кг")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, lambda c: c, "n") == want


def test_transliterate_and_identifiers(spark):
    assert one(spark, "Самсунг", T.transliterate, "n") == "samsung"
    assert one(spark, "Щука объём жюри", T.transliterate, "n") == "shchuka obem zhyuri"
    assert one(spark, "АB-С123", T.identifier_form, "f") == one(spark, "AB-C123", T.identifier_form, "f") == "abc123"


@pytest.mark.parametrize("raw,want", [("SM-S921 and rs07c", ["rs07c", "sms921"]), ("ab_1", []), (None, []), ("x1 X1 1", ["x1"]), ("12/34", ["1234"])])
def test_identifier_tokens(spark, raw, want):
    assert one(spark, raw, T.identifier_tokens) == want


def test_tokens(spark):
    assert sorted(one(spark, "a b2 a 日本 в3", T.tokens, "n")) == ["a", "b2", "в3"]
    assert one(spark, "z10 a9 a9 b", T.numeric_tokens, "n") == ["a9", "z10"]


@pytest.mark.parametrize("raw,want", [("бутылка 1 л", {"volume_ml": [1000.0]}), ("1000 ml", {"volume_ml": [1000.0]}), ("2 x 256 GB", {"storage_mb": [262144.0]}), ("1,5 кг и 1500 г", {"mass_g": [1500.0]}),
                                      ("x5 кг", {}), (None, {}), ("3 пары 10шт", {"pair_count": [3.0], "count": [10.0]}), ("0.1234567 мм", {"length_mm": [0.123457]})])
def test_measurements(spark, raw, want):
    assert one(spark, raw, lambda c: T.measurements(F.array(c)), "f") == want


@pytest.mark.parametrize("raw,want", [("Черный / Black", "black"), ("сине-зелёный", "blue|green"), ("серебристый", "gray|silver"), ("матовый", "матовый"), ("", "")])
def test_colors(spark, raw, want):
    assert one(spark, raw, T.color_form, "n") == want


@pytest.mark.parametrize("key,want", [("российский размер", "ru:42"), ("размер EU", "eu:42"), ("size us", "us:42"), ("международный", "intl:42"), ("размер", "unknown:42")])
def test_sizes(spark, key, want):
    assert one(spark, key, lambda c: T.size_form(F.lit("42"), c), "n") == want
    assert one(spark, key, lambda c: T.size_form(F.lit(""), c), "n") == ""


def test_ngrams_and_short_texts(spark):
    grams = lambda c: T.char_ngrams(c)
    assert one(spark, "abcd", grams) == ["abc", "bcd"] and one(spark, "a", grams) == ["a"] and one(spark, None, grams) == [] and one(spark, " a  b ", grams) == ["a b"]
    assert one(spark, "x" * 12, lambda c: T.shortened(c, 10)) == "x" * 9 + "…" and one(spark, " ab ", lambda c: T.shortened(c, 10)) == "ab"


def test_attribute_map_and_prefix(spark):
    assert one(spark, "a=1; b=x=y; =z; c=; a=2", T.attribute_map) == {"a": "2", "b": "x=y"}
    share = spark.sql("select 'rs07c' a, 'rs07cst4' b, '' e").select(T.prefix_share(F.col("a"), F.col("b")), T.prefix_share(F.col("e"), F.col("e")), T.prefix_share(F.col("a"), F.col("e"))).first()
    assert tuple(share) == (5 / 8, 0.0, 0.0)


def test_clean_float(spark):
    xs = spark.createDataFrame([(2.0000000001,), (1.23456789,), (0.0000005,)], "x double")
    assert [r[0] for r in xs.select(T.clean_float(F.col("x"))).collect()] == [2.0, 1.234568, 0.0]


def test_nested_values_as_text(spark):
    df = spark.sql("select map('b', 1, 'a', 2) as m, array('x', 'Y') as a, named_struct('z', 1, 'c', 'd') as s, 7 as i, cast(null as map<string,int>) as n")
    got = df.select(*(T.as_text(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns)).first()
    assert tuple(got) == ('{"a":2,"b":1}', '["x","Y"]', '{"c":"d","z":1}', "7", None)
