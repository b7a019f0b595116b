"""Canonical items, pair features and corpus statistics on literal rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import canonical as C
from matchloom.operators import corpus as K
from matchloom.operators import pairs as P
from matchloom.schemas import CANONICAL, RAW_ITEM

ITEMS = [
    (1, "Смартфон Самсунг Galaxy S24 256 ГБ", '{"Бренд":"Самсунг","Артикул":"SM-S921","Цвет":"Черный / Black","Память":"256 ГБ","Экран":"6.2","Чехол":"да"}', "phones"),
    (2, "Samsung Galaxy S24 512GB", '{"Бренд":"Samsung","Артикул":"SM S921","Цвет товара":"синий","Память":"512 ГБ","Экран":"6.2","Чехол":"нет"}', "phones"),
    (3, "broken", "{broken", ""), (4, None, None, None), (5, "Flash drive 1", '{"a":"1","a":"2","n":{"z":1},"blank":"  ","list":[1]}', "drives"), (6, "array", "[1]", "x"),
]


@pytest.fixture(scope="module")
def canon(spark):
    return C.canonicalize(spark.createDataFrame(ITEMS, RAW_ITEM)).cache()


def test_schema(canon):
    assert [(f.name, f.dataType.simpleString()) for f in canon.schema] == [(f.name, f.dataType.simpleString()) for f in CANONICAL]


def test_records(canon):
    r = {x["id"]: x for x in canon.collect()}
    s = r[1]
    assert (s["brand_norm"], s["article_norm"], s["color_norm"], s["brand_translit"], s["parse_error"]) == ("самсунг", "sms921", "black", "samsung", 0)
    assert s["measurements"] == {"storage_mb": [262144.0]} and "sms921" in s["identifier_tokens"] and s["attribute_count"] == 6
    assert s["remaining_attributes"] == "память=256 гб; чехол=да; экран=6 2"
    assert (r[3]["parse_error"], r[3]["attribute_count"]) == (1, 0) and r[4]["parse_error"] == 0 and r[4]["name_norm"] == "" and r[6]["parse_error"] == 1
    assert r[5]["remaining_attributes"] == "a=2; list=1; n=z 1" and r[5]["attribute_count"] == 4


def test_key_priorities(spark):
    def score(field, key):
        return spark.range(1).select(C.key_score(field, F.lit(key))).first()[0]

    assert [score("brand", k) for k in ("бренд", "бренд в одежде и обуви", "марка", "производитель", "страна бренда", "x")] == [100, 95, 80, 45, 60, 0]
    assert [score("size", k) for k in ("размер упаковки", "российский размер", "размер обуви", "размер", "размер экрана")] == [0, 100, 95, 90, 50]
    assert [score("model", k) for k in ("модель", "модель товара", "модель часов", "совместимые модель")] == [100, 95, 60, 0]
    assert [score("color", k) for k in ("цвет товара", "цвет", "цвет корпуса", "цветовая температура")] == [100, 90, 50, 0]
    assert [score("quantity", k) for k in ("количество штук", "количество", "количество режимов")] == [100, 50, 0]
    assert [score("article", k) for k in ("артикул", "oem номер", "артикул производителя")] == [100, 95, 70]


def test_first_key_wins_ties_and_blanks_are_skipped(spark):
    items = spark.createDataFrame([(1, "n", '{"Цвет корпуса":" ","Цвет рамы":"красный","Цвет дна":"синий"}', "c")], RAW_ITEM)
    r = C.canonicalize(items).first()
    assert r["color_norm"] == "red" and r["remaining_attributes"] == "цвет дна=синий"


def test_remaining_attributes_stop_at_overflow(spark):
    items = spark.createDataFrame([(1, "n", '{"a":"b","c":"ddddddddddd","e":"f"}', "c")], RAW_ITEM)
    assert C.canonicalize(items, remaining_chars=12).first()["remaining_attributes"] == "a=b"


def test_pairs_are_symmetric(spark, canon):
    pairs = spark.createDataFrame([(1, 2, 1.0, 0), (1, 3, 0.0, 1), (4, 5, 0.0, 2)], "id1 long, id2 long, target double, row_id long")
    swapped = pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "target", "row_id")
    a = [r.asDict() for r in P.prepare_pairs(pairs, canon).orderBy("row_id").collect()]
    b = [r.asDict() for r in P.prepare_pairs(swapped, canon).orderBy("row_id").collect()]
    for x, y in zip(a, b):
        assert {k: v for k, v in x.items() if k not in ("id1", "id2")} == {k: v for k, v in y.items() if k not in ("id1", "id2")}
    f = a[0]
    numeric = [k for k, v in f.items() if isinstance(v, float) and k != "target"]
    assert len(numeric) == 67
    assert f["brand_translit_equal"] == f["article_equal"] == 1.0 and f["measurement_conflict_types"] == 1.0 and f["category"] == "phones"
    assert (f["aligned_attribute_key_common"], f["aligned_attribute_value_exact"], f["aligned_attribute_value_conflict"], f["aligned_attribute_numeric_overlap"]) == (3.0, 1.0, 2.0, 1.0)
    assert f["text_a"].startswith("category: phones\ncategory_a: phones\nname_a: смартфон") and f["text_b"].startswith("category_b: phones\nname_b: samsung")
    assert all(v is not None for r in a for v in r.values())


def test_text_only_is_a_subset(spark, canon):
    pairs = spark.createDataFrame([(1, 2, 1.0, 0), (5, 2, 0.0, 1)], "id1 long, id2 long, target double, row_id long")
    full = {r["row_id"]: r.asDict() for r in P.prepare_pairs(pairs, canon).collect()}
    for r in P.prepare_pairs(pairs, canon, text_only=True).collect():
        assert all(full[r["row_id"]][k] == v for k, v in r.asDict().items())


def test_missing_ids(spark, canon):
    pairs = spark.createDataFrame([(1, 99, 1.0)], "id1 long, id2 long, target double")
    assert [r["id"] for r in P.missing_ids(pairs, canon).collect()] == [99]
    assert P.only_ids(canon, P.endpoint_ids(pairs)).count() == 1


def test_corpus_statistics(spark):
    rows = [(1, "Rare 123 common flash", '{"Бренд":"B"}', "drives"), (2, "Rare 123 common", '{"Бренд":"B"}', "drives"), (3, "common", '{"Бренд":"C"}', "")]
    items = C.canonicalize(spark.createDataFrame(rows, RAW_ITEM))
    stats = K.statistics(items)
    an = {r["id"]: r for r in K.annotate(items, stats).collect()}
    assert an[1]["name_idf"]["common"] == 0.0 and 0 < an[1]["name_idf"]["rare"] < an[1]["name_idf"]["flash"] == 1.0
    assert an[1]["category_idf"]["flash"] == 1.0 and an[1]["category_idf"]["common"] < 1 and an[3]["category_idf"] == {}
    assert an[1]["brand_percentile"] == 1.0 and an[3]["brand_percentile"] == 0.5 and 0 < an[1]["identifier_share"]["123"] < 1
    joined = P.join_items(spark.createDataFrame([(2, 1), (1, 3)], "id1 long, id2 long"), K.annotate(items, stats))
    made = K.transductive_features(joined)
    assert tuple(made) == K.PROFILES["h12-v1-c1-c2"]
    got = {(r["id1"], r["id2"]): r for r in joined.select("id1", "id2", *(v.alias(k) for k, v in made.items())).collect()}
    assert got[2, 1]["transductive_max_unshared_token_idf"] == 1.0 and got[2, 1]["transductive_rarest_shared_token_idf"] > 0
    assert got[1, 3]["transductive_category_rarest_shared_token_idf"] == 0.0
    assert set(K.statistics(items, "h12-v1")) == {"total", "counts", "token", "brand", "identifier"}


def test_profiles():
    names = list(K.BASE)
    random.shuffle(names)
    assert K.schema_digest(names) == K.schema_digest(sorted(names))
    assert K.resolve_profile(["x"]) is None and K.resolve_profile(names) == "h12-v1" and K.resolve_profile([*names, *K.CATEGORY], "h12-v1-c1") == "h12-v1-c1"
    for columns, profile in (([*names, *K.CATEGORY], None), (names, "h12-v1-c2"), (names[:3], None), (names, "unknown")):
        with pytest.raises(ValueError):
            K.resolve_profile(columns, profile)


def test_features_do_not_depend_on_partitioning(spark, canon):
    pairs = spark.createDataFrame([(i % 6 + 1, j % 6 + 1) for i in range(6) for j in range(i)], "id1 long, id2 long")
    one = sorted(map(str, P.features(P.join_items(pairs, P.prepared_items(canon))).collect()))
    assert sorted(map(str, P.features(P.join_items(pairs.repartition(7), P.prepared_items(canon.repartition(3)))).collect())) == one


def test_prepared_pairs_with_a_profile_and_same_category(spark):
    rows = [(1, "Rare 123 common", '{"Бренд":"B"}', "drives"), (2, "Rare 123 common", '{"Бренд":"B"}', "drives"), (3, "common", '{"Бренд":"C"}', ""), (4, "common", None, "other"), (5, "x", None, "")]
    items = C.canonicalize(spark.createDataFrame(rows, RAW_ITEM))
    pairs = spark.createDataFrame([(2, 1, 0), (1, 3, 1), (4, 1, 2), (3, 5, 3)], "id1 long, id2 long, row_id long")
    plain, wide = P.prepare_pairs(pairs, items), P.prepare_pairs(pairs, items, profile="h12-v1-c1")
    assert set(wide.columns) - set(plain.columns) == set(K.PROFILES["h12-v1-c1"]) and {"text_a", "text_b", "row_id"} <= set(plain.columns)
    got = {r["row_id"]: r for r in wide.collect()}
    assert len(got) == 4 and got[0]["transductive_rarest_shared_token_idf"] > 0 and got[1]["transductive_category_rarest_shared_token_idf"] == 0
    assert [tuple(r) for r in P.same_category_pairs(pairs, items).collect()] == [(2, 1, "drives")]
    assert K.fingerprint({"a": 1, "b": [2]}) == K.fingerprint({"b": [2], "a": 1}) != K.fingerprint({"a": 1, "b": [3]})
