"""Pairs within baskets joined to their items in blocks: the rows of the plain join, and neither pairs nor prepared items written on the way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchloom.operators import pairs as P
from matchloom.plans import durable


def made(spark, monkeypatch, sizes: list[int], step: int, block: int = 100, group: int = 700):
    monkeypatch.setattr(P, "BLOCK_ITEMS", block)
    monkeypatch.setattr(P, "GROUP_PAIRS", group)
    items = spark.range(-400, 600).selectExpr("id", "id * 3 AS x").unionByName(spark.createDataFrame([(7, 0), (9_000_000_000, 1)], "id long, x long"))
    rows = [sorted({(i * 3 + k * step) % 1005 - 400 for k in range(sizes[i % len(sizes)])}) for i in range(1500)] + [[7, 9_000_000_000], [-400, 7, 9_000_000_000], [7], [5]]
    baskets = spark.createDataFrame([(r,) for r in rows], "ids array<long>").repartition(5)
    want = {(a, b) for r in rows for a in r for b in r if a < b}
    found = P.pairs_of_baskets(baskets)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    written = []
    monkeypatch.setattr(P, "materialize", lambda df, label, **more: written.append(label) or durable.materialize(df, label, **more))
    return P.join_baskets_in_blocks(baskets, items, lambda x: x), P.join_items(found, items), written


@pytest.mark.parametrize("sizes, step, block, group, baskets_sent", [([2, 5, 9], 1, 100, 20_000, True), ([9], 7, 200, 5_000, True), ([3], 1, 600, 1_500, False)])
def test_blocks_give_the_rows_of_the_plain_join(spark, monkeypatch, sizes, step, block, group, baskets_sent):
    got, want, written = made(spark, monkeypatch, sizes, step, block, group)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 3  # baskets or pairs once, items once a side; equal pairs meet without another
    assert (plan.index("Generate explode(__ls") < plan.index("Exchange hashpartitioning")) == baskets_sent  # else pairs, where these are shorter
    assert written == ["baskets", "items", "basket-groups"]  # no pairs
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_few_pairs_of_many_blocks_and_no_pairs_take_the_plain_join(spark, monkeypatch):
    for sizes in ([2], [1]):
        got, want, _ = made(spark, monkeypatch, sizes, 7, 10)
        assert "ShuffledHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_baskets_of_orders_give_their_pairs(spark, tmp_path):
    """Orders and parts without a number make no pairs, and a part that an order has twice makes none with itself."""
    from matchloom.plans.catalogue import co_ordered, order_parts

    rows = [(1, 5), (1, 5), (1, 3), (2, 9), (2, None), (None, 1), (None, 2), (3, 3), (3, 5), (3, -4), (4, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.ids for r in order_parts(spark, str(tmp_path)).collect()) == [[-4, 3, 5], [3, 5]]
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(P.pairs_of_baskets(order_parts(spark, str(tmp_path)))) == pairs(co_ordered(spark, str(tmp_path))) == [(-4, 3), (-4, 5), (3, 5)]


def test_packed_ngrams_are_equal_where_their_texts_are(spark):
    from matchloom.functions import text as T

    df = spark.createDataFrame([("",), ("a",), ("ab",), ("abc abc",), ("жёлтый 5",), ("a\U0001F600b\U0001F600bc",)], "x string")
    for row in df.select(T.char_ngrams("x").alias("texts"), T.packed_ngrams(F.col("x")).alias("packed"), T.packed_ngrams(F.col("x"), 4).alias("longer"), T.char_ngrams("x", 4).alias("same")).collect():
        assert row.packed == [sum(ord(c) << (21 * i) for i, c in enumerate(g)) for g in row.texts] and row.longer == row.same
