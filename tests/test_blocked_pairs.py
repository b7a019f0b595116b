"""Pairs joined to their items in blocks: the rows of the plain join, and no item sent with each of its pairs."""

from __future__ import annotations

from matchloom.operators import pairs as P


def made(spark, monkeypatch, partners: int, block: int = 100, group: int = 700):
    monkeypatch.setattr(P, "BLOCK_ITEMS", block)
    monkeypatch.setattr(P, "GROUP_PAIRS", group)
    items = spark.range(-400, 600).selectExpr("id", "id * 3 AS x").unionByName(spark.createDataFrame([(7, 0), (9_000_000_000, 1)], "id long, x long"))
    rows = [(i, (i + 400 + 7 * k) % 1005 - 400, float(k)) for i in range(-400, 605) for k in range(1, partners + 1)] + [(9_000_000_000, 7, -1.0), (None, 3, -2.0)]
    pairs = spark.createDataFrame(rows, "id1 long, id2 long, target double")
    keep = lambda x: x
    return P.join_items_in_blocks(pairs, items, keep), P.join_items(pairs, items)


def test_blocks_give_the_rows_of_the_plain_join(spark, monkeypatch):
    got, want = made(spark, monkeypatch, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 3  # pairs once, items once a side; nothing between the joins
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_few_pairs_of_many_blocks_take_the_plain_join(spark, monkeypatch):
    got, want = made(spark, monkeypatch, 1, 10)
    assert "ShuffledHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
