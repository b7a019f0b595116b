"""Near misses by classes of equal identifiers, against a loop over all pairs; hard negatives without a bound."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from matchloom.operators import augmentation as A
from matchloom.operators import canonical as C
from matchloom.operators.ordering import numbered
from matchloom.plans import catalogue as Q
from matchloom.plans.durable import BROADCAST_ROWS, materialize
from matchloom.schemas import RAW_ITEM

TOKENS = [["ab12c"], ["ab12cst3"], ["ab13c", "zz999"], ["zz998", "ab12c"], ["q"], []]


def near(s: str, t: str) -> bool:
    return s != t and len(os.path.commonprefix([s, t])) / max(len(s), len(t)) >= 0.6


def test_near_misses_of_copies_and_several_identifiers(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 4)
    rows = [(i, TOKENS[i % len(TOKENS)]) for i in range(120)]
    items = spark.createDataFrame(rows, "id long, identifier_tokens array<string>")
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 60, 2)], "id1 long, id2 long, target double")
    want = sorted((a, d) for a, s in rows if a < 60 for d, t in rows if d >= 60 and any(near(x, y) for x in s for y in t))
    assert sorted(map(tuple, A.near_misses(pairs, items, 0.0, 0.6).collect())) == want
    classes, links = A.near_miss_classes(pairs, items, 0.0, 0.6)
    of = {r["id"]: r["class"] for r in classes.collect()}
    assert len(set(of.values())) == 10 and of[0] == of[54] == 0 and of[60] == of[114] == 60 and 5 not in of
    assert 0 < links.count() == len({(of[a], of[d]) for a, d in want}) < len(want) / 50


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_brand_edges_make_no_other_pairs(spark, sf):
    """The pairs of equal brand and type, made without all others."""
    sf = f"/root/testdata/sf{sf}"
    want = Q.labelled(spark, sf).where("target > 0.5 and not contains(category, '|')")
    got = Q.brand_edges(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    alike = ("p_brand", "p_type")
    assert Q.labelled(spark, sf, alike).count() == got.count() < Q.labelled(spark, sf).count()


def test_hard_negatives_take_all_and_number_them(spark):
    raw = [(i, f"phone rs07cst{i % 9}", None, "p") for i in range(60)] + [(i, f"filler {i}x", None, "f") for i in range(100, 160)]
    items = C.canonicalize(spark.createDataFrame(raw, RAW_ITEM))
    pairs = spark.createDataFrame([(i, i + 1, 1.0, i // 2, 0) for i in range(0, 30, 2)], "id1 long, id2 long, target double, row_id long, fold int")
    got = sorted(map(tuple, A.hard_identifier_negatives(pairs, items, 0.1, 0.6, None).select("row_id", "source_row_id", "id1", "id2").collect()))
    want = sorted((a // 2, a, d) for a in range(30) for d in range(30, 60) if a % 9 != d % 9)
    assert got == [(15 + k, *x) for k, x in enumerate(want)]


def test_raw_items_of_one_small_file_are_many_tasks(spark):
    assert Q.raw_items(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_growing_side_of_near_misses_is_broadcast(spark):
    """However few bytes its files have: Catalyst goes by these, and the driver would hold the rows."""
    raw = [(i, f"phone rs07cst{i % 9}", None, "p") for i in range(60)] + [(i, f"filler {i}x", None, "f") for i in range(100, 160)]
    items = materialize(C.canonicalize(spark.createDataFrame(raw, RAW_ITEM)), "few-items")
    pairs = materialize(spark.createDataFrame([(i, i + 1, 1.0, i // 2, 0) for i in range(0, 30, 2)], "id1 long, id2 long, target double, row_id long, fold int"), "few-pairs")
    for df in (*A.near_miss_classes(pairs, items, 0.1, 0.6), A.near_misses(pairs, items, 0.1, 0.6), A.hard_identifier_negatives(pairs, items, 0.1, 0.6, None)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_many_parts_in_a_small_file_are_not_broadcast(spark, tmp_path):
    n = BROADCAST_ROWS + 20_000
    spark.range(n).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(6).selectExpr("id div 3 AS l_orderkey", f"{n} - 1 - id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = Q.brand_edges(spark, str(tmp_path))
    assert plan(edges).count("SortMergeJoin") == 5 and "BroadcastHashJoin" not in plan(edges)
    assert sorted((n - b, n - a) for a, b, *_ in edges.collect()) == [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6)]
    assert "BroadcastHashJoin" in plan(Q.brand_edges(spark, "/root/testdata/sf0.01"))


def test_numbering_broadcasts_the_starts_of_parts_only(spark):
    """Without other columns the numbered rows are the shorter ones."""
    last = numbered(spark.range(5000).selectExpr("5000 - id AS k"), [F.asc("k")], "at").agg(F.max("at"))
    assert "BuildRight" in plan(last) and "BuildLeft" not in plan(last)
    assert last.first()[0] == 4999
