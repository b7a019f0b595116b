"""Sources and sinks, streams, and the registered queries against their SQL."""

from __future__ import annotations

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.plans import durable, registry
from matchloom.schemas import RAW_ITEM
from matchloom.sources import io
from matchloom.streaming import items as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def test_tables_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, float("nan"))], "k long, x double")
    assert io.write_table(df, f"{tmp_path}/t") == 3
    assert io.read_table(spark, f"{tmp_path}/t", ("k", "x")).count() == 3
    with pytest.raises(ValueError):
        io.read_table(spark, f"{tmp_path}/t", ("missing",))
    with pytest.raises(ValueError):
        io.write_table(df.limit(0), f"{tmp_path}/none")
    assert io.read_table(spark, f"{tmp_path}/t").count() == 3
    with pytest.raises(ValueError):
        io.write_table(df.limit(0), f"{tmp_path}/t")
    assert io.read_table(spark, f"{tmp_path}/t").count() == 3 and sorted(os.listdir(tmp_path)) == ["t"]  # the old table stays
    assert io.write_table(df.limit(1), f"{tmp_path}/t") == 1 and io.read_table(spark, f"{tmp_path}/t").count() == 1
    io.write_table(df, f"{tmp_path}/t")
    whole = df.unionByName(spark.createDataFrame([(5, float("inf")), (6, None), (7, float("-inf"))], "k long, x double"))
    assert io.check_table(whole, ["k"], ("x",)).first()["x_not_finite"] == 4
    assert io.check_table(df, ["k"], ("x",)).first().asDict() == {"rows": 3, "repeated": 1, "x_not_finite": 1}
    facts = io.health(spark, {"t": f"{tmp_path}/t", "no": f"{tmp_path}/no"})
    assert (facts[0]["exists"], facts[0]["rows"], facts[1]["exists"], facts[1]["rows"]) == (True, 3, False, 0) and facts[0]["bytes"] > 0 and facts[0]["free"] > 0


def test_predictions_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, 4, 0.5), (0, 1, 2, 0.25)], "row_id long, id1 long, id2 long, predict double")
    io.write_predictions(df, f"{tmp_path}/p")
    part = next(x for x in os.listdir(f"{tmp_path}/p") if x.endswith(".csv"))
    assert open(f"{tmp_path}/p/{part}").read() == "id1,id2,predict\n1,2,0.25\n3,4,0.5\n"
    with pytest.raises(ValueError):
        io.write_predictions(df.withColumn("predict", F.lit(float("nan"))), f"{tmp_path}/q")
    io.write_report({"имя": 1}, f"{tmp_path}/r.json")
    assert "имя" in open(f"{tmp_path}/r.json", encoding="utf-8").read() and json.load(open(f"{tmp_path}/r.json", encoding="utf-8")) == {"имя": 1}


def test_archives_and_mirrors(spark, tmp_path):
    import zipfile

    from matchloom.sources import archive

    src = tmp_path / "run"
    src.mkdir()
    (src / "a.json").write_text("{}")
    (src / "b.bin").write_bytes(os.urandom(3000))
    members, path = {"x/a.json": f"{src}/a.json", "b.bin": f"{src}/b.bin"}, f"{tmp_path}/out.zip"
    sums = archive.write_archive(members, path)
    assert archive.verify_archive(path) == sums and set(sums) == set(members)
    for wrong in (lambda: archive.write_archive(members, path, 100), lambda: archive.write_archive({}, path), lambda: archive.verify_archive(path, 10)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.warns(UserWarning), zipfile.ZipFile(path, "a") as z:
        z.writestr("b.bin", b"again")
    with pytest.raises(ValueError, match="repeats"):
        archive.verify_archive(path)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("b.bin", b"other")
        z.writestr(archive.SUMS, f"{sums['b.bin']}  b.bin\n")
    with pytest.raises(ValueError, match="differs"):
        archive.verify_archive(path)
    mirror = f"file://{tmp_path}/mirror"
    assert archive.pull(spark, mirror, f"{tmp_path}/none") is None
    for step in ("step-1", "step-2", "step-3"):
        (src / "a.json").write_text(step)
        archive.push(spark, str(src), mirror, step)
    os.mkdir(f"{tmp_path}/mirror/step-9")  # not whole
    assert archive.whole(spark, mirror) == ["step-2", "step-3"]
    assert archive.pull(spark, mirror, f"{tmp_path}/back") == "step-3" and (tmp_path / "back/a.json").read_text() == "step-3" and sorted(os.listdir(tmp_path / "back")) == ["a.json", "b.bin"]


def test_config(tmp_path, monkeypatch):
    path = f"{tmp_path}/c.yaml"
    open(path, "w").write("paths: {raw_dir: a}\nx: {y: {z: 3}}\n")
    monkeypatch.setenv("MATCHLOOM_RAW", "/other")
    c = io.Config.load(path)
    assert c.get("x.y.z") == 3 and c.get("paths.raw_dir") == "/other" and c.get("x.q", 7) == 7


def test_compact_merges_tiny_splits_only(spark):
    many = spark.range(0, 100, 1, 90)
    assert durable.compact(many).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    assert durable.compact(spark.range(0, 100, 1, 3)).rdd.getNumPartitions() == 3
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,)], 50), "x long")
    assert durable.compact(unknown).rdd.getNumPartitions() == 50


def test_durable_tables_are_released(spark):
    df = durable.materialize(spark.range(5).toDF("x"), "test")
    path = df._durable_path.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    durable.release(df)
    assert not os.path.isdir(path)


def test_streams_match_batches(spark, tmp_path):
    rows = [(i, f"Item {i} red", '{"Бренд":"B"}', "c") for i in range(20)]
    spark.createDataFrame(rows, RAW_ITEM).repartition(4).write.parquet(f"{tmp_path}/in")
    query = stream.start(stream.canonical_stream(stream.item_stream(spark, f"{tmp_path}/in", 1)).select("id", "name_norm", "brand_norm"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted((i, f"item {i} red", "b") for i in range(20))
    counts = stream.running_token_df(stream.item_stream(spark, f"{tmp_path}/in", 1)).writeStream.format("memory").queryName("df").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {r["token"]: r["df"] for r in spark.table("df").collect()}["red"] == 20


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    rows = got.collect()
    if name not in registry.ORACLE_SQL:
        assert got.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.execute(registry.ORACLE_SQL[name])
    names, want = [d[0] for d in con.description], con.fetchall()
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in got.columns]
    key = lambda r: [(v is None, str(v)) for v in r]
    mine = sorted((tuple(map(value, r)) for r in rows), key=key)
    theirs = sorted((tuple(value(r[i]) for i in order) for r in want), key=key)
    assert [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in mine] == [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v for v in r) for r in theirs]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
