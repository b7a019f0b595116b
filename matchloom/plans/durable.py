"""Intermediate tables in the shared folder, so that no step depends on one executor's disk.

``materialize`` cuts lineage by writing Parquet below ``spark.checkpoint.dir`` and
reading it back. Unlike ``checkpoint()`` it computes its input once, and unlike
``localCheckpoint`` the copy survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a writing task holds before it flushes a row group.
BLOCK = 32 << 20
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` where set.

    Unset, a local session gets a temporary folder and a cluster its warehouse
    folder, which executors share; a machine-local folder is never used on a cluster.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        made = getattr(shared_dir, "_own", None) or tempfile.mkdtemp(prefix="matchloom-")
        shared_dir._own = made  # type: ignore[attr-defined]
        return f"file://{made}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    ``narrow`` rows, such as ids and hashes of long texts, are first rebalanced into few files of
    full size; otherwise every task of the scan would leave a tiny one.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if narrow else df
    path = f"{shared_dir(spark)}/matchloom/{label}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.size": BLOCK, "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)  # no mark, as nothing asks for it and each costs processes of the driver's
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._durable_path = path  # type: ignore[attr-defined]
    return back


def compact(df: DataFrame) -> DataFrame:
    """``df``, read in no more tasks than eight a core or one for 64 MB of input, whichever are more: splits of many tiny files are read, and later written, together."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min((1 << 31) - 1, max(8 * spark.sparkContext.defaultParallelism, size >> 26)))  # a size unknown to Catalyst is a very large one


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Short rows on which much work waits, dealt out by ``key`` to four tasks a core or one for 4 MB, whichever are more: a small file is otherwise one split and all its work one task."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, min(1 << 14, size >> 22)), *key)


def merging(df: DataFrame) -> DataFrame:
    """``df``, whose next join is one of sorted sides: for a side that grows with the input and must not be broadcast.

    Catalyst broadcasts by the size of files. Ids and repeated words take a small part of their memory there, so that a file below Spark's bound can be more than the driver holds.
    """
    return df.hint("merge")


#: Rows of a table of the catalogue up to which Catalyst may broadcast them: some 100 bytes of the driver's memory each.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """A scanned table: as it is up to ``BROADCAST_ROWS``, counted from the files' footers; else ``merging``."""
    return merging(df) if df.count() > BROADCAST_ROWS else df


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    path = getattr(df, "_durable_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release_all() -> None:
    """Delete what is left; at exit a stopped session is no error."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            continue
    _written.clear()
