"""Session settings the library is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Map keys may repeat in external attribute strings; the last one wins.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("matchloom")
    builder = builder.config(map=SETTINGS).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.host", "127.0.0.1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    import shutil
    import tempfile
    from pathlib import Path

    package = Path(__file__).resolve().parents[1]
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='matchloom-')}/matchloom", "zip", package.parent, package.name)
    context.addPyFile(made)
    _shipped.add(context.applicationId)
