"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker turns into Python objects at a time; bounds its memory.
SLICE = 256
#: Bytes of texts that travel to or from a Python worker at a time.
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Entries of a worker's word cache before it is emptied; bounds its memory.
CACHE = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its columns are called (Spark ignores case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_BYTES``, whatever the texts' lengths (but one text is never split)."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes a batch, so that a worker's memory does not follow the texts' lengths."""
    if spark.conf.get(BYTES, "64m") != BATCH_BYTES:
        spark.conf.set(BYTES, BATCH_BYTES)


def word_bytes(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Characters of all words that a cache holds at most, as a word may be a whole text without white space.
CACHE_CHARS = 16 << 20


class Bounded(dict):
    """A cache that is emptied when full, in entries or in their characters; its contents never change a result."""

    chars = 0

    def room(self, more: int, chars: int) -> bool:
        """Whether so many new words fit beside the old ones, which are dropped if not."""
        if len(self) + more <= CACHE and self.chars + chars <= CACHE_CHARS:
            self.chars += chars
            return True
        self.clear()
        self.chars = chars
        return False


class Numbers(dict):
    """Words to their numbers; an unknown word gets the next one and waits in ``new`` until its value joins ``ids``."""

    def __init__(self) -> None:
        super().__init__()
        self.ids: list[bytes] = []
        self.new: list = []
        self.chars = 0

    def __missing__(self, word) -> int:  # noqa: ANN001
        n = self[word] = len(self)
        self.new.append(word)
        self.chars += len(word)
        return n

    def forget_beyond(self, most: int) -> None:
        """Empty a cache that has grown too large in words or characters; its contents never change a result."""
        if len(self.ids) > most or self.chars > CACHE_CHARS:
            self.clear()
            self.ids.clear()
            self.chars = 0
