"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger stores the measurements and one bit per
failed rule; a policy is a versioned mask of bits, so applying another policy, or asking what
a policy would keep without one of its rules, is bitwise arithmetic on the ledger and
never reads a text again.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Null and empty texts have no words and fail the
word-count rule. Repeated rows are judged alike. A very long text is measured whole; beyond ``LONG`` words its windows are numbered in
arrays instead of being kept as words. Extra columns, whatever their names, are ignored by ``ledger`` and kept by ``keep_good``. No rows: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SLICE, bound_batches, fresh, map_batches, slices, word_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_letters", "n_stutters")
#: Rule name, and the SQL condition on the measurements under which a text fails. Order is bit order; append only.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
    ("exclamations", "5 * n_bangs > n_words"),
    ("stuttered_words", "10 * n_stutters > 3 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules whose failure rejects a text.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(BITS),
}
CURRENT = "v2"
WINDOW = 8
#: Words of a text beyond which repeated windows are found in arrays: the same result in less memory, and slower for short texts.
LONG = 4096
_SYMBOLS = b"#*$%&|<>"


def mask_of(version: str) -> int:
    return sum(BITS[x] for x in POLICIES[version])


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    if len(words) > LONG:
        return _repeated_in_arrays(words, window)
    grams = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total, end = 0, 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            total += at + window - max(at, end)
            end = at + window
    return total


def _repeated_in_arrays(words: list, window: int) -> int:
    """As ``repeated_words``: windows of 1, 2, 4, ... words are numbered by pairs of the numbers of their halves, which may overlap."""
    known: dict = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    size = 1
    while size < window:
        step = min(size, window - size)
        number = np.unique(number[:-step] * len(words) + number[step:], return_inverse=True)[1]
        size += step
    again = np.flatnonzero(np.bincount(number)[number] > 1)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    words = word_bytes(text)
    if not words:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    chars = sum(map(len, words))
    if len(raw) != len(text):  # code points, without continuation bytes
        chars -= len(raw) - len(text)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(lines)
    dup_lines = len(lines) - len(seen)
    letters = _letters(raw, text)
    return len(words), chars, symbols, dup_lines, repeated_words(words), len(lines), raw.count(b"!"), letters, sum(map(eq, words, words[1:]))


_ASCII_OTHER = bytes(x for x in range(128) if not chr(x).isalpha())


def _letters(raw: bytes, text: str) -> int:
    """Letters of ASCII plus all other characters from U+0080 on."""
    return len(raw.translate(None, _ASCII_OTHER)) - (len(raw) - len(text))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = list(zip(*map(measure, part.column(1).to_pylist()))) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(x, pa.int64()) for x in found)], names=["doc_id", *MEASURES]
        )


def _measured_array(texts: pa.Array) -> pa.Array:
    columns: list[list[int]] = [[] for _ in MEASURES]
    for at in range(0, len(texts), SLICE):
        for column, values in zip(columns, zip(*map(measure, texts.slice(at, SLICE).to_pylist()))):
            column += values
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(ids, _measured, "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES))


def failure_bits(measured: str = "") -> Column:
    """One bit for each failed rule; ``measured`` names a struct that holds the measurements."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        own = re.sub(r"\b(n_\w+|word_chars)\b", rf"`{measured}`.\1", condition) if measured else condition
        bits = bits.bitwiseOR(F.when(F.expr(own), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed_bits``: each rule evaluated once."""
    return measurements(docs, id_col, text_col).withColumn("failed_bits", failure_bits())


def fails(bits: Column, version: str) -> Column:
    """Whether a policy version rejects a text with these failure bits."""
    return bits.bitwiseAND(F.lit(mask_of(version)).cast("long")) != 0


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of a policy version."""
    bits = F.col("failed_bits")
    return rows.withColumn("base_failed", fails(bits, "base")).withColumn("kept", ~fails(bits, "base") & ~fails(bits, version))


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: texts failing it, failing only it, and kept with and without it.

    One aggregation over distinct bit patterns: texts are first counted by pattern.
    """
    mask = mask_of(version)
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    columns = [when(bits == 0).alias("kept")]
    names = POLICIES[version]
    for x in names:
        bit = F.lit(BITS[x]).cast("long")
        columns += [when(bits.bitwiseAND(bit) != 0).alias(f"{x}__failed"), when(bits == bit).alias(f"{x}__only")]
    one = patterns.agg(*columns)
    rules = F.array(*(
        F.struct(F.lit(x).alias("rule"), F.col(f"{x}__failed").alias("failed"), F.col(f"{x}__only").alias("failed_only"),
                 F.col("kept"), (F.col("kept") + F.col(f"{x}__only")).alias("kept_without")) for x in names
    ))
    return one.select(F.explode(rules).alias("r")).select(F.lit(version).alias("version"), "r.*")


def verdict(text: str | None, version: str = CURRENT) -> bool:
    """The verdict on one text in Python, rule by rule: for tests."""
    values = dict(zip(MEASURES, measure(text)))
    failed = {name for name, condition in RULES if eval(condition, {}, dict(values))}  # noqa: S307  fixed conditions
    return not failed & ({*POLICIES["base"]} | {*POLICIES[version]})


def keep_good(docs: DataFrame, text_col: str = "text", version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns: the ledger's bits beside each row, and the policy's mask over them."""
    bound_batches(docs.sparkSession)
    values, bits = fresh(docs, "measured", "failed_bits")
    measured = F.arrow_udf(_measured_array, ", ".join(f"{x} long" for x in MEASURES))
    rows = docs.withColumn(values, measured(docs[text_col].cast("string"))).withColumn(bits, failure_bits(values))
    return rows.where(~fails(F.col(bits), "base") & ~fails(F.col(bits), version)).select(*(docs[c] for c in docs.columns))
