"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint is 64 bits over a text's 3-word shingles. Fingerprints within ``distance``
bits are linked, and a group is a connected component of links.

Method: the 64 bits are split into four blocks of 16. Two fingerprints that differ in at most
two bits agree on at least two whole blocks, so they meet under one of the six pairs of
blocks, a 32-bit key. Only distinct fingerprints are joined: copies are collapsed
beforehand, so a group of equal texts of any size is one row. Pairs that meet are verified
by their Hamming distance.

A key shared by more than ``heavy`` distinct fingerprints would make quadratically many
pairs. Its members are linked exactly and in linear work instead: each
emits itself and its 64 one-bit neighbours, and those that share such a variant are
at most two bits apart (each is within one bit of it); conversely two fingerprints at
distance two or less share one. At most 65 fingerprints meet under a variant.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other; a
text of fewer than three words is one shingle; rows with equal ids each keep a row; a null id
never names a component unless all of the component's ids are null; a very long text is hashed whole, its bits summed in
parts. Extra columns, whatever their names, are ignored by ``near_duplicates`` and kept by ``deduplicate``. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from matchloom.llm.common import bound_batches, fresh, map_batches, slices
from matchloom.operators.graph import connected_components
from matchloom.plans.durable import materialize

BLOCKS, BLOCK_BITS, DISTANCE = 4, 16, 2
#: The pairs of blocks that make a key.
KEYS = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
HEAVY = 48
_ROWS = 1 << 16


def simhash64(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        digests = [xxh64_digest(b" ".join(words), 42)]
    else:
        digests = list(map(xxh64_digest, map(b" ".join, zip(words, words[1:], words[2:])), repeat(42)))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), _ROWS):  # a long text in parts
        part = digests[at : at + _ROWS]
        bits = np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), 8), axis=1)
        # eight counters of 8 bits would overflow after 255 rows; sums of 255 rows are widened
        for lo in range(0, len(part), 255):
            ones += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
    majority = np.packbits(ones * 2 > len(digests)).tobytes()
    return int.from_bytes(majority, "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [simhash64(t) for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(ids, _fingerprints, "doc_id long, fp long")


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _key(fp: Column, blocks: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("long")
    for i in blocks:
        key = F.shiftleft(key, BLOCK_BITS).bitwiseOR(_block(fp, i))
    return key


def _first_meeting(a: Column, b: Column, kind: Column) -> Column:
    """True if no earlier pair of blocks agrees too, so that a pair is made once."""
    said = F.lit(True)
    for k, blocks in enumerate(KEYS):
        earlier = [_key(a, x) == _key(b, x) for x in KEYS[:k]]
        if earlier:
            none = ~earlier[0]
            for x in earlier[1:]:
                none = none & ~x
            said = F.when(kind == k, none).otherwise(said)
    return said


def links(distinct_fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``(a, b)``: edges whose components are those of all pairs within two bits."""
    keyed = distinct_fps.select("fp", F.posexplode(F.array(*(_key(F.col("fp"), k) for k in KEYS))).alias("kind", "key"))
    sizes = keyed.groupBy("kind", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = materialize(keyed.join(sizes, ["kind", "key"]), "simhash-blocks")
    light = met.where(F.col("members") <= heavy)
    one = light.select("kind", "key", F.col("fp").alias("a"))
    two = light.select("kind", "key", F.col("fp").alias("b"))
    pairs = (
        one.join(two, ["kind", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .where(_first_meeting(F.col("a"), F.col("b"), F.col("kind")))
        .select("a", "b")
    )
    dense = met.where(F.col("members") > heavy).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    variants = dense.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("variant"))
    near = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    stars = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def components(prints: DataFrame, rank: str = "doc_id") -> DataFrame:
    """``(fp, component, component_id)`` for every distinct fingerprint of ``(fp, rank)`` rows.

    ``component`` is a component's least fingerprint, ``component_id`` its least ``rank``.
    """
    distinct = prints.groupBy("fp").agg(F.min(rank).alias("least"))
    groups = connected_components(links(distinct.select("fp")))
    joined = distinct.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left")
    joined = joined.withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) ``, component_id``."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints", narrow=True)
    found = prints.join(components(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, of which exactly one stays for each component.

    The row with the component's least id stays (null ids come last); of several with that id, the one whose
    text, then whose whole row, has the least hash. Ids may repeat over unlike texts: every component keeps a row of its own.
    Rows are known by 128 bits of hash over all their columns; equal rows, being one text, are one component and leave one row. Only ids and
    hashes travel through the grouping, texts only through the last join, once.
    """
    first, second, fp, rank, place = fresh(docs, "first_hash", "second_hash", "fingerprint", "rank", "place")
    said = [docs[c] if f.dataType.typeName() not in ("map", "variant") else F.to_json(docs[c]) for c, f in zip(docs.columns, docs.schema)]
    rows = docs.withColumns({first: F.xxhash64(*said), second: F.xxhash64(F.lit("second"), *reversed(said))})
    bound_batches(docs.sparkSession)
    fingerprint = F.arrow_udf(_fingerprint_array, "long")
    order = F.struct(docs[id_col].isNull().alias("n"), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("t"), F.col(first).alias("a"), F.col(second).alias("b"))
    prints = materialize(rows.select(fingerprint(docs[text_col].cast("string")).alias(fp), order.alias(rank)), "simhash-prints", narrow=True)
    found = components(prints.select(F.col(fp).alias("fp"), F.col(rank).alias("rank")), "rank").where("fp = component")
    kept = materialize(found.select(F.col("component_id.a").alias(first), F.col("component_id.b").alias(second)), "simhash-kept")
    once = F.row_number().over(Window.partitionBy(first, second).orderBy(F.lit(0)))
    rows = rows.withColumn(place, once).where(F.col(place) == 1)  # equal rows are cut down before they meet
    return rows.join(kept, [first, second], "left_semi").select(*(rows[c] for c in docs.columns))


def _fingerprint_array(texts: pa.Array) -> pa.Array:
    return pa.array([simhash64(t.as_py()) for t in texts], pa.int64())
