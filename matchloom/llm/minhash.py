"""Document fingerprints by one-permutation MinHash, with built-in functions only.

A text's 5-word shingles are hashed once, to 64 bits. The top bits of a hash are its bin, the rest its
value, and a bin keeps the least value it receives: adding one sentinel per bin and sorting the
hashes once leaves each bin's least value first in its run, so all bins come from
one sort and one filter. A bin that receives nothing borrows the value of a filled bin by optimal
densification: it tries bins in an order of its own, drawn by hash and the same for every
document, until one is filled, so that borrowed bins are as likely to agree as filled ones.
Sixteen tries are made by hashing; a bin still empty takes the filled bin that
comes first in a hash order over bins, which ends the search for texts of any length.

The fingerprint stores the ``STORED`` low-order bits of every bin. Unequal values agree in them by
chance, in ``2 ** -STORED`` of the bins, which ``likeness`` takes out again.

Words are runs of ``[^\\x20\\x09-\\x0D]``; a text of fewer than five words is one shingle. Null, empty
and blank texts have the empty fingerprint, whose likeness is 1 to itself and 0 to others. Equal
texts have equal fingerprints, and very long texts are hashed whole. Repeated ids are ordered by their text's hash, null ids come last; ids may be any 64-bit numbers. Other
columns are not read, whatever their names. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.plans.durable import materialize

SHINGLE, BINS, STORED, TRIES = 5, 256, 4, 16
_VALUE_BITS = 64 - (BINS.bit_length() - 1)
_TOP = (1 << _VALUE_BITS) - 1
#: Rows of one ordered chunk; most chunks, whose bounds of 24 bytes each are broadcast; and those that a row is compared with at a time.
CHUNK_ROWS, GROUP = 1000, 400
MOST_CHUNKS = GROUP * GROUP


def _sentinels() -> Column:
    """The greatest hash of every bin, as signed longs."""
    bins = F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)).cast("array<bigint>")
    return F.transform(bins, lambda b: F.shiftleft(b, _VALUE_BITS).bitwiseOR(F.lit(_TOP)))


def fingerprint_bits(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the stored bits of every bin (tinyint), or an empty array for no words.

    Steps are separate projections, so that inner results are computed once.
    """
    w, s, b, f, d, q = (f"__{out}_{x}" for x in "wsbfdq")
    df = df.withColumn(w, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(SHINGLE))))
    df = df.withColumn(s, F.when(F.size(w) > 0, F.sort_array(F.concat(hashes, _sentinels()))))
    first = lambda x, i: (i == 0) | (F.shiftright(x, _VALUE_BITS) != F.shiftright(F.get(F.col(s), i - 1), _VALUE_BITS))
    value = lambda x: x.bitwiseAND(F.lit(_TOP))
    df = df.withColumn(b, F.filter(F.col(s), first))
    df = df.withColumn(f, F.transform(F.col(b), lambda x: F.when(value(x) != _TOP, value(x))))
    open_ = lambda bins: F.exists(bins, lambda v: v.isNull())
    probe = lambda i, a: F.get(F.col(f), F.pmod(F.xxhash64(i, a), F.lit(BINS)).cast("int"))
    state = F.struct(F.col(f).alias("bins"), open_(F.col(f)).alias("open"))

    def attempt(acc: Column, a: Column) -> Column:
        bins = F.transform(acc["bins"], lambda v, i: F.coalesce(v, probe(i, a)))
        return F.when(acc["open"], F.struct(bins.alias("bins"), F.lit(True).alias("open"))).otherwise(acc)

    tried = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), state, attempt, lambda acc: acc["bins"])
    df = df.withColumn(d, F.when(open_(F.col(f)), tried).otherwise(F.col(f)))
    filled = F.filter(F.transform(F.col(f), lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"].isNotNull())
    df = df.withColumn(q, F.when(open_(F.col(d)), filled))
    nearest = lambda i: F.array_min(F.transform(F.col(q), lambda x: F.struct(F.xxhash64(i, x["i"], F.lit(TRIES + 1)).alias("h"), x["v"].alias("v"))))["v"]
    whole = F.when(open_(F.col(d)), F.transform(F.col(d), lambda v, i: F.coalesce(v, nearest(i)))).otherwise(F.col(d))
    low = F.transform(whole, lambda v: v.bitwiseAND(F.lit((1 << STORED) - 1)).cast("tinyint"))
    return df.withColumn(out, F.coalesce(low, F.array().cast("array<tinyint>"))).drop(w, s, b, f, d, q)


def packed(bits: Column) -> Column:
    """The stored bits as a string: one hex digit a bin."""
    return F.array_join(F.transform(bits, lambda v: F.lower(F.hex(v.cast("long")))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, without the share of chance agreements."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda m: m)).cast("double") / F.lit(float(BINS))
    chance = 2.0**-STORED
    true = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - F.lit(chance)) / F.lit(1.0 - chance)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(true)


def _order(id_: Column, text: Column) -> Column:
    """A key whose ascending order is descending id, null ids last, then the text's hash. The complement of an id reverses its order without overflow."""
    return F.struct(id_.isNull().alias("none"), F.coalesce(F.bitwise_not(id_), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"))


def _bounds(rows: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The least key of every chunk in two levels, and their number: one row ``coarse`` with every ``GROUP``-th, and a row ``group, base, fine`` for those between.

    Chunks are ranged parts of the keys alone, so dense, sparse and repeated ids make chunks of like size.
    """
    keys = rows.select("key.*")
    ranged = keys.repartitionByRange(max(1, min(MOST_CHUNKS, rows.count() // chunk_rows)), *keys.columns)
    least = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*keys.columns)).alias("least"))
    numbered = least.select("least", (F.row_number().over(Window.orderBy("part")) - 1).alias("number"))  # a row a chunk
    grouped = numbered.groupBy(F.floor(F.col("number") / GROUP).cast("int").alias("group")).agg(F.min("number").alias("base"), F.array_sort(F.collect_list("least")).alias("fine"))
    groups = materialize(grouped, "fingerprint-bounds")
    coarse = groups.agg(F.array_sort(F.collect_list(F.get("fine", F.lit(0)))).alias("coarse"))
    return coarse, groups, groups.agg(F.coalesce(F.sum(F.size("fine")), F.lit(0))).first()[0]


def _last_upto(bounds: Column, key: Column) -> Column:
    """The position of the last bound that is not above a key, 0 if all are, by binary search."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(GROUP.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step) <= key, at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``doc_id, text, next_text, extra, chunk, place``: texts beside those of the next row in descending id, the last's being the first's.

    A row's chunk is found by binary search among the chunks' bounds. The first row of a chunk also goes to the chunk before it (``extra``), so that
    one window per chunk sees every neighbour and texts are shuffled once.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", _order(F.col("doc_id"), F.col("text")))
    coarse, groups, n = _bounds(rows, chunk_rows)
    rows = rows.withColumn("coarse", coarse.scalar()).withColumn("group", _last_upto(F.col("coarse"), F.col("key"))).drop("coarse")
    rows = rows.join(F.broadcast(groups), "group").withColumn("at", _last_upto(F.col("fine"), F.col("key")))  # MOST_CHUNKS keys at most
    rows = rows.withColumns({"chunk": F.col("base") + F.col("at"), "first": F.get("fine", F.col("at")) == F.col("key")}).drop("fine")
    own = F.struct(F.col("chunk"), F.lit(0).alias("extra"))
    before = F.struct(F.pmod(F.col("chunk") - 1, F.lit(max(1, n))).alias("chunk"), F.lit(1).alias("extra"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("first"), F.array(own, before)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "to.chunk", "to.extra", "key")
    order = Window.partitionBy("chunk").orderBy("extra", "key", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order)).drop("key")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the last third replaced by the next text's beginning."""
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = rows.select("doc_id", "chunk", "extra", "place", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = fingerprint_bits(rows, "text", "bits").drop("text")
    rows = fingerprint_bits(rows, "edited", "edited_bits").drop("edited")
    rows = rows.withColumn("next_bits", F.lead("bits").over(Window.partitionBy("chunk").orderBy("place")))
    return rows.where("extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
