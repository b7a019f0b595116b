"""Synthetic training rows: attribute dropout, attribute permutation, and near-miss identifier negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.operators.canonical import item_lines, serialize_pair
from matchloom.operators.graph import connected_components
from matchloom.operators.metrics import hash_int, hash_key
from matchloom.operators.ordering import numbered, place_within
from matchloom.operators.pairs import join_items
from matchloom.plans.durable import materialize, merging

PREFIX_A, PREFIX_B = "attributes_a: ", "attributes_b: "


def fragments(text: Column, prefix: str) -> Column:
    """The ``; ``-separated parts of a text's first attribute line; none without one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith(prefix))
    body = F.substring(F.get(lines, F.lit(0)), len(prefix) + 1, 1 << 30)
    return F.coalesce(F.filter(F.split(body, "; "), lambda x: x != ""), F.array().cast("array<string>"))


def attribute_ratio(text_a: Column, text_b: Column) -> Column:
    a, b = F.size(fragments(text_a, PREFIX_A)), F.size(fragments(text_b, PREFIX_B))
    return S.ratio(F.least(a, b), F.greatest(a, b, F.lit(1)))


def _with_fragments(text: Column, prefix: str, parts: Column) -> Column:
    """``text`` with the parts of its first attribute line replaced."""
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda x: x.startswith(prefix)), F.lit(True))
    made = F.concat(F.lit(prefix), F.array_join(parts, "; "))
    return F.when(first > 0, F.array_join(F.transform(lines, lambda x, i: F.when(i + 1 == first, made).otherwise(x)), "\n")).otherwise(text)


def attribute_dropout(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` and one synthetic positive for each positive, with ``is_synthetic, source_row_id``.

    The synthetic row takes the attribute ratio of another positive of its category and loses, by hash
    order, as many parts of its fuller side as that asks for; the fold is the source's. Donors are
    found by position: a category's positives are numbered in the order of ``row_id``, and the hash names a
    number other than the row's own, so no list of candidates is ever gathered.
    """
    real = rows.withColumns({"is_synthetic": F.lit(False), "source_row_id": F.lit(None).cast("long")})
    positives = rows.where(F.col("target") > 0.5)
    own = place_within(positives, ["category"], [F.asc("row_id")], "__place")
    counts = positives.groupBy(F.col("category").alias("__c")).agg(F.count("*").alias("__n"))
    own = materialize(own.join(counts, F.col("category").eqNullSafe(F.col("__c"))).drop("__c").withColumn("__ratio", attribute_ratio(F.col("text_a"), F.col("text_b"))), "dropout-donors")
    step = F.pmod(hash_int(F.lit(seed), F.col("row_id"), F.lit("donor")), F.greatest(F.col("__n") - 1, F.lit(1))) + F.when(F.col("__n") > 1, 1).otherwise(0)
    asking = own.withColumn("__donor", F.pmod(F.col("__place") + step, F.col("__n")))
    donors = own.select("category", F.col("__place").alias("__donor"), F.col("__ratio").alias("__target"))
    made = asking.join(donors, ["category", "__donor"])
    made = made.withColumns({"__a": fragments(F.col("text_a"), PREFIX_A), "__b": fragments(F.col("text_b"), PREFIX_B)})
    fuller_a = F.size("__a") > F.size("__b")
    more, less = F.greatest(F.size("__a"), F.size("__b")), F.least(F.size("__a"), F.size("__b"))
    wanted = F.when((less > 0) & (F.col("__target") > 0), F.least(more, F.greatest(less, F.floor(F.coalesce(F.try_divide(less.cast("double"), F.col("__target")), F.lit(0.0)) + 0.5)))).otherwise(more)
    made = made.withColumn("__drop", F.when(less > 0, more - wanted).otherwise(0).cast("int"))

    def kept(side: str) -> Column:
        parts = F.col(f"__{side}")
        order = F.array_sort(F.transform(parts, lambda p, i: F.struct(hash_key(F.lit(seed), F.col("row_id"), F.lit(side), i).alias("h"), i.alias("i"))))
        gone = F.transform(F.slice(order, F.lit(1), F.col("__drop")), lambda o: o["i"])
        return F.filter(parts, lambda p, i: ~F.array_contains(gone, i))

    synthetic = made.withColumns({
        "__ta": F.when(fuller_a & (F.col("__drop") > 0), _with_fragments(F.col("text_a"), PREFIX_A, kept("a"))).otherwise(F.col("text_a")),
        "__tb": F.when(~fuller_a & (F.col("__drop") > 0), _with_fragments(F.col("text_b"), PREFIX_B, kept("b"))).otherwise(F.col("text_b")),
    })
    top = rows.agg(F.max("row_id").alias("__top"))  # one row
    before = positives.groupBy("category").agg(F.count("*").alias("__m")).withColumn("__base", F.sum("__m").over(Window.orderBy("category")) - F.col("__m")).drop("__m")  # a row a category
    numbered = synthetic.withColumn("__k", F.col("__place") + 1).join(before, "category").crossJoin(F.broadcast(top))
    values = {"row_id": F.col("__top") + F.col("__base") + F.col("__k"), "text_a": F.col("__ta"), "text_b": F.col("__tb"), "is_synthetic": F.lit(True), "source_row_id": F.col("row_id")}
    out = numbered.select(*(values.get(c, F.col(c)).alias(c) for c in [*rows.columns, "is_synthetic", "source_row_id"]))
    return real.unionByName(out)


def _permuted(text: Column, prefix: str, seed: int) -> Column:
    """Every attribute line's parts in hash order; where that shows no change, rotated until it does."""

    def line(x: Column, at: Column) -> Column:
        parts = F.split(F.substring(x, len(prefix) + 1, 1 << 30), "; ")
        order = F.array_sort(F.transform(parts, lambda p, i: F.struct(hash_key(F.lit(seed), F.col("row_id"), F.lit(prefix), at, i).alias("h"), p.alias("p"))))
        mixed = F.transform(order, lambda o: o["p"])
        turned = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.slice(parts, k + 1, F.size(parts)), F.slice(parts, F.lit(1), k)))
        changed = F.filter(F.concat(F.array(mixed), turned), lambda c: c != parts)
        best = F.coalesce(F.get(changed, F.lit(0)), parts)
        return F.when(x.startswith(prefix) & (F.size(parts) > 1), F.concat(F.lit(prefix), F.array_join(best, "; "))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def attribute_permutation(rows: DataFrame, probability: float, seed: int) -> DataFrame:
    """Rows with permuted attribute parts where the pair is selected by hash; ``selected`` and ``changed`` say what happened."""
    chosen = hash_int(F.lit(seed), F.col("row_id"), F.lit("pair")) < F.lit(int(probability * 2**32))
    made = rows.withColumns({"selected": chosen, "__a": F.when(chosen, _permuted(F.col("text_a"), PREFIX_A, seed)).otherwise(F.col("text_a")), "__b": F.when(chosen, _permuted(F.col("text_b"), PREFIX_B, seed)).otherwise(F.col("text_b"))})
    made = made.withColumn("changed", (F.col("__a") != F.col("text_a")) | (F.col("__b") != F.col("text_b")))
    return made.withColumns({"text_a": F.col("__a"), "text_b": F.col("__b")}).drop("__a", "__b")


def permutation_summary(permuted: DataFrame) -> DataFrame:
    """One row: rows, rows selected, changed, and left clean by ``attribute_permutation``."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return permuted.agg(F.count("*").alias("rows"), count(F.col("selected")).alias("selected"), count(F.col("changed")).alias("changed"), count(~F.col("selected")).alias("clean"))


#: Ids of a class that one row of ``near_misses`` holds on either side before it is expanded.
CHUNK = 1024


def near_miss_classes(pairs: DataFrame, items: DataFrame, least_idf: float, share: float) -> tuple[DataFrame, DataFrame]:
    """``(id, class)`` and ``(anchor_class, donor_class)``: items of equal rare identifiers on one side are a class, named by its least id, and classes are linked as their identifiers are.

    Anchors are in a positive component, donors in none. A prefix of at least ``share`` of the longer identifier must agree, and the identifiers must differ.
    Each identifier is compared once, whatever the number of items that have it. Those of anchors are indexed by the first ``ceil(length * share)`` characters; those of donors probe with
    those of their own prefixes that an anchor of fitting length can have, none shorter than about ``share`` squared of their length, so the theta join is an equi-join on prefixes with a residual filter, and short prefixes do not gather all.
    All sides grow with the items, so none is ever broadcast but their number.
    """
    positives = pairs.where(F.col("target") > 0.5)
    members = positives.select(F.explode(F.array("id1", "id2")).alias("id")).distinct().withColumn("__anchor", F.lit(True))
    spread = items.select("id", F.explode(F.array_distinct("identifier_tokens")).alias("token"))
    df = spread.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(items.agg(F.count("*").alias("n"))))
    rare = spread.join(df.where(S.normalized_idf(F.col("n"), F.col("df")) >= least_idf).select("token").transform(merging), "token", "left_semi")
    sets = rare.groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    sets = sets.join(merging(members), "id", "left").select("id", "tokens", F.coalesce("__anchor", F.lit(False)).alias("anchor"))
    sets = materialize(sets, "identifier-sets")
    kinds = sets.groupBy("tokens", "anchor").agg(F.min("id").alias("class"))
    kinds = materialize(kinds, "identifier-classes", narrow=True)
    classes = sets.join(merging(kinds), ["tokens", "anchor"]).select("id", "class")
    held = kinds.select("anchor", "class", F.explode("tokens").alias("token"))
    length = F.ceil(F.length("token") * F.lit(share)).cast("int")
    shortest = F.greatest(F.lit(1), F.floor(F.floor(F.length("token") * F.lit(share)) * F.lit(share)).cast("int"))
    anchors = held.where("anchor").select("token").distinct().select(F.col("token").alias("anchor_token"), F.substring(F.col("token"), F.lit(1), length).alias("prefix"))
    probes = held.where("not anchor").select("token").distinct().select(F.col("token").alias("donor_token"), F.explode(F.sequence(shortest, F.length("token"))).alias("k"))
    probes = probes.select("donor_token", F.substring(F.col("donor_token"), F.lit(1), F.col("k")).alias("prefix"))
    met = anchors.join(merging(probes), "prefix").where((F.col("anchor_token") != F.col("donor_token")) & (T.prefix_share(F.col("anchor_token"), F.col("donor_token")) >= share)).select("anchor_token", "donor_token")
    one = held.where("anchor").select(F.col("token").alias("anchor_token"), F.col("class").alias("anchor_class"))
    two = held.where("not anchor").select(F.col("token").alias("donor_token"), F.col("class").alias("donor_class"))
    return classes, met.join(merging(one), "anchor_token").join(merging(two), "donor_token").select("anchor_class", "donor_class").distinct()


def near_misses(pairs: DataFrame, items: DataFrame, least_idf: float, share: float) -> DataFrame:
    """``(anchor, donor)``: items outside all positive components whose rare identifier shares a prefix with a positive item's, from ``near_miss_classes``.

    An id is in one class and linked classes are distinct, so no pair comes twice and none is compared or shuffled by itself: classes are
    cut into chunks of about ``CHUNK`` ids, linked chunks are dealt out, and each is expanded where it lies.
    """
    classes, links = near_miss_classes(pairs, items, least_idf, share)
    classes = materialize(classes, "near-miss-classes")
    sizes = classes.groupBy("class").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("__chunks"))
    chunks = classes.join(merging(sizes), "class").groupBy("class", F.pmod(F.xxhash64("id"), F.col("__chunks")).alias("chunk")).agg(F.collect_list("id").alias("ids"))
    chunks = materialize(chunks, "near-miss-chunks")
    named = lambda side: merging(chunks).select(*(F.col(c).alias(f"{side}_{c}") for c in chunks.columns))
    linked = links.join(named("anchor"), "anchor_class").join(named("donor"), "donor_class")
    parts = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = linked.repartition(parts, "anchor_class", "anchor_chunk", "donor_class", "donor_chunk")
    return dealt.select("donor_ids", F.explode("anchor_ids").alias("anchor")).select("anchor", F.explode("donor_ids").alias("donor"))


def hard_identifier_negatives(pairs: DataFrame, items: DataFrame, least_idf: float, share: float, most: int | None) -> DataFrame:
    """Synthetic negatives of ``near_misses``; each inherits the anchor's first positive row. More than ``most`` is an error, never a sample; ``None`` takes them all."""
    found = near_misses(pairs, items, least_idf, share)
    if most is not None:
        found = materialize(found, "near-misses")
        if found.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} eligible pairs")
    positives = pairs.where(F.col("target") > 0.5)
    first = positives.select(F.explode(F.array("id1", "id2")).alias("anchor"), F.struct("row_id", "fold").alias("s")).groupBy("anchor").agg(F.min("s").alias("s"))
    made = found.join(merging(first), "anchor").select(F.col("anchor").alias("id1"), F.col("donor").alias("id2"), F.lit(0.0).alias("target"), "s.fold", F.col("s.row_id").alias("source_row_id"))
    top = pairs.agg(F.max("row_id")).first()[0]
    made = numbered(made, [F.asc("source_row_id"), F.asc("id1"), F.asc("id2")], "row_id").withColumn("row_id", F.col("row_id") + F.lit(1 if top is None else top + 1).cast("long"))
    made = materialize(made, "numbered-negatives")
    keyed = made.select("id1", "id2", "target", "fold", "row_id")
    lined = items.select("id", "category", *(v.alias(k) for k, v in item_lines().items()))
    joined = join_items(keyed, merging(lined))
    a, b = serialize_pair()
    texts = joined.select("row_id", S.pair_category(F.col("left.category"), F.col("right.category")).alias("category"), a.alias("text_a"), b.alias("text_b"))
    return merging(made).join(texts, "row_id").withColumn("is_synthetic", F.lit(True))


def positive_components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` over positive pairs."""
    return connected_components(pairs.where(F.col("target") > 0.5).select(F.col("id1").alias("a"), F.col("id2").alias("b")))
