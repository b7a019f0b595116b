"""Pairs joined to their items, their features and their texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.operators import corpus as K
from matchloom.operators.canonical import item_lines, serialize_pair
from matchloom.plans.durable import materialize
from matchloom.schemas import PAIR_FIELDS

KEYS = ("id1", "id2", "target", "fold", "row_id", "is_synthetic")


def endpoint_ids(pairs: DataFrame) -> DataFrame:
    """Distinct ids of both sides."""
    return pairs.select(F.col("id1").alias("id")).union(pairs.select(F.col("id2"))).distinct()


def only_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items whose id is among ``ids``: a semi-join that Catalyst broadcasts or shuffles by size."""
    return items.join(ids, "id", "left_semi")


def missing_ids(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of pairs that no item has."""
    return endpoint_ids(pairs).join(items.select("id"), "id", "left_anti")


def prepared_items(items: DataFrame, ngram: int = 3) -> DataFrame:
    """Per-item intermediates of the features, computed once per item and not once per pair, without the columns that no feature reads, so that they do not travel with every pair."""
    attributes = T.attribute_map(F.col("remaining_attributes"))
    facts = S.attribute_facts(attributes, lambda v: T.tokens(T.plain(v)), T.identifier_tokens, lambda v: T.numeric_tokens(T.plain(v)))
    fields = F.struct(*(T.tokens(F.col(f"{f}_norm")).alias(f) for f in PAIR_FIELDS))
    forms = F.struct(*(T.identifier_form(F.col(f"{f}_norm")).alias(f) for f in ("model", "article")))
    unread = [c for c in items.columns if c.endswith("_raw") or c in ("name_translit", "parse_error", "remaining_attributes")]
    made = items.withColumns({"identifier_forms": forms, "name_tokens": T.tokens(F.col("name_norm")), "name_grams": T.packed_ngrams(F.col("name_norm"), ngram), "attribute_facts": facts, "field_tokens": fields})
    return made.drop(*unread)


def join_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Each pair with ``left`` and ``right``, its items in ascending order of id, so that everything after is symmetric."""
    packed = items.select("id", F.struct(*(F.col(c) for c in items.columns)).alias("item"))
    keys = [F.col(c) for c in KEYS if c in pairs.columns]
    one = packed.select(F.col("id").alias("__l"), F.col("item").alias("left"))
    two = packed.select(F.col("id").alias("__r"), F.col("item").alias("right"))
    ordered = pairs.select(*keys, F.least("id1", "id2").alias("__l"), F.greatest("id1", "id2").alias("__r"))
    return ordered.join(one, "__l").join(two, "__r").drop("__l", "__r")


#: Items of a block of ids, and pairs of a group, of ``join_items_in_blocks``.
BLOCK_ITEMS, GROUP_PAIRS = 20_000, 1_000_000


def _block(item_id: Column, cuts: list[float], first: int = 0) -> Column:
    """The number of cuts that are at most the id, by bisection."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(item_id < F.lit(int(cuts[k])), _block(item_id, cuts[:k], first)).otherwise(_block(item_id, cuts[k + 1:], first + k + 1))


def _cuts(items: DataFrame, blocks: int) -> list[float]:
    """The first ids of all blocks but the first."""
    return sorted(set(items.approxQuantile("id", [k / blocks for k in range(1, blocks)], 0.1 / blocks)))


_PLACE = ("__a", "__b", "__s")


def _split(item_id: Column) -> Column:
    """The split of its group that a left id goes to."""
    return F.pmod(F.xxhash64(item_id), F.col("__splits")).cast("int").alias("__s")


def _meet(dealt: DataFrame, items: DataFrame, groups: DataFrame, cuts: list[float], parts: int, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``dealt`` pairs, in ``parts`` by their place, with ``left`` and ``right``: items go to the places of their block and are prepared there."""

    def side(block: str, at: Column, key: str, name: str) -> DataFrame:
        there = items.withColumn(block, _block(F.col("id"), cuts)).join(groups, block).select(*items.columns, "__a", "__b", at).repartition(parts, *_PLACE)
        made = prepare(there)
        return made.select(*_PLACE, F.col("id").alias(key), F.struct(*(F.col(c) for c in made.columns if c not in _PLACE)).alias(name)).hint("shuffle_hash")

    one = side("__a", _split(F.col("id")), "__l", "left")
    two = side("__b", F.explode(F.sequence(F.lit(0), F.col("__splits") - 1)).alias("__s"), "__r", "right")
    return dealt.join(one, [*_PLACE, "__l"]).join(two, [*_PLACE, "__r"])


def join_items_in_blocks(pairs: DataFrame, items: DataFrame, prepare: Callable[[DataFrame], DataFrame] = prepared_items) -> DataFrame:
    """The rows of ``join_items`` over ``prepare(items)``, without an item travelling with each of its pairs.

    Ids are ranged into blocks and pairs fall into groups by the blocks of both sides; groups of very many pairs are split. Pairs go to their group once, as ids, and an item once to each group of
    its block, where two hash joins find both sides in passing. Items are prepared where they arrive. Where groups are so many that items would travel more often than with their pairs, they do that.
    """
    spark = pairs.sparkSession
    blocks = -(-items.count() // BLOCK_ITEMS)
    if blocks < 2:
        return join_items(pairs, prepare(items))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # read as the plan is made; without it both joins would deal everything out again by id
    items, pairs = materialize(items, "items"), materialize(pairs, "pairs")
    cuts = _cuts(items, blocks)
    keys = [F.col(c) for c in KEYS if c in pairs.columns]
    ordered = pairs.select(*keys, F.least("id1", "id2").alias("__l"), F.greatest("id1", "id2").alias("__r")).withColumns({"__a": _block(F.col("__l"), cuts), "__b": _block(F.col("__r"), cuts)})
    groups = materialize(ordered.groupBy("__a", "__b").agg(F.ceil(F.count("*") / F.lit(GROUP_PAIRS)).cast("int").alias("__splits"), F.count("*").alias("__n")), "pair-groups", narrow=True)
    n, splits, rows = groups.agg(F.count("*"), F.sum("__splits"), F.sum("__n")).first()
    if not n or (n + splits) * BLOCK_ITEMS > 2 * rows:
        return join_items(pairs, prepare(items))
    groups = F.broadcast(groups.drop("__n"))  # at most a row for 10,000 pairs
    parts = max(2 * splits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ordered.join(groups, ["__a", "__b"]).select(*keys, "__l", "__r", "__a", "__b", _split(F.col("__l"))).repartition(parts, *_PLACE)
    return _meet(dealt, items, groups, cuts, parts, prepare).drop(*_PLACE, "__l", "__r")


def pairs_of_baskets(baskets: DataFrame) -> DataFrame:
    """Distinct ``(id1, id2)``, id1 the lesser, of ids in one array of ``ids``, which are sorted and distinct."""
    return baskets.select("ids", F.explode("ids").alias("id1")).select("id1", F.explode("ids").alias("id2")).where("id1 < id2").distinct()


def join_baskets_in_blocks(baskets: DataFrame, items: DataFrame, prepare: Callable[[DataFrame], DataFrame] = prepared_items) -> DataFrame:
    """The rows of ``join_items`` over ``pairs_of_baskets`` and ``prepare(items)``, without the pairs or their items ever being written.

    Blocks, groups and joins are those of ``join_items_in_blocks``. A basket goes to each group that it has pairs of, as the ids of both blocks; pairs are made there, and equal ones meet there,
    as a group has all of its baskets. Where most baskets have but a pair or two in a group, pairs go instead, which are then shorter.
    """
    spark = baskets.sparkSession
    blocks = -(-items.count() // BLOCK_ITEMS)
    if blocks < 2:
        return join_items(pairs_of_baskets(baskets), prepare(items))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # as in join_items_in_blocks
    baskets, items = materialize(baskets, "baskets"), materialize(items, "items")
    cuts = _cuts(items, blocks)
    placed = baskets.select("ids", F.transform("ids", lambda x: _block(x, cuts)).alias("__of"))
    each = placed.withColumn("__a", F.explode(F.array_distinct("__of"))).withColumn("__b", F.explode(F.array_distinct("__of"))).where("__a <= __b")
    many = lambda block: F.size(F.filter("__of", lambda of: of == F.col(block))).cast("long")
    met = each.select("__a", "__b", F.when(F.col("__a") < F.col("__b"), many("__a") * many("__b")).otherwise((many("__a") * (many("__a") - 1) / 2).cast("long")).alias("__n")).where("__n > 0")
    groups = met.groupBy("__a", "__b").agg(F.ceil(F.sum("__n") / F.lit(GROUP_PAIRS)).cast("int").alias("__splits"), F.sum("__n").alias("__n"), F.count("*").alias("__baskets"))
    groups = materialize(groups, "basket-groups", narrow=True)
    n, splits, rows, sent = groups.agg(F.count("*"), F.sum("__splits"), F.sum("__n"), F.sum(F.col("__baskets") * F.col("__splits"))).first()
    if not n or (n + splits) * BLOCK_ITEMS > 2 * rows:
        return join_items(pairs_of_baskets(baskets), prepare(items))
    groups = F.broadcast(groups.select("__a", "__b", "__splits"))
    parts = max(2 * splits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = each.join(groups, ["__a", "__b"]).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__splits") - 1)))
    ours = F.filter("ids", lambda x, i: (F.get("__of", i) == F.col("__a")) & ((F.col("__splits") == 1) | (_split(x) == F.col("__s"))))
    cut = split.select(*_PLACE, ours.alias("__ls"), F.filter("ids", lambda _, i: F.get("__of", i) == F.col("__b")).alias("__rs"))
    cut = cut.where(F.get("__ls", F.lit(0)) < F.element_at("__rs", -1))
    made = lambda df: df.select(*_PLACE, "__rs", F.explode("__ls").alias("__l")).select(*_PLACE, "__l", F.explode("__rs").alias("__r")).where("__l < __r")
    dealt = made(cut.repartition(parts, *_PLACE)) if rows > 2 * sent else made(cut).repartition(parts, *_PLACE)
    return _meet(dealt.distinct(), items, groups, cuts, parts, prepare).select(F.col("__l").alias("id1"), F.col("__r").alias("id2"), "left", "right")


def name_features() -> dict[str, Column]:
    a, b = "left.name_norm", "right.name_norm"
    la, lb = F.length(a), F.length(b)
    return {
        "name_token_jaccard": S.set_jaccard(F.col("left.name_tokens"), F.col("right.name_tokens")), "name_token_containment": S.containment(F.col("left.name_tokens"), F.col("right.name_tokens")),
        "name_char_jaccard": S.set_jaccard(F.col("left.name_grams"), F.col("right.name_grams")), "name_length_ratio": S.ratio(F.least(la, lb), F.greatest(la, lb, F.lit(1))),
        "name_exact": S.flag((F.col(a) != "") & (F.col(a) == F.col(b))),
    }


def _set_features(kind: str) -> dict[str, Column]:
    a, b = F.col(f"left.{kind}_tokens"), F.col(f"right.{kind}_tokens")
    return {f"{kind}_jaccard": S.set_jaccard(a, b), f"{kind}_exact_nonempty": S.set_exact(a, b), f"{kind}_conflict": S.set_conflict(a, b)}


def _field_features() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for f in PAIR_FIELDS:
        a, b = F.col(f"left.{f}_norm"), F.col(f"right.{f}_norm")
        for name, value in zip(("both", "equal", "conflict"), S.field_relation(a, b)):
            out[f"{f}_{name}"] = value
        out[f"{f}_token_jaccard"] = S.set_jaccard(F.col(f"left.field_tokens.{f}"), F.col(f"right.field_tokens.{f}"))
        if f in ("model", "article"):
            out[f"{f}_identifier_equal"] = S.flag((a != "") & (b != "") & (F.col(f"left.identifier_forms.{f}") == F.col(f"right.identifier_forms.{f}")))
        if f == "brand":
            ta, tb = F.col("left.brand_translit"), F.col("right.brand_translit")
            out["brand_translit_equal"] = S.flag((ta != "") & (ta == tb))
    return out


def features(joined: DataFrame, tolerance: float = 0.015, extra: dict[str, Column] | None = None) -> DataFrame:
    """The 67 pair features, with ``category`` and what is ``extra``, beside the pair's keys, from ``join_items`` over ``prepared_items``."""
    keys = [c for c in KEYS if c in joined.columns]
    lo, hi = (f("left.attribute_count", "right.attribute_count").cast("double") for f in (F.least, F.greatest))
    counts = {"attribute_count_min": lo, "attribute_count_max": hi, "attribute_count_difference": hi - lo, "attribute_count_ratio": lo / F.greatest(hi, F.lit(1.0))}
    sides = F.col("left.attribute_facts"), F.col("right.attribute_facts")
    one = joined.withColumn("__each", S.compared_attributes(*sides))
    one = one.withColumns({"__m": S.measurement_block(F.col("left.measurements"), F.col("right.measurements"), tolerance), "__n": F.size("__each"), "__s": S.compared_sums(F.col("__each"))})
    plain = {**name_features(), **_set_features("identifier"), **_set_features("numeric"), **counts, **_field_features()}
    measured = {"measurement_common_types": "common", "measurement_compatible_types": "compatible", "measurement_conflict_types": "conflict", "measurement_min_relative_diff": "difference"}
    aligned = S.aligned_attributes(*sides, F.col("__n"), F.col("__s"))
    return one.select(*keys, S.pair_category(F.col("left.category"), F.col("right.category")).alias("category"), *(v.alias(k) for k, v in plain.items()),
                      *(F.col(f"__m.{v}").alias(k) for k, v in measured.items()), *(v.alias(k) for k, v in {**aligned, **(extra or {})}.items()))


def prepare_pairs(pairs: DataFrame, items: DataFrame, text_only: bool = False, profile: str | None = None) -> DataFrame:
    """Pairs with their texts and, unless ``text_only``, their features, with those of a corpus ``profile`` where one is named; pairs of unknown items are left out (see ``missing_ids``).

    The statistics of a profile cover all ``items``, not the pairs' only.
    """
    if text_only:
        joined = join_items(pairs, items.select("id", "category", *(v.alias(k) for k, v in item_lines().items())))
        a, b = serialize_pair()
        keys = [c for c in KEYS if c in joined.columns]
        return joined.select(*keys, S.pair_category(F.col("left.category"), F.col("right.category")).alias("category"), a.alias("text_a"), b.alias("text_b"))
    if profile:
        items = K.annotate(items, K.statistics(items, profile))
    joined = join_items(pairs, prepared_items(items.withColumns(item_lines())))
    a, b = serialize_pair()
    wide = joined.withColumns({"text_a": a, "text_b": b})
    made = features(wide, extra=(K.transductive_features(wide) if profile else {}) | ({"text_a": F.col("text_a"), "text_b": F.col("text_b")} if "row_id" in pairs.columns else {}))
    return made


def same_category_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``(id1, id2, category)``: the pairs whose items have one category, which is not empty. The second join is on id and category."""
    named = items.where(F.coalesce("category", F.lit("")) != "").select("id", F.col("category").cast("string").alias("category"))
    one = pairs.select("id1", "id2").join(named.withColumnRenamed("id", "id1"), "id1")
    return one.join(named.withColumnRenamed("id", "id2"), ["id2", "category"]).select("id1", "id2", "category")


def one_hot(df: DataFrame, categories: list[str], column: str = "category") -> DataFrame:
    return df.select("*", *(S.flag(F.col(column) == c).alias(f"category__{c}") for c in categories))
