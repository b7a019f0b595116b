"""Holdouts, quotas, stratified samples, hard negatives, folds and training batches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.graph import connected_components
from matchloom.operators.metrics import hash_key
from matchloom.operators.ordering import numbered, place_within
from matchloom.plans.durable import materialize


def balanced_quotas(capacities: Mapping, most: int) -> dict:
    """``most`` rows dealt evenly over strata: all take a common level, small ones all they have; what does not divide goes to the first keys."""
    open_ = sorted(((n, k) for k, n in capacities.items() if n > 0), key=lambda x: x[0])
    if most < 1 or not open_:
        raise ValueError("rows must be wanted and strata available")
    quota, left = {}, most
    for place, (n, _) in enumerate(open_):
        level, odd = divmod(left, len(open_) - place)
        if level < n:  # from here on all have more than the level
            rest = sorted(k for _, k in open_[place:])
            return quota | {k: level + (i < odd) for i, k in enumerate(rest)}
        quota[open_[place][1]] = int(n)
        left -= int(n)
    return quota


def level_quotas(counts: Mapping[float, int], most: int, floor: int = 20_000) -> dict[float, int]:
    """Rows of each target level: an equal floor, whole shares of the rest by what levels have left, and one more for the first levels until ``most``."""
    base = {k: min(n, floor, most // len(counts)) for k, n in counts.items()}
    spare = {k: n - base[k] for k, n in counts.items()}
    rest = min(most - sum(base.values()), sum(spare.values()))
    share = {k: rest * n // max(1, sum(spare.values())) for k, n in spare.items()}
    lucky = set([k for k in sorted(counts) if share[k] < spare[k]][: rest - sum(share.values())])
    return {k: base[k] + share[k] + (k in lucky) for k in counts}


def with_quotas(rows: DataFrame, quotas: Mapping, keys: list[str], out: str = "__quota") -> DataFrame:
    """``rows`` with the quota of their stratum from a small table; strata without one are left out."""
    named = [(*(k if isinstance(k, tuple) else (k,)), int(n)) for k, n in quotas.items()]
    kinds = ", ".join(f"`__k{i}` {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    table = rows.sparkSession.createDataFrame(named, f"{kinds}, `{out}` long")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return rows.join(table, same).select(*rows.columns, out)


def stratified(rows: DataFrame, strata: list[str], quota: Column, key: list[str], seed: int) -> DataFrame:
    """The ``quota`` rows of each stratum with the least hash of key and seed, ties by key.

    Hashes are uniform, so the rows wanted lie below a bound that the stratum's size gives; with ten standard
    deviations and fifty rows to spare, only rows below it reach the stratum's one task, whatever its size.
    """
    hashed = rows.withColumn("__h", hash_key(*(F.col(k) for k in key), F.lit(seed)))
    sizes = hashed.groupBy(*(F.col(s).alias(f"__s{i}") for i, s in enumerate(strata))).agg(F.count("*").alias("__n"))
    sizes = materialize(sizes, "strata")  # its measured size lets Catalyst decide on the join
    same = reduce(lambda a, b: a & b, (F.col(s).eqNullSafe(F.col(f"__s{i}")) for i, s in enumerate(strata)))
    share = (quota + 10 * F.sqrt(quota.cast("double")) + 50) / F.col("__n")
    low = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") <= share * 2.0**32
    near = hashed.join(sizes, same).where(low)
    order = Window.partitionBy(*strata).orderBy("__h", *key)
    return near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= quota).select(*rows.columns)


def with_row_id(rows: DataFrame, *order: str) -> DataFrame:
    """Sequential ids from 0 in an order."""
    return numbered(rows, [F.asc(c) for c in order], "row_id")


def unseen_pairs(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs of which neither id is among ``seen``."""
    one = seen.select(F.col("id").alias("id1")).distinct()
    two = seen.select(F.col("id").alias("id2")).distinct()
    return pairs.join(one, "id1", "left_anti").join(two, "id2", "left_anti")


def eligible_pairs(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct unseen pairs of categories that have both labels 0 and 1, as a table of its own: sizes, quotas and samples all read it."""
    rows = materialize(unseen_pairs(pairs, seen).where(F.col("category") != "").select("id1", "id2", "target", "category").distinct(), "unseen-pairs")
    complete = rows.groupBy("category").agg(F.collect_set("target").alias("t")).where(F.array_sort("t") == F.array(F.lit(0.0), F.lit(1.0))).select("category")
    return rows.join(complete, "category", "left_semi").select(*rows.columns)


def balanced_sample(eligible: DataFrame, most: int, seed: int) -> DataFrame:
    """A balanced sample over category and label, with sequential ids."""
    sizes = {(r["category"], r["target"]): r["count"] for r in eligible.groupBy("category", "target").count().collect()}  # two rows a category
    wanted = with_quotas(eligible, balanced_quotas(sizes, most), ["category", "target"])
    return with_row_id(stratified(wanted, ["category", "target"], F.col("__quota"), ["id1", "id2"], seed).drop("__quota"), "category", "target", "id1", "id2")


def novel_holdout(pairs: DataFrame, seen: DataFrame, most: int, seed: int) -> DataFrame:
    """A balanced sample over category and label of distinct unseen pairs, from categories that have both labels 0 and 1."""
    return balanced_sample(eligible_pairs(pairs, seen), most, seed)


def natural_rate_proxy(votes: DataFrame, seen: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows a category at its natural rate; positive where all nine votes are; categories with one label are dropped."""
    ninths = F.round(F.col("target") * 9).cast("int")
    return stratified(eligible_pairs(votes.withColumn("target", (ninths == 9).cast("double")), seen), ["category"], F.lit(cap), ["id1", "id2"], seed)


def label_slices(votes: DataFrame, seen: DataFrame) -> DataFrame:
    """Unseen pairs by slice: ``natural`` are all, ``hard`` those with 4 or 5 of 9 votes; counts, positives and rates by category. Not made distinct."""
    rows = unseen_pairs(votes, seen).withColumn("k", F.round(F.col("target") * 9).cast("int"))
    sliced = rows.withColumn("slice", F.explode(F.when(F.col("k").isin(4, 5), F.array(F.lit("natural"), F.lit("hard"))).otherwise(F.array(F.lit("natural")))))
    return sliced.groupBy("slice", "category").agg(F.count("*").alias("rows"), F.sum((F.col("k") >= 5).cast("int")).alias("positives"), F.avg((F.col("k") >= 5).cast("double")).alias("rate"))


def common_category_quotas(sources: DataFrame, cap: int, least: int) -> DataFrame:
    """``(category, take)`` for categories that both sources have with at least ``least`` rows."""
    sizes = sources.groupBy("category", "source").agg(F.count("*").alias("n"))
    return sizes.groupBy("category").agg(F.count("*").alias("sources"), F.least(F.min("n"), F.lit(cap)).alias("take")).where((F.col("sources") == 2) & (F.col("take") >= least)).select("category", "take")


def hard_negatives(rows: DataFrame, fraction: float, score: str = "score", train_fold: int | None = None) -> DataFrame:
    """The highest-scored negatives, one shared quota a category: a fraction of all negatives over the categories that have some."""
    negatives = rows.where(F.col("target") <= 0.5)
    if train_fold is not None:
        negatives = negatives.where(F.col("fold") != train_fold)
    n = negatives.agg(F.count("*").alias("n"), F.countDistinct("category").alias("c")).first()
    quota = max(1, int(n["n"] * fraction / max(1, n["c"])))
    order = Window.partitionBy("category").orderBy(F.desc(score), "row_id")
    return negatives.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= quota).drop("__r")


def component_folds(pairs: DataFrame, folds: int, seed: int, largest: int = 20_000) -> DataFrame:
    """Pairs with ``component`` and ``fold``: no item is in two folds, and (category, label) strata are balanced at any size.

    The ``largest`` components of more than one pair are dealt greedily, largest first, to the fold whose strata they unbalance least; counts by component
    and stratum of so many reach the driver. All others are dealt in turn within the stratum that most of their pairs have.
    """
    edges = pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    found = connected_components(edges)
    self_loops = pairs.where("id1 = id2").select(F.col("id1").alias("node"), F.col("id1").alias("component")).distinct().join(found.select("node"), "node", "left_anti")
    tagged = materialize(pairs.join(found.unionByName(self_loops).withColumnRenamed("node", "id1"), "id1"), "tagged-pairs")
    return tagged.join(deal_components(tagged, folds, seed, largest), "component")


def deal_components(tagged: DataFrame, folds: int, seed: int, largest: int = 20_000) -> DataFrame:
    """``(component, fold)`` for pairs tagged with their component, category and target."""
    stratum = F.concat_ws("__", "category", (F.col("target") > 0.5).cast("string")).alias("stratum")
    strata = materialize(tagged.groupBy("component", stratum).agg(F.count("*").alias("k")), "component-strata")
    sizes = strata.groupBy("component").agg(F.sum("k").alias("n"), F.max(F.struct("k", "stratum")).alias("main"))
    big = materialize(sizes.where("n > 1").orderBy(F.desc("n"), "component").limit(largest).select("component", "n"), "large-components")
    by: dict = {}
    for r in strata.join(big, "component").collect():
        by.setdefault((-r["n"], r["component"]), {})[r["stratum"]] = r["k"]
    load: list[dict] = [{} for _ in range(folds)]
    fold_of = {}
    for (_, component), counts in sorted(by.items()):
        cost = lambda f: (sum((load[f].get(s, 0) + k) ** 2 - load[f].get(s, 0) ** 2 for s, k in counts.items()), sum(load[f].values()), f)  # noqa: E731, B023
        best = min(range(folds), key=cost)
        fold_of[component] = best
        for s, k in counts.items():
            load[best][s] = load[best].get(s, 0) + k
    dealt = tagged.sparkSession.createDataFrame(list(fold_of.items()), "component long, fold int")
    rest = sizes.join(big, "component", "left_anti").select("component", "n", "main.stratum", F.xxhash64("component", F.lit(seed)).alias("h"))
    turns = place_within(rest, ["stratum"], [F.desc("n"), F.asc("h"), F.asc("component")], "turn")
    in_turn = turns.select("component", F.pmod(F.col("turn") + F.xxhash64("stratum"), F.lit(folds)).cast("int").alias("fold"))
    return dealt.unionByName(in_turn)


def fold_leaks(pairs: DataFrame) -> DataFrame:
    """``(id, folds)``: items that are in more than one fold."""
    ends = pairs.select(F.col("id1").alias("id"), "fold").union(pairs.select(F.col("id2"), "fold"))
    return ends.groupBy("id").agg(F.countDistinct("fold").alias("folds")).where("folds > 1")


def degree_stats(pairs: DataFrame) -> DataFrame:
    """Pairs with both degrees and whether the edge stands alone."""
    degree = pairs.select(F.col("id1").alias("id")).union(pairs.select(F.col("id2"))).groupBy("id").agg(F.count("*").alias("degree"))
    one, two = degree.select(F.col("id").alias("id1"), F.col("degree").alias("degree1")), degree.select(F.col("id").alias("id2"), F.col("degree").alias("degree2"))
    return pairs.join(one, "id1").join(two, "id2").withColumn("isolated", (F.col("degree1") == 1) & (F.col("degree2") == 1))


def silver_sample(pairs: DataFrame, most: int, seed: int) -> DataFrame:
    """A sample by target level, with sequential ids in hash order."""
    counts = {r["target"]: r["count"] for r in pairs.groupBy("target").count().collect()}  # ten levels
    wanted = with_quotas(pairs, level_quotas(counts, most), ["target"])
    chosen = stratified(wanted, ["target"], F.col("__quota"), ["id1", "id2"], seed).drop("__quota").withColumn("__h", hash_key(F.col("id1"), F.col("id2"), F.lit(f"{seed}-order")))
    return with_row_id(chosen, "__h", "id1", "id2").drop("__h")


def repeated(rows: DataFrame, mined: DataFrame, times: int = 2) -> DataFrame:
    """``rows`` with those whose ``row_id`` is mined appended ``times`` times more."""
    extra = rows.join(mined.select("row_id").distinct(), "row_id", "left_semi")
    return rows.unionByName(extra.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__t")).drop("__t"))


def micro_batches(rows: DataFrame, prevalence: float, batches: int, seed: int, group: int = 16) -> DataFrame:
    """``batch, slot, row_id``: category-balanced groups of ``group`` rows whose positives follow a cumulative floor schedule; categories need both labels, and rows recur."""
    pools = rows.groupBy("category").agg(F.sum((F.col("target") > 0.5).cast("int")).alias("p"), F.sum((F.col("target") <= 0.5).cast("int")).alias("m")).where("p > 0 and m > 0")
    ranked = pools.withColumn("c", F.row_number().over(Window.orderBy(hash_key(F.col("category"), F.lit(seed)), "category")) - 1)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    schedule = ranked.withColumn("cats", n).select("*", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")).where(F.pmod("batch", "cats") == F.col("c"))
    upto = lambda b: F.floor(b * F.lit(group * prevalence))
    schedule = schedule.withColumn("want", (upto(F.col("batch") + 1) - upto(F.col("batch"))).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(group - 1))).alias("slot"))
    positive = F.col("slot") < F.col("want")
    turn = F.floor(F.col("batch") / F.col("cats"))
    i = F.when(positive, turn * group + F.col("slot")).otherwise(turn * group + F.col("slot") - F.col("want"))
    asked = schedule.select("batch", "slot", "category", positive.alias("pos"), F.pmod(i, F.when(positive, F.col("p")).otherwise(F.col("m"))).alias("place"))
    pos = F.col("target") > 0.5
    placed = place_within(rows.select("category", pos.alias("pos"), "row_id", hash_key(F.col("row_id"), F.lit(seed)).alias("h")), ["category", "pos"], [F.asc("h"), F.asc("row_id")], "place").drop("h")
    return asked.join(placed, ["category", "pos", "place"]).select("batch", "slot", "category", "row_id", "pos")


def category_uniform_batches(rows: DataFrame, batch_size: int, seed: int, per_batch: int = 1) -> DataFrame:
    """``batch, slot, category, row_id``: as many batches as hold the rows once, each of ``per_batch`` categories in turn with equal parts, whatever the categories' sizes.

    Categories follow one another in hash order. A category's rows are taken in hash order, turn after turn, and anew from the first where they end, so small categories recur.
    """
    if per_batch < 1 or batch_size % per_batch:
        raise ValueError("a batch divides evenly among its categories")
    sizes = rows.groupBy("category").agg(F.count("*").alias("n"))
    ranked = materialize(sizes.withColumn("c", F.row_number().over(Window.orderBy(hash_key(F.col("category"), F.lit(seed)), "category")) - 1), "batch-categories")  # a row a category
    whole, cats = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if per_batch > cats:
        raise ValueError("more categories a batch than there are")
    part = batch_size // per_batch
    asked = rows.sparkSession.range(-(-whole // batch_size) * per_batch).select(F.col("id").alias("ask")).withColumn("c", F.pmod("ask", F.lit(cats)))
    asked = asked.join(ranked, "c").select("category", "ask", F.explode(F.sequence(F.lit(0), F.lit(part - 1))).alias("k"), "n")
    asked = asked.withColumn("place", F.pmod(F.floor(F.col("ask") / cats) * part + F.col("k"), F.col("n")))
    placed = place_within(rows.select("category", "row_id", hash_key(F.col("row_id"), F.lit(seed)).alias("h")), ["category"], [F.asc("h"), F.asc("row_id")], "place").drop("h")
    batch, slot = F.floor(F.col("ask") / per_batch).alias("batch"), (F.pmod("ask", F.lit(per_batch)) * part + F.col("k")).alias("slot")
    return asked.join(placed, ["category", "place"]).select(batch, slot, "category", "row_id")


def replayed(batches: DataFrame, groups: int) -> DataFrame:
    """Fixed micro-batches ``(batch, slot, row_id)`` again, each ``groups`` consecutive ones as one batch; raises unless they are equally large and divide evenly."""
    if groups < 1:
        raise ValueError("groups must be positive")
    sizes = batches.groupBy("batch").agg(F.count("*").alias("n")).agg(F.count("*").alias("batches"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("batch").alias("last")).first()
    if not sizes["batches"] or sizes["least"] != sizes["most"] or sizes["batches"] % groups or sizes["last"] != sizes["batches"] - 1:
        raise ValueError("micro-batches are numbered from 0, equally large, and divide evenly into groups")
    size = sizes["most"]
    return batches.select(F.floor(F.col("batch") / groups).alias("batch"), (F.pmod("batch", F.lit(groups)) * size + F.col("slot")).alias("slot"), *(c for c in batches.columns if c not in ("batch", "slot")))
