"""Set, map and numeric similarity as column expressions. Ratios of nothing are 0, never null or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1.0 where true, 0.0 where false or null."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def set_jaccard(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays in which nothing repeats: one intersection, and no union."""
    both = F.size(F.array_intersect(a, b))
    return ratio(both, F.size(a) + F.size(b) - both)


def containment(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def some(x: Column) -> Column:
    return F.size(x) > 0


def set_exact(a: Column, b: Column) -> Column:
    """Of arrays in which nothing repeats."""
    both = F.size(F.array_intersect(a, b))
    return flag(some(a) & (both == F.size(a)) & (both == F.size(b)))


def set_conflict(a: Column, b: Column) -> Column:
    """Of arrays in which nothing repeats."""
    both = F.size(F.array_intersect(a, b))
    return flag(some(a) & some(b) & ((both < F.size(a)) | (both < F.size(b))))


def field_relation(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Both given, both given and equal, both given and different."""
    both = (a != "") & (b != "")
    return flag(both), flag(both & (a == b)), flag(both & (a != b))


def pair_category(a: Column, b: Column) -> Column:
    """The distinct non-empty categories of both sides in order, joined by `` | ``."""
    both = F.filter(F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), lambda c: c != "")
    return F.array_join(F.array_sort(F.array_distinct(both)), " | ")


def measurement_block(a: Column, b: Column, tolerance: float = 0.015) -> Column:
    """``(common, compatible, conflict, least difference)`` of two maps of measurements."""

    def difference(kind: Column) -> Column:
        one = lambda x, y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-12))
        return F.array_min(F.flatten(F.transform(F.element_at(a, kind), lambda x: F.transform(F.element_at(b, kind), lambda y: one(x, y)))))

    best = F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), difference)
    fits = F.size(F.filter(best, lambda d: d <= tolerance))
    return F.struct(
        F.size(best).cast("double").alias("common"), fits.cast("double").alias("compatible"), (F.size(best) - fits).cast("double").alias("conflict"),
        F.coalesce(F.array_min(best), F.lit(0.0)).alias("difference"),
    )


def attribute_facts(attributes: Column, tokens, identifiers, numbers) -> Column:  # noqa: ANN001
    """Per item, before any join: each attribute's value with its token sets, by key."""
    return F.transform_values(attributes, lambda _, v: F.struct(
        v.alias("v"), tokens(v).alias("t"), identifiers(v).alias("i"), numbers(v).alias("n")))


def compared_attributes(a: Column, b: Column) -> Column:
    """For every shared key of two ``attribute_facts`` maps, how its values compare. Project it on its own, so that it is computed once.

    Such functions are interpreted, and what they name twice is computed twice: so the values of a key are looked up first, then common tokens are counted, and only then all is compared.
    """

    def counted(e: Column) -> Column:
        x, y = e["x"], e["y"]
        alike = x["v"] == y["v"]
        both = lambda f: some(x[f]) & some(y[f])
        return F.struct(
            alike.alias("alike"), F.when(alike, F.size(x["t"])).otherwise(F.size(F.array_intersect(x["t"], y["t"]))).alias("m"), (F.size(x["t"]) + F.size(y["t"])).alias("s"),
            both("i").alias("ic"), F.when(both("i"), alike | F.arrays_overlap(x["i"], y["i"])).otherwise(False).alias("io"), both("n").alias("nc"), F.when(both("n"), alike | F.arrays_overlap(x["n"], y["n"])).otherwise(False).alias("no"),
        )

    def compare(e: Column) -> Column:
        return F.struct(e["alike"].cast("int").alias("exact"), ratio(e["m"], e["s"] - e["m"]).alias("j"), *(e[c].cast("int").alias(c) for c in ("ic", "io", "nc", "no")))

    found = F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda key: F.struct(F.element_at(a, key).alias("x"), F.element_at(b, key).alias("y")))
    return F.transform(F.transform(found, counted), compare)


def compared_sums(each: Column) -> Column:
    """The totals of ``compared_attributes`` in one pass over its elements."""
    counts = ("exact", "ic", "io", "nc", "no")
    zero = F.struct(*(F.lit(0).alias(c) for c in counts), F.lit(0.0).alias("j"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    add = lambda s, e: F.struct(*((s[c] + e[c]).alias(c) for c in counts), (s["j"] + e["j"]).alias("j"), F.least(s["lo"], e["j"]).alias("lo"), F.greatest(s["hi"], e["j"]).alias("hi"))
    return F.aggregate(each, zero, add)


def aligned_attributes(a: Column, b: Column, n: Column, sums: Column) -> dict[str, Column]:
    """The 17 aligned-attribute features from both maps, their number of shared keys and ``compared_sums``."""
    exact, ic, io, nc, no = (sums[c] for c in ("exact", "ic", "io", "nc", "no"))
    values = {
        "key_count_min": F.least(F.size(a), F.size(b)), "key_count_max": F.greatest(F.size(a), F.size(b)), "key_common": n,
        "key_jaccard": ratio(n, F.size(a) + F.size(b) - n), "value_exact": exact, "value_exact_rate": ratio(exact, n),
        "value_conflict": n - exact, "value_conflict_rate": ratio(n - exact, n), "token_jaccard_mean": ratio(sums["j"], n),
        "token_jaccard_min": F.coalesce(sums["lo"], F.lit(0.0)), "token_jaccard_max": F.coalesce(sums["hi"], F.lit(0.0)),
        "identifier_common": ic, "identifier_overlap": io, "identifier_conflict": ic - io, "numeric_common": nc, "numeric_overlap": no, "numeric_conflict": nc - no,
    }
    return {f"aligned_attribute_{k}": v.cast("double") for k, v in values.items()}


def normalized_idf(n: Column, df: Column) -> Column:
    """``ln(N / df) / ln N``; 0 for unseen items or at most one record."""
    return F.when((n > 1) & (df > 0), F.log(n / df) / F.log(n)).otherwise(F.lit(0.0))


def normalized_df(n: Column, df: Column) -> Column:
    return F.coalesce(F.try_divide(F.log1p(df.cast("double")), F.log1p(n.cast("double"))), F.lit(0.0))


def shared_idf(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Greatest and mean IDF of the shared keys, greatest of the unshared, of two maps key to IDF."""
    joint = F.map_values(F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.least(x, y) + x * 0 + y * 0), lambda _, v: v.isNotNull()))
    apart = F.map_values(F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull() | y.isNull(), F.coalesce(x, y))), lambda _, v: v.isNotNull()))
    total = F.aggregate(joint, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.array_max(joint), F.lit(0.0)), ratio(total, F.size(joint)), F.coalesce(F.array_max(apart), F.lit(0.0))


def key_idf_block(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sum and greatest IDF of shared attribute keys, and the IDF-weighted Jaccard."""
    zero = F.lit(0.0)
    both = F.map_values(F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y))), lambda _, v: v.isNotNull()))
    every = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero))))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return add(both), F.coalesce(F.array_max(both), zero), ratio(add(both), add(every))
