"""Raw catalogue items to canonical typed items: one projection around one Arrow folding pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.schemas import FIELDS, SERIAL_FIELDS

# Which attribute keys name a field, by priority. The first rule that holds decides; a rule
# is (score, how the key compares, phrases, phrases that exclude it).
KEY_RULES: dict[str, list[tuple[int, str, tuple[str, ...], tuple[str, ...]]]] = {
    "type": [(100, "is", ("тип",), ())],
    "brand": [(100, "is", ("бренд",), ()), (95, "is", ("бренд в одежде и обуви",), ()), (80, "is", ("марка",), ()), (45, "is", ("производитель", "изготовитель"), ()), (60, "has", ("бренд",), ())],
    "model": [(100, "is", ("модель",), ()), (95, "is", ("название модели", "модель товара"), ()), (60, "has", ("модель",), ("совместим", "устройств", "автомоб"))],
    "article": [(100, "is", ("артикул",), ()), (95, "has", ("партномер", "part number", "oem"), ()), (70, "has", ("артикул",), ())],
    "color": [(100, "is", ("цвет товара",), ()), (95, "is", ("название цвета",), ()), (90, "is", ("цвет",), ()), (50, "has", ("цвет",), ("температур", "свечен", "подсвет"))],
    "size": [(0, "has", ("упаков", "габарит", "размеры мм", "размер файла"), ()), (100, "is", ("российский размер",), ()), (95, "is", ("размер производителя", "размер обуви", "размер одежды"), ()),
             (90, "is", ("размер",), ()), (50, "has", ("размер",), ())],
    "quantity": [(100, "is", ("единиц в одном товаре", "количество в упаковке шт", "количество предметов в комплекте", "количество штук", "количество шт", "число штук", "количество упаковок"), ()),
                 (50, "has", ("количество",), ("измерен", "режим", "скорост"))],
}


def _any(key: Column, how: str, phrases: tuple[str, ...]) -> Column:
    if how == "is":
        return key.isin(*phrases)
    return reduce(lambda a, b: a | b, (key.contains(p) for p in phrases))


def key_score(field: str, key: Column) -> Column:
    """The priority of a normalised attribute key for a field; 0 if it does not name it."""
    out = F.lit(0)
    for score, how, phrases, barred in reversed(KEY_RULES[field]):
        holds = _any(key, how, phrases)
        if barred:
            holds = holds & ~_any(key, "has", barred)
        out = F.when(holds, score).otherwise(out)
    return out


def parsed_attributes(json: Column) -> tuple[Column, Column]:
    """``(entries, parse_error)``: an array of ``(key, value)`` in document order, and 1 if the text is no JSON object."""
    given = F.coalesce(json, F.lit("")) != ""
    found = F.from_json(F.when(given, json).otherwise("{}"), "map<string,string>")
    return F.coalesce(F.map_entries(found), F.array().cast("array<struct<key:string,value:string>>")), found.isNull().cast("int")


def unique_entries(entries: Column) -> Column:
    """A repeated key keeps its first place and its last value."""
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x["key"] == e["key"]))
    return F.transform(first, lambda e: F.struct(e["key"].alias("key"), F.element_at(F.filter(entries, lambda x: x["key"] == e["key"]), -1)["value"].alias("value")))


def select_field(field: str, entries: Column) -> Column:
    """The entry ``(key, value, nkey, nvalue, fvalue)`` with the best key; the first in document order wins ties. Null without one."""
    scored = F.transform(entries, lambda e, i: F.struct(key_score(field, e["nkey"]).alias("score"), (-i).alias("order"), e.alias("e")))
    given = F.filter(scored, lambda s: (s["score"] > 0) & (F.trim(F.coalesce(s["e"]["value"], F.lit(""))) != ""))
    return F.array_max(F.transform(given, lambda s: F.struct(s["score"], s["order"], s["e"])))["e"]


def compact_remaining(entries: Column, selected_keys: Column, limit: int) -> Column:
    """``key=value`` parts by normalised key, unselected, until the next one would pass the limit; then no more."""
    open_ = F.filter(entries, lambda e: (e["nkey"] != "") & (e["nvalue"] != "") & ~F.array_contains(selected_keys, e["nkey"]))
    keyed = F.array_sort(F.transform(open_, lambda e, i: F.struct(e["nkey"].alias("k"), i.alias("i"), F.concat(e["nkey"], F.lit("="), e["nvalue"]).alias("p"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("length"), F.lit(False).alias("full"))

    def add(acc: Column, e: Column) -> Column:
        grown = acc["length"] + F.length(e["p"]) + 2
        full = acc["full"] | (grown > limit)
        return F.struct(F.when(full, acc["parts"]).otherwise(F.array_append(acc["parts"], e["p"])).alias("parts"), F.when(full, acc["length"]).otherwise(grown).alias("length"), full.alias("full"))

    return F.aggregate(keyed, start, add, lambda acc: F.array_join(acc["parts"], "; "))


def canonicalize(items: DataFrame, remaining_chars: int = 1800) -> DataFrame:
    """The canonical columns of raw items ``(id, name, attributes, category)``; token lists and measurements are native arrays and maps.

    Null names, categories and attributes are empty. Malformed attributes give none and ``parse_error`` 1.
    """
    entries, error = parsed_attributes(F.col("attributes"))
    df = items.select(
        F.col("id").cast("long").alias("id"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("name", F.lit("")).alias("name_raw"), error.alias("parse_error"), entries.alias("__e"))
    df = df.withColumn("__e", unique_entries(F.col("__e")))
    parts = F.flatten(F.array(F.array(F.col("name_raw")), F.transform("__e", lambda e: e["key"]), F.transform("__e", lambda e: e["value"])))
    df = df.withColumn("__f", T.fold_all(parts))
    n = F.size("__e")
    df = df.withColumn("name_norm", T.plain(F.get("__f", F.lit(0)))).withColumn("__e", F.transform("__e", lambda e, i: F.struct(
        e["key"].alias("key"), e["value"].alias("value"), T.plain(F.get("__f", i + 1)).alias("nkey"), T.plain(F.get("__f", i + 1 + n)).alias("nvalue"), F.get("__f", i + 1 + n).alias("fvalue"))))
    df = df.select("*", *(select_field(f, F.col("__e")).alias(f"__{f}") for f in FIELDS))
    raw = {f: F.coalesce(F.col(f"__{f}.value"), F.lit("")) for f in FIELDS}
    normal = {f: F.coalesce(F.col(f"__{f}.nvalue"), F.lit("")) for f in FIELDS}
    normal["article"] = T.identifier_form(F.col("__article.fvalue"))
    normal["size"] = F.coalesce(T.size_form(F.col("__size.nvalue"), F.col("__size.nkey")), F.lit(""))
    normal["color"] = F.coalesce(T.color_form(F.col("__color.nvalue")), F.lit(""))
    chosen = [F.col(f"__{f}.value") for f in FIELDS]
    searchable = F.concat_ws(" ", F.col("name_raw"), *chosen)
    searchable_norm = F.concat_ws(" ", F.col("name_norm"), *(F.col(f"__{f}.nvalue") for f in FIELDS))
    texts = F.concat(F.array(F.get("__f", F.lit(0))), F.transform("__e", lambda e: e["fvalue"]))  # the selected values are among all values
    keys = F.array_compact(F.array(*(F.col(f"__{f}.nkey") for f in FIELDS)))
    return df.select(
        "id", "category", "name_raw", "name_norm", T.transliterate(F.col("name_norm")).alias("name_translit"), n.alias("attribute_count"), "parse_error",
        *(c for f in FIELDS for c in (raw[f].alias(f"{f}_raw"), normal[f].alias(f"{f}_norm"))),
        T.transliterate(F.coalesce(F.col("__brand.nvalue"), F.lit(""))).alias("brand_translit"), T.numeric_tokens(searchable_norm).alias("numeric_tokens"),
        T.identifier_tokens(searchable).alias("identifier_tokens"), T.measurements(texts).alias("measurements"), compact_remaining(F.col("__e"), keys, remaining_chars).alias("remaining_attributes"),
    )


def _lines(prefix: str, item: str) -> list[Column]:
    get = lambda name: F.coalesce(F.col(f"{item}{name}"), F.lit(""))
    either = lambda a, b: F.when(get(a) != "", get(a)).otherwise(get(b))
    line = lambda name, value, limit: F.concat(F.lit(f"{name}_{prefix}: "), T.shortened(value, limit))
    out = [line("category", get("category"), 100), line("name", either("name_norm", "name_raw"), 600)]
    for f in SERIAL_FIELDS:
        value = either(f"{f}_norm", f"{f}_raw")
        out.append(F.when(value != "", line(f, value, 220)))
    return [*out, F.when(get("remaining_attributes") != "", line("attributes", get("remaining_attributes"), 1800))]


def serialize_item(item: str = "") -> Column:
    """A canonical item as labelled lines; ``item`` is a column prefix such as ``a.``."""
    return F.concat_ws("\n", *_lines("item", item))


def item_lines() -> dict[str, Column]:
    """An item's lines as either side of a pair: made once an item, so that a pair only joins them."""
    return {"lines_a": F.concat_ws("\n", *_lines("a", "")), "lines_b": F.concat_ws("\n", *_lines("b", ""))}


def serialize_pair(left: str = "left.", right: str = "right.") -> tuple[Column, Column]:
    """Both texts of a pair of items with ``item_lines``, whose sides are in ascending order of id; the header is on the first only."""
    category = F.when(F.coalesce(F.col(f"{left}category"), F.lit("")) != "", F.col(f"{left}category")).otherwise(F.coalesce(F.col(f"{right}category"), F.lit("")))
    header = F.concat(F.lit("category: "), T.shortened(category, 100))
    return F.concat_ws("\n", header, F.col(f"{left}lines_a")), F.col(f"{right}lines_b")
