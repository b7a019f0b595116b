"""Text normalisation as column functions.

Spark has no Unicode compatibility folding, so ``fold`` and ``fold_all`` are the only Python here, one
Arrow batch at a time; every other function stays in the JVM and expects folded text where noted.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Letters and look-alikes of the normal forms.
CYRILLIC_SINGLE = "абвгдезийклмнопрстуфыэ"
LATIN_SINGLE = "abvgdeziiklmnoprstufye"
CYRILLIC_MULTIPLE = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
CYRILLIC_SILENT = "ъь"
CONFUSABLE = "авсенкмортху"
LOOKS_LIKE = "abcehkmoptxy"

# Measurement units, their kind and the factor to the kind's base unit.
UNITS = {
    "мг": ("mass_g", 0.001), "mg": ("mass_g", 0.001), "г": ("mass_g", 1.0), "гр": ("mass_g", 1.0), "g": ("mass_g", 1.0), "кг": ("mass_g", 1000.0), "kg": ("mass_g", 1000.0),
    "мл": ("volume_ml", 1.0), "ml": ("volume_ml", 1.0), "л": ("volume_ml", 1000.0), "l": ("volume_ml", 1000.0),
    "мм": ("length_mm", 1.0), "mm": ("length_mm", 1.0), "см": ("length_mm", 10.0), "cm": ("length_mm", 10.0), "м": ("length_mm", 1000.0), "m": ("length_mm", 1000.0),
    "кб": ("storage_mb", 1 / 1024), "kb": ("storage_mb", 1 / 1024), "мб": ("storage_mb", 1.0), "mb": ("storage_mb", 1.0), "гб": ("storage_mb", 1024.0), "gb": ("storage_mb", 1024.0),
    "тб": ("storage_mb", 1024.0**2), "tb": ("storage_mb", 1024.0**2), "шт": ("count", 1.0), "pc": ("count", 1.0), "pcs": ("count", 1.0), "уп": ("pack_count", 1.0), "pack": ("pack_count", 1.0),
    "пар": ("pair_count", 1.0), "пара": ("pair_count", 1.0), "пары": ("pair_count", 1.0), "компл": ("set_count", 1.0), "комплект": ("set_count", 1.0), "комплекта": ("set_count", 1.0),
}

# Colour words and stems.
COLOR_WORDS = {
    "black": ("black", "черный"), "white": ("white", "белый"), "red": ("red", "красный"), "blue": ("blue", "синий", "голубой"),
    "green": ("green", "зеленый"), "gray": ("gray", "grey", "серый"), "silver": ("silver", "серебристый"), "gold": ("gold", "золотой"),
    "beige": ("beige", "бежевый"), "brown": ("brown", "коричневый"), "pink": ("pink", "розовый"), "purple": ("purple", "фиолетовый"),
    "orange": ("orange", "оранжевый"), "yellow": ("yellow", "желтый"), "transparent": ("transparent", "прозрачный"),
    "multicolor": ("multicolor", "разноцветный"),
}
COLOR_STEMS = {
    "black": ("черн",), "white": ("бел",), "red": ("красн",), "blue": ("син", "голуб"), "green": ("зелен",), "gray": ("сер",), "silver": ("серебр",),
    "gold": ("золот",), "beige": ("беж",), "brown": ("коричн",), "pink": ("розов",), "purple": ("фиолет",), "orange": ("оранж",), "yellow": ("желт",),
    "transparent": ("прозрачн",), "multicolor": ("разноцвет",),
}

# What a token and an identifier are.
TOKEN = "[0-9a-zа-я]+"
IDENTIFIER = r"(?iu)(?=[0-9a-zа-я-]*\d)[0-9a-zа-я]+(?:[-_/][0-9a-zа-я]+)*"


def _folded(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text).casefold()


def _fold_one(texts):  # noqa: ANN001, ANN202
    return texts.map(_folded, na_action="ignore")


def _fold_each(arrays):  # noqa: ANN001, ANN202
    return arrays.map(lambda xs: None if xs is None else [_folded(x) for x in xs], na_action="ignore")


def fold(text: Column | str) -> Column:
    """NFKC and case folding; null stays null."""
    return F.pandas_udf(_fold_one, "string").asNondeterministic()(text)  # else filters are pushed below it, and it runs twice


def fold_all(texts: Column | str) -> Column:
    """``fold`` of every element, in one pass."""
    return F.pandas_udf(_fold_each, "array<string>").asNondeterministic()(texts)


def plain(folded: Column) -> Column:
    """Folded text with every run of other characters than letters and numbers as one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(folded, F.lit("")), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def normalize_text(text: Column | str) -> Column:
    return plain(fold(text))


def as_text(value: Column, kind: DataType) -> Column:
    """A value of any type as the text to normalise: maps, structs and arrays as JSON with sorted keys, null as null."""
    if isinstance(kind, MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.to_json(F.struct(*(value[n].alias(n) for n in sorted(kind.names)))))
    return F.to_json(value) if isinstance(kind, ArrayType) else value.cast("string")


def transliterate(normal: Column) -> Column:
    """Latin spelling of normalised Cyrillic text."""
    out = F.translate(normal, CYRILLIC_SINGLE + CYRILLIC_SILENT, LATIN_SINGLE)
    for letter, latin in CYRILLIC_MULTIPLE.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def identifier_form(folded: Column) -> Column:
    """Folded text reduced to letters and numbers, with Cyrillic look-alikes as Latin."""
    latin = F.translate(F.translate(F.coalesce(folded, F.lit("")), "ё", "е"), CONFUSABLE, LOOKS_LIKE)
    return F.regexp_replace(latin, r"[^\p{L}\p{N}]", "")


def tokens(normal: Column) -> Column:
    """Distinct tokens of normalised text."""
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(f"({TOKEN})"), F.lit(1)))


def numeric_tokens(normal: Column) -> Column:
    return F.array_sort(F.filter(tokens(normal), lambda t: t.rlike("[0-9]")))


def identifier_tokens(raw: Column) -> Column:
    """Sorted identifier-like tokens of raw text: runs with a digit, in identifier form."""
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(f"({IDENTIFIER})"), F.lit(1))
    forms = F.transform(found, lambda t: identifier_form(F.lower(t)))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda t: (F.length(t) >= 2) & t.rlike(r"\p{Nd}"))))


def clean_float(x: Column) -> Column:
    """An integer within 1e-9 as such, else six decimals, halves to even."""
    return F.when(F.abs(x - F.rint(x)) <= 1e-9, F.rint(x)).otherwise(F.bround(x, 6))


def measurements(folded_texts: Column) -> Column:
    """``MAP kind -> sorted distinct values`` of all measurements in an array of folded texts."""
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    pattern = rf"(?U)(?<![\w])(\d+(?:[.,]\d+)?)\s*({units})\b"
    kind_of = F.create_map(*(F.lit(x) for u, (k, _) in UNITS.items() for x in (u, k)))
    factor_of = F.create_map(*(F.lit(x) for u, (_, f) in UNITS.items() for x in (u, f)))

    def found(text: Column) -> Column:
        text = F.translate(F.coalesce(text, F.lit("")), "ё", "е")
        numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        kinds = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.zip_with(numbers, kinds, lambda n, u: F.struct(
            F.element_at(kind_of, u).alias("kind"), clean_float(F.translate(n, ",", ".").cast("double") * F.element_at(factor_of, u)).alias("x")))

    every = F.flatten(F.transform(folded_texts, found))
    of_kind = lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda m: m["kind"] == k), lambda m: m["x"])))
    kinds = F.array_sort(F.array_distinct(F.transform(every, lambda m: m["kind"])))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, of_kind(k))))


def size_form(normal: Column, normal_key: Column) -> Column:
    """Size tokens under the size system that the attribute's key names."""
    has = lambda stem: normal_key.contains(stem)
    word = lambda w: normal_key.rlike(rf"(?U)\b{w}\b")
    system = (F.when(has("российск") | word("ru"), "ru").when(has("европ") | word("eu"), "eu")
              .when(has("америк") | word("us"), "us").when(has("международ"), "intl").otherwise("unknown"))
    return F.when(normal == "", "").otherwise(F.concat(system, F.lit(":"), F.array_join(F.array_sort(tokens(normal)), "|")))


def color_form(normal: Column) -> Column:
    """Palette names of all colour words and stems, joined; without any, the text itself."""
    words = tokens(normal)
    hits = [F.when(F.exists(words, _is_color(name)), F.lit(name)) for name in sorted(COLOR_WORDS)]
    joined = F.concat_ws("|", *hits)
    return F.when(joined == "", normal).otherwise(joined)


def _is_color(name: str):  # noqa: ANN202
    return lambda token: token.isin(*COLOR_WORDS[name]) | _starts(token, COLOR_STEMS[name])


def _starts(token: Column, stems: tuple[str, ...]) -> Column:
    said = token.startswith(stems[0])
    for stem in stems[1:]:
        said = said | token.startswith(stem)
    return said


def shortened(text: Column, limit: int) -> Column:
    """Trimmed text; longer than the limit, cut and marked with an ellipsis."""
    text = F.trim(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of white-space-collapsed text; a shorter text is its only one."""
    compact = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(compact) - (n - 1), F.lit(1))), lambda i: F.substring(compact, i, F.lit(n)))
    return F.when(compact == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def packed_ngrams(text: Column, n: int = 3) -> Column:
    """``char_ngrams`` of at most three characters as one number each, of 21 bits a code point, so that sets of them compare faster; longer ones as they are."""
    grams = char_ngrams(text, n)
    if n > 3:
        return grams
    point = lambda g, i: F.shiftleft(F.ascii(F.substring(g, i, 1)).cast("long"), 21 * (i - 1))
    return F.transform(grams, lambda g: sum((point(g, i) for i in range(2, n + 1)), point(g, 1)))


def attribute_map(remaining: Column) -> Column:
    """``key=value; key=value`` as a map; the last of equal keys wins (``mapKeyDedupPolicy`` LAST_WIN)."""
    parts = F.filter(F.split(F.coalesce(remaining, F.lit("")), "; "), lambda p: p.rlike("(?s)^[^=]+=.+$"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, "(?s)^[^=]+=", ""))))


def prefix_share(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length; 0 for two empty texts."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(some, same / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))
