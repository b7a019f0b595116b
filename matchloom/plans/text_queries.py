"""Queries of scans, text functions and canonical items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.operators import canonical as C
from matchloom.operators import corpus as K
from matchloom.operators import pairs as P
from matchloom.plans.catalogue import co_ordered, order_parts, raw_items, table
from matchloom.plans.durable import materialize
from matchloom.plans.registry import query

_FOLDED = "replace(lower(text), 'ß', 'ss')"
_PLAIN = rf"trim(regexp_replace({_FOLDED}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_TOKENS = f"list_sort(list_distinct(regexp_extract_all({_PLAIN}, '[0-9a-zа-я]+')))"


@query("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 6) AS revenue FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1996-01-01'")
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_shipdate >= timestamp '1996-01-01'")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("revenue"))


@query("id_semi_join", "SELECT p_partkey AS id, p_name AS name, p_type AS category FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def id_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("id")).distinct()
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return P.only_ids(items, ids)


@query("missing_id_anti_join", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def missing_id_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    pairs = keys.select(F.col("l_partkey").alias("id1"), F.col("l_partkey").alias("id2"))
    return P.missing_ids(pairs, table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id")))


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("category_onehot", "SELECT p_partkey AS id, " + ", ".join(f"(p_type = '{t}')::INT::DOUBLE AS \"category__{t}\"" for t in _TYPES) + " FROM part")
def category_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"))
    return P.one_hot(p, list(_TYPES)).drop("category")


@query("text_normalize", f"SELECT doc_id, length({_PLAIN}) AS n_chars_norm, md5({_PLAIN}) AS norm_md5 FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("norm"))
    return d.select("doc_id", F.length("norm").cast("long").alias("n_chars_norm"), F.md5("norm").alias("norm_md5"))


@query("structured_text", "SELECT p_partkey AS id, trim(regexp_replace(lower('a ' || p_size || ' b ' || p_brand || ' z ' || p_type), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS of_struct, p_size || ' ' || (p_size + 1) AS of_array FROM part")
def structured_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of nested values: keys in order, whatever the order they are given in."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_type").alias("z"), F.col("p_size").alias("a"), F.col("p_brand").alias("b")).alias("s"), F.array("p_size", F.col("p_size") + 1).alias("xs"))
    return p.select("id", *(T.normalize_text(T.as_text(F.col(c), p.schema[c].dataType)).alias(name) for c, name in (("s", "of_struct"), ("xs", "of_array"))))


@query("text_tokens", f"SELECT doc_id, len({_TOKENS}) AS n_tokens, md5(array_to_string({_TOKENS}, ' ')) AS tokens_md5 FROM documents")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("norm")).select("doc_id", F.array_sort(T.tokens(F.col("norm"))).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("numeric_tokens", f"SELECT doc_id, array_to_string(list_filter({_TOKENS}, lambda t: regexp_matches(t, '[0-9]')), ' ') AS numbers FROM documents")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("norm"))
    return d.select("doc_id", F.array_join(T.numeric_tokens(F.col("norm")), " ").alias("numbers"))


_COMPACT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("char_ngrams", f"""SELECT item_id, len(g) AS n_grams, md5(array_to_string(list_sort(g), '|')) AS grams_md5 FROM (
  SELECT item_id, CASE WHEN c = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(length(c) - 2, 1) + 1), lambda i: substr(c, i, 3))) END AS g
  FROM (SELECT item_id, {_COMPACT} AS c FROM benchmark))""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("g"))
    return b.select("item_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("grams_md5"))


_CYRILLIC = "translate(lower(p_name), 'abvgdezijklmnoprstufhcyx', 'абвгдезийклмнопрстуфхцыж')"


@query("translit_confusable", f"""SELECT id, replace(replace(replace(translate(c, 'абвгдезийклмнопрстуфыэ', 'abvgdeziiklmnoprstufye'), 'ж', 'zh'), 'х', 'kh'), 'ц', 'ts') AS latin,
  regexp_replace(translate(c, 'авсенкмортху', 'abcehkmoptxy'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS identifier FROM (SELECT p_partkey AS id, {_CYRILLIC} AS c FROM part)""")
def translit_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.translate(F.lower("p_name"), "abvgdezijklmnoprstufhcyx", "абвгдезийклмнопрстуфхцыж").alias("c"))
    return p.select("id", T.transliterate(F.col("c")).alias("latin"), T.identifier_form(F.col("c")).alias("identifier"))


def _identifiers(text: str) -> str:
    """Identifier-like tokens of a text, sorted: runs whose first part without ``_`` and ``/`` has a digit, in identifier form."""
    found = f"list_transform(regexp_extract_all(lower({text}), '[0-9a-zа-я]+(?:[-_/][0-9a-zа-я]+)*'), lambda t: regexp_replace(t, '^(?:[a-zа-я-]+[_/])+', ''))"
    forms = f"list_transform(list_filter({found}, lambda t: regexp_matches(t, '[0-9]')), lambda t: regexp_replace(translate(replace(t, 'ё', 'е'), 'авсенкмортху', 'abcehkmoptxy'), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    return f"list_sort(list_distinct(list_filter({forms}, lambda t: length(t) >= 2)))"


@query("identifier_tokens", f"SELECT doc_id, array_to_string({_identifiers('coalesce(text, chr(32))')}, ' ') AS identifiers FROM documents")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.identifier_tokens(F.col("text")), " ").alias("identifiers"))


@query("json_attributes", "SELECT event_id, e.k AS key, json_extract_string(props, '$.' || e.k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) e")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", C.parsed_attributes(F.col("props"))[0].alias("e"))
    return e.select("event_id", F.explode(C.unique_entries(F.col("e"))).alias("x")).select("event_id", "x.key", "x.value")


_ITEM = r"""item AS (SELECT p_partkey AS id, p_type AS category, lower(p_name) AS name_norm, p_name, p_size, p_partkey % 2 = 0 AS two_brands,
  trim(regexp_replace(lower(p_brand), '[^\p{L}\p{N}]+', ' ', 'g')) AS brand_norm, 'ab' || p_partkey AS article_norm,
  CASE p_size % 4 WHEN 0 THEN 'black' WHEN 1 THEN 'red' WHEN 2 THEN 'blue|green' ELSE 'матовый' END AS color_norm, 'ru:' || p_size AS size_norm, (p_size % 5 + 1)::VARCHAR AS quantity_norm,
  lower(p_type) AS material FROM part), canon AS (SELECT *, 'вес=' || p_size || ' кг; материал=' || material || CASE WHEN two_brands THEN '; производитель=' || brand_norm ELSE '' END AS remaining,
  list_sort(list_distinct(list_filter(regexp_extract_all(name_norm || ' ' || brand_norm || ' ' || p_partkey_text || ' ' || p_size || ' ' || quantity_norm, '[0-9a-zа-я]+'), lambda t: regexp_matches(t, '[0-9]')))) AS numbers
  FROM (SELECT *, id::VARCHAR AS p_partkey_text FROM item))"""


@query("canonical_items", f"""WITH {_ITEM} SELECT id, category, name_norm, 7 + two_brands::INT AS attribute_count, 0 AS parse_error, brand_norm, article_norm, color_norm, size_norm, quantity_norm,
  array_to_string(numbers, ' ') AS numbers, 'mass_g=' || (p_size * 1000)::DOUBLE AS measured, remaining AS remaining_attributes FROM canon""")
def canonical_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.canonicalize(raw_items(spark, sf_dir))
    measured = F.array_join(F.transform(F.map_entries("measurements"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda x: x.cast("string")), ","))), ";")
    return c.select("id", "category", "name_norm", "attribute_count", "parse_error", "brand_norm", "article_norm", "color_norm", "size_norm", "quantity_norm",
                    F.array_join("numeric_tokens", " ").alias("numbers"), measured.alias("measured"), "remaining_attributes")


def item_sql(p: str, i: str) -> str:
    """The labelled lines of an item of ``canon``."""
    return (f"'category_{p}: ' || {i}.category || chr(10) || 'name_{p}: ' || {i}.name_norm || chr(10) || 'brand_{p}: ' || {i}.brand_norm || chr(10) || 'article_{p}: ' || {i}.article_norm || chr(10) || 'size_{p}: ' || {i}.size_norm "
            f"|| chr(10) || 'quantity_{p}: ' || {i}.quantity_norm || chr(10) || 'color_{p}: ' || {i}.color_norm || chr(10) || 'attributes_{p}: ' || {i}.remaining")


@query("serialize_item", f"WITH {_ITEM} SELECT id, {item_sql('item', 'canon')} AS text FROM canon")
def serialize_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonicalize(raw_items(spark, sf_dir)).select("id", C.serialize_item().alias("text"))


@query("serialize_pair", f"""WITH {_ITEM}, co_ordered AS (SELECT DISTINCT a.l_partkey AS id1, b.l_partkey AS id2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
  SELECT id1, id2, CASE WHEN a.category = b.category THEN a.category ELSE least(a.category, b.category) || ' | ' || greatest(a.category, b.category) END AS category,
  md5('category: ' || a.category || chr(10) || {item_sql('a', 'a')}) AS text_a_md5, md5({item_sql('b', 'b')}) AS text_b_md5 FROM co_ordered JOIN canon a ON a.id = id1 JOIN canon b ON b.id = id2""")
def serialize_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.prepare_pairs(co_ordered(spark, sf_dir), C.canonicalize(raw_items(spark, sf_dir)), text_only=True)
    return pairs.select("id1", "id2", "category", F.md5("text_a").alias("text_a_md5"), F.md5("text_b").alias("text_b_md5"))


_SET = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _j(a: str, b: str) -> str:
    return "round(" + _SET.format(a=a, b=b) + ", 6)"


_TOK = "list_distinct(regexp_extract_all({x}, '[0-9a-zа-я]+'))"
FEATURE_ITEM = _ITEM + f""", feat AS (SELECT *, {_TOK.format(x='name_norm')} AS nt, list_distinct(list_transform(range(1, greatest(length(name_norm) - 2, 1) + 1), lambda i: substr(name_norm, i, 3))) AS grams,
  {_TOK.format(x="p_size || ' кг'")} AS wt, {_TOK.format(x='material')} AS mt, {_TOK.format(x='brand_norm')} AS bt,
  {_TOK.format(x="article_norm")} AS at, {_TOK.format(x="color_norm")} AS ct, {_TOK.format(x="size_norm")} AS st, {_TOK.format(x="quantity_norm")} AS qt,
  {_identifiers("p_name || ' Brand#' || split_part(brand_norm, ' ', 2) || ' AB-' || id || ' ' || p_size || ' ' || quantity_norm")} AS idt, {_identifiers("p_size || ' кг'")} AS wi, {_identifiers("brand_norm")} AS bi FROM canon)"""
_COORD = "co_ordered AS (SELECT DISTINCT a.l_partkey AS id1, b.l_partkey AS id2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
_FIELDS_SQL = ", ".join(
    f"1.0 AS {f}_both, (a.{f}_norm = b.{f}_norm)::INT::DOUBLE AS {f}_equal, (a.{f}_norm <> b.{f}_norm)::INT::DOUBLE AS {f}_conflict" for f in ("brand", "article", "color", "size", "quantity"))


@query("pair_features", f"""WITH {FEATURE_ITEM}, co_ordered AS (SELECT DISTINCT a.l_partkey AS id1, b.l_partkey AS id2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
  x AS (SELECT id1, id2, {_j('a.nt', 'b.nt')} AS name_token_jaccard, round(CASE WHEN least(len(a.nt), len(b.nt)) = 0 THEN 0.0 ELSE len(list_intersect(a.nt, b.nt))::DOUBLE / least(len(a.nt), len(b.nt)) END, 6) AS name_token_containment,
  {_j('a.grams', 'b.grams')} AS name_char_jaccard, round(least(length(a.name_norm), length(b.name_norm))::DOUBLE / greatest(length(a.name_norm), length(b.name_norm), 1), 6) AS name_length_ratio,
  (a.name_norm = b.name_norm)::INT::DOUBLE AS name_exact, {_j('a.numbers', 'b.numbers')} AS numeric_jaccard, (list_sort(a.numbers) <> list_sort(b.numbers))::INT::DOUBLE AS numeric_conflict,
  7.0 + least(a.two_brands::INT, b.two_brands::INT) AS attribute_count_min, 7.0 + greatest(a.two_brands::INT, b.two_brands::INT) AS attribute_count_max, {_FIELDS_SQL},
  {_j('a.bt', 'b.bt')} AS brand_token_jaccard, {_j('a.ct', 'b.ct')} AS color_token_jaccard, 1.0 AS measurement_common_types,
  (abs(a.p_size - b.p_size)::DOUBLE / greatest(a.p_size, b.p_size) <= 0.015)::INT::DOUBLE AS measurement_compatible_types, round(abs(a.p_size - b.p_size)::DOUBLE / greatest(a.p_size, b.p_size), 6) AS measurement_min_relative_diff,
  2.0 + (a.two_brands AND b.two_brands)::INT AS aligned_attribute_key_common, round((2.0 + (a.two_brands AND b.two_brands)::INT) / (2.0 + (a.two_brands OR b.two_brands)::INT), 6) AS aligned_attribute_key_jaccard,
  0.0 + (a.p_size = b.p_size)::INT + (a.material = b.material)::INT + (a.two_brands AND b.two_brands AND a.brand_norm = b.brand_norm)::INT AS aligned_attribute_value_exact,
  round(({_SET.format(a='a.wt', b='b.wt')} + {_SET.format(a='a.mt', b='b.mt')} + CASE WHEN a.two_brands AND b.two_brands THEN {_SET.format(a='a.bt', b='b.bt')} ELSE 0 END) / (2.0 + (a.two_brands AND b.two_brands)::INT), 6) AS aligned_attribute_token_jaccard_mean,
  1.0 + (a.two_brands AND b.two_brands)::INT AS aligned_attribute_numeric_common, 0.0 + (a.p_size = b.p_size)::INT + (a.two_brands AND b.two_brands AND a.brand_norm = b.brand_norm)::INT AS aligned_attribute_numeric_overlap
  FROM co_ordered JOIN feat a ON a.id = id1 JOIN feat b ON b.id = id2) SELECT * FROM x""", double="attribute_count_min attribute_count_max brand_both article_both color_both size_both quantity_both measurement_common_types aligned_attribute_key_common aligned_attribute_value_exact aligned_attribute_numeric_common aligned_attribute_numeric_overlap")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.features(P.join_items_in_blocks(co_ordered(spark, sf_dir), C.canonicalize(raw_items(spark, sf_dir))))
    fields = [f"{f}_{k}" for f in ("brand", "article", "color", "size", "quantity") for k in ("both", "equal", "conflict")]
    names = ["name_token_jaccard", "name_token_containment", "name_char_jaccard", "name_length_ratio", "name_exact", "numeric_jaccard", "numeric_conflict", "attribute_count_min", "attribute_count_max", *fields,
             "brand_token_jaccard", "color_token_jaccard", "measurement_common_types", "measurement_compatible_types", "measurement_min_relative_diff", "aligned_attribute_key_common", "aligned_attribute_key_jaccard",
             "aligned_attribute_value_exact", "aligned_attribute_token_jaccard_mean", "aligned_attribute_numeric_common", "aligned_attribute_numeric_overlap"]
    return made.select("id1", "id2", *(F.round(n, 6).alias(n) for n in names))


def all_features_sql(pairs: str, more: str = "") -> str:
    """The 67 features and the category of pairs ``(id1, id2)``, over ``feat``. Items have no model and no type; weight and material are keys of all, the brand one of every other."""
    both, either = "(a.two_brands AND b.two_brands)", "(a.two_brands OR b.two_brands)"
    shared = f"(2.0 + {both}::INT)"
    exact = f"((a.p_size = b.p_size)::INT + (a.material = b.material)::INT + ({both} AND a.brand_norm = b.brand_norm)::INT)"
    js = f"list_concat([{_SET.format(a='a.wt', b='b.wt')}, {_SET.format(a='a.mt', b='b.mt')}], CASE WHEN {both} THEN [{_SET.format(a='a.bt', b='b.bt')}] ELSE [] END)"
    meets = lambda x: f"(len(list_intersect(a.{x}, b.{x})) > 0)::INT"
    some = lambda x: f"(len(a.{x}) > 0 AND len(b.{x}) > 0)::INT"
    ic, io = f"({some('wi')} + CASE WHEN {both} THEN {some('bi')} ELSE 0 END)", f"({meets('wi')} + CASE WHEN {both} THEN {meets('bi')} ELSE 0 END)"
    nc, no = f"(1 + {both}::INT)", f"((a.p_size = b.p_size)::INT + ({both} AND a.brand_norm = b.brand_norm)::INT)"
    lo, hi = "(7.0 + least(a.two_brands::INT, b.two_brands::INT))", "(7.0 + greatest(a.two_brands::INT, b.two_brands::INT))"
    apart = "abs(a.p_size - b.p_size)::DOUBLE / greatest(a.p_size, b.p_size)"
    tokens = {"brand": "bt", "article": "at", "color": "ct", "size": "st", "quantity": "qt"}
    values = {
        "name_token_jaccard": _SET.format(a="a.nt", b="b.nt"), "name_token_containment": "CASE WHEN least(len(a.nt), len(b.nt)) = 0 THEN 0.0 ELSE len(list_intersect(a.nt, b.nt))::DOUBLE / least(len(a.nt), len(b.nt)) END",
        "name_char_jaccard": _SET.format(a="a.grams", b="b.grams"), "name_length_ratio": "least(length(a.name_norm), length(b.name_norm))::DOUBLE / greatest(length(a.name_norm), length(b.name_norm), 1)", "name_exact": "(a.name_norm = b.name_norm)::INT",
        "identifier_jaccard": _SET.format(a="a.idt", b="b.idt"), "identifier_exact_nonempty": "(len(a.idt) > 0 AND a.idt = b.idt)::INT", "identifier_conflict": "(len(a.idt) > 0 AND len(b.idt) > 0 AND a.idt <> b.idt)::INT",
        "numeric_jaccard": _SET.format(a="a.numbers", b="b.numbers"), "numeric_exact_nonempty": "(len(a.numbers) > 0 AND list_sort(a.numbers) = list_sort(b.numbers))::INT",
        "numeric_conflict": "(len(a.numbers) > 0 AND len(b.numbers) > 0 AND list_sort(a.numbers) <> list_sort(b.numbers))::INT",
        "attribute_count_min": lo, "attribute_count_max": hi, "attribute_count_difference": f"({hi} - {lo})", "attribute_count_ratio": f"{lo} / {hi}",
    }
    for f in ("brand", "model", "article", "type", "color", "size", "quantity"):
        known = f in tokens
        values |= {f"{f}_both": "1.0" if known else "0.0", f"{f}_equal": f"(a.{f}_norm = b.{f}_norm)::INT" if known else "0.0", f"{f}_conflict": f"(a.{f}_norm <> b.{f}_norm)::INT" if known else "0.0",
                   f"{f}_token_jaccard": _SET.format(a=f"a.{tokens[f]}", b=f"b.{tokens[f]}") if known else "0.0"}
        if f in ("model", "article"):
            values[f"{f}_identifier_equal"] = "(a.article_norm = b.article_norm)::INT" if f == "article" else "0.0"
        if f == "brand":
            values["brand_translit_equal"] = "(a.brand_norm = b.brand_norm)::INT"
    values |= {
        "measurement_common_types": "1.0", "measurement_compatible_types": f"({apart} <= 0.015)::INT", "measurement_conflict_types": f"({apart} > 0.015)::INT", "measurement_min_relative_diff": apart,
    } | {f"aligned_attribute_{k}": v for k, v in {
        "key_count_min": "2.0 + least(a.two_brands::INT, b.two_brands::INT)", "key_count_max": "2.0 + greatest(a.two_brands::INT, b.two_brands::INT)", "key_common": shared, "key_jaccard": f"{shared} / (2.0 + {either}::INT)",
        "value_exact": exact, "value_exact_rate": f"{exact} / {shared}", "value_conflict": f"{shared} - {exact}", "value_conflict_rate": f"({shared} - {exact}) / {shared}",
        "token_jaccard_mean": f"list_sum({js}) / {shared}", "token_jaccard_min": f"list_min({js})", "token_jaccard_max": f"list_max({js})",
        "identifier_common": ic, "identifier_overlap": io, "identifier_conflict": f"{ic} - {io}", "numeric_common": nc, "numeric_overlap": no, "numeric_conflict": f"{nc} - {no}"}.items()}
    category = "CASE WHEN a.category = b.category THEN a.category ELSE least(a.category, b.category) || ' | ' || greatest(a.category, b.category) END AS category"
    return f"SELECT id1, id2, {category}, {', '.join(f'round(({v})::DOUBLE, 6) AS {k}' for k, v in values.items())}{more} FROM {pairs} JOIN feat a ON a.id = id1 JOIN feat b ON b.id = id2"


def _six(name: str) -> F.Column:
    """A value of 0 or more to six decimals, in plain arithmetic: ``round`` goes through decimals."""
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


@query("pair_features_all", f"WITH {FEATURE_ITEM}, {_COORD} {all_features_sql('co_ordered')}")
def pair_features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 67 features and the pair's category."""
    made = P.features(P.join_baskets_in_blocks(order_parts(spark, sf_dir), C.canonicalize(raw_items(spark, sf_dir))))
    return made.select("id1", "id2", "category", *(_six(c) for c in made.columns if c not in ("id1", "id2", "category")))


@query("aligned_attributes", f"WITH {FEATURE_ITEM}, pairs AS (SELECT p_partkey AS id1, p_partkey + 1 AS id2 FROM part) SELECT id1, id2, COLUMNS('aligned_attribute_.*') FROM ({all_features_sql('pairs')})")
def aligned_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 17 aligned-attribute features of neighbouring items."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id1"), (F.col("p_partkey") + 1).alias("id2"))
    made = P.features(P.join_items(pairs, P.prepared_items(C.canonicalize(raw_items(spark, sf_dir)))))
    return made.select("id1", "id2", *(F.round(c, 6).alias(c) for c in made.columns if c.startswith("aligned_attribute_")))


_WORDS = "list_distinct(regexp_extract_all(lower({x}), '[0-9a-zа-я]+'))"


@query("pair_jaccard_containment", f"""WITH t AS (SELECT item_id, {_WORDS.format(x='text')} AS w FROM benchmark) SELECT a.item_id AS id1, b.item_id AS id2, {_j('a.w', 'b.w')} AS jaccard,
  round(CASE WHEN least(len(a.w), len(b.w)) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)) END, 6) AS containment FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def pair_jaccard_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token Jaccard and containment of neighbouring benchmark passages."""
    t = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.lower("text")).alias("w"))
    a, b = t.select(F.col("item_id").alias("id1"), F.col("w").alias("x")), t.select(F.col("item_id").alias("id2"), F.col("w").alias("y"))
    both = a.join(b, F.col("id2") == F.col("id1") + 1)
    return both.select("id1", "id2", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(S.containment(F.col("x"), F.col("y")), 6).alias("containment"))


_MEASURED = "p_size || ' кг / ' || (p_size * 10) || ' см, ' || p_size || ',5 л ' || (p_partkey % 7) || 'шт x' || p_size || 'мм; ' || (p_partkey % 3) || '.25 г'"


@query("measurements", f"""WITH m AS (SELECT p_partkey AS id, unnest([{{'kind': 'mass_g', 'x': p_size * 1000.0}}, {{'kind': 'length_mm', 'x': p_size * 100.0}}, {{'kind': 'volume_ml', 'x': (p_size + 0.5) * 1000.0}}, {{'kind': 'count', 'x': p_partkey % 7 + 0.0}},
  {{'kind': 'mass_g', 'x': p_partkey % 3 + 0.25}}]) AS e FROM part) SELECT id, e.kind AS kind, count(DISTINCT e.x)::INT AS n, round(min(e.x)::DOUBLE, 6) AS least, round(max(e.x)::DOUBLE, 6) AS most FROM m GROUP BY ALL""")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of texts with several units; a number that follows a letter is none."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.measurements(F.array(F.expr(_MEASURED.replace("||", ",").join(("concat(", ")"))))).alias("m"))
    m = p.select("id", F.explode("m").alias("kind", "v"))
    return m.select("id", "kind", F.size("v").alias("n"), F.round(F.array_min("v"), 6).alias("least"), F.round(F.array_max("v"), 6).alias("most"))


_KEYS = ("бренд", "марка", "производитель", "модель товара", "совместимая модель", "артикул", "oem номер", "цвет товара", "цвет", "температура цвета", "размер", "размер упаковки", "российский размер", "количество шт", "количество режимов", "тип", "вес")
_SCORES = {
    "type": {"тип": 100}, "brand": {"бренд": 100, "марка": 80, "производитель": 45}, "model": {"модель товара": 95}, "article": {"артикул": 100, "oem номер": 95}, "color": {"цвет товара": 100, "цвет": 90},
    "size": {"размер": 90, "российский размер": 100}, "quantity": {"количество шт": 100},
}


@query("key_priority_select", f"""WITH k AS (SELECT p_partkey AS id, unnest({list(_KEYS)}) AS key, generate_subscripts({list(_KEYS)}, 1) AS i FROM part), given AS (SELECT id, key, i FROM k WHERE (id * 7 + i * i) % 3 <> 0),
  s AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{key}', {n})" for f, by in _SCORES.items() for key, n in by.items())}) v(field, key, score))
  SELECT id, field, key FROM given JOIN s USING (key) QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY score DESC, i) = 1""")
def key_priority_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute key that each field is read from, of varying sets of keys."""
    keys = F.array(*(F.lit(k) for k in _KEYS))
    entries = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.lit("v").alias("value"), k.alias("nkey"), F.lit("v").alias("nvalue"), F.lit("v").alias("fvalue"), F.pmod(F.col("id") * 7 + (i + 1) * (i + 1), F.lit(3)).alias("drop")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).withColumn("e", F.filter(entries, lambda e: e["drop"] != 0))
    fields = F.array(*(F.struct(F.lit(f).alias("field"), C.select_field(f, F.col("e"))["key"].alias("key")) for f in _SCORES))
    return p.select("id", F.explode(fields).alias("x")).select("id", "x.field", "x.key").where("key is not null")


@query("compact_attributes", """WITH k AS (SELECT p_partkey AS id, unnest(range(0, 9)) AS i FROM part), e AS (SELECT id, 'k' || ((id + i * 5) % 9) AS nkey, repeat('v', ((id * (i + 1)) % 11)::INT) AS nvalue FROM k), o AS (SELECT *, nkey || '=' || nvalue AS p FROM e WHERE nvalue <> '' AND nkey <> 'k3'),
  r AS (SELECT *, sum(length(p) + 2) OVER (PARTITION BY id ORDER BY nkey ROWS UNBOUNDED PRECEDING) AS upto FROM o) SELECT p_partkey AS id, coalesce((SELECT string_agg(p, '; ' ORDER BY nkey) FROM r WHERE r.id = p_partkey AND upto <= 40), '') AS remaining FROM part""")
def compact_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unselected attributes by key, up to the first that would pass the limit."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    entries = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(F.concat(F.lit("k"), F.pmod(F.col("id") + i * 5, F.lit(9)).cast("string")).alias("nkey"), F.repeat(F.lit("v"), F.pmod(F.col("id") * (i + 1), F.lit(11)).cast("int")).alias("nvalue")))
    return p.select("id", C.compact_remaining(entries, F.array(F.lit("k3")), 40).alias("remaining"))


_NAME = "name AS (SELECT p_partkey AS id, p_type AS category, unnest(list_distinct(regexp_extract_all(lower(p_name), '[0-9a-zа-я]+'))) AS token FROM part), total AS (SELECT count(*) AS n FROM part)"


def _plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What corpus statistics read of canonical items, as a table: what follows reads it several times."""
    return materialize(C.canonicalize(raw_items(spark, sf_dir)).select("id", "category", "name_norm", "brand_norm", "identifier_tokens", "remaining_attributes"), "counted-items")


@query("token_df", f"WITH {_NAME} SELECT token, count(*) AS df FROM name GROUP BY token")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.document_frequency(C.canonicalize(raw_items(spark, sf_dir)), T.tokens(F.col("name_norm"))).withColumnRenamed("item", "token")


@query("token_idf", f"WITH {_NAME}, df AS (SELECT token, count(*) AS df FROM name GROUP BY token) SELECT id, token, round(ln(n::DOUBLE / df) / ln(n::DOUBLE), 6) AS idf FROM name JOIN df USING (token), total")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _plain_items(spark, sf_dir)
    annotated = K.annotate(items, K.statistics(items, "h12-v1"))
    return annotated.select("id", F.explode("name_idf").alias("token", "idf")).select("id", "token", F.round("idf", 6).alias("idf"))


@query("category_token_idf", f"""WITH {_NAME}, df AS (SELECT category, token, count(*) AS df FROM name GROUP BY ALL), cat AS (SELECT p_type AS category, count(*) AS n FROM part GROUP BY ALL)
  SELECT id, token, round(ln(n::DOUBLE / df) / ln(n::DOUBLE), 6) AS idf FROM name JOIN df USING (category, token) JOIN cat USING (category)""")
def category_token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _plain_items(spark, sf_dir)
    annotated = K.annotate(items, K.statistics(items, "h12-v1-c1"))
    return annotated.select("id", F.explode("category_idf").alias("token", "idf")).select("id", "token", F.round("idf", 6).alias("idf"))


@query("brand_percentile", "SELECT brand, df, round(cume_dist() OVER (ORDER BY df), 6) AS percentile FROM (SELECT lower(replace(p_brand, '#', ' ')) AS brand, count(*) AS df FROM part GROUP BY ALL)")
def brand_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = C.canonicalize(raw_items(spark, sf_dir))
    ranked = K.brand_percentiles(K.document_frequency(items.where("brand_norm <> ''"), F.array("brand_norm")))
    return ranked.select(F.col("item").alias("brand"), "df", F.round("percentile", 6).alias("percentile"))


@query("transductive_pair", f"""WITH {_NAME}, co_ordered AS (SELECT DISTINCT a.l_partkey AS id1, b.l_partkey AS id2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
  idf AS (SELECT token, ln(n::DOUBLE / count(*)) / ln(n::DOUBLE) AS idf FROM name, total GROUP BY token, n), brand AS (SELECT p_brand, cume_dist() OVER (ORDER BY df) AS pct FROM (SELECT p_brand, count(*) AS df FROM part GROUP BY ALL)),
  side AS (SELECT id1, id2, token, count(*) AS sides FROM (SELECT id1, id2, token FROM co_ordered JOIN name ON id = id1 UNION ALL SELECT id1, id2, token FROM co_ordered JOIN name ON id = id2) GROUP BY ALL),
  agg AS (SELECT id1, id2, coalesce(max(idf) FILTER (sides = 2), 0.0) AS rarest, coalesce(avg(idf) FILTER (sides = 2), 0.0) AS mean, coalesce(max(idf) FILTER (sides = 1), 0.0) AS apart FROM side JOIN idf USING (token) GROUP BY ALL)
  SELECT id1, id2, round(rarest, 6) AS transductive_rarest_shared_token_idf, round(mean, 6) AS transductive_mean_shared_token_idf, round(apart, 6) AS transductive_max_unshared_token_idf,
  round(least(x.pct, y.pct), 6) AS transductive_brand_frequency_percentile_min, round(greatest(x.pct, y.pct), 6) AS transductive_brand_frequency_percentile_max
  FROM agg JOIN part a ON a.p_partkey = id1 JOIN part b ON b.p_partkey = id2 JOIN brand x ON x.p_brand = a.p_brand JOIN brand y ON y.p_brand = b.p_brand""")
def transductive_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _plain_items(spark, sf_dir)
    joined = P.join_items(co_ordered(spark, sf_dir), K.annotate(items, K.statistics(items, "h12-v1")).drop(*items.columns[1:]))
    made = K.transductive_features(joined)
    return joined.select("id1", "id2", *(F.round(made[n], 6).alias(n) for n in K.BASE[:5]))


@query("transductive_all", f"""WITH {FEATURE_ITEM}, {_COORD}, n AS (SELECT count(*)::DOUBLE AS n FROM part), tok AS (SELECT id, category, unnest(nt) AS item FROM feat), idt AS (SELECT id, unnest(idt) AS item FROM feat),
  gdf AS (SELECT item, ln(n / count(*)) / ln(n) AS v FROM tok, n GROUP BY item, n), cdf AS (SELECT category, item, CASE WHEN c > 1 THEN ln(c / df) / ln(c) ELSE 0 END AS v FROM (SELECT category, item, count(*)::DOUBLE AS df FROM tok GROUP BY ALL) JOIN (SELECT category, count(*)::DOUBLE AS c FROM feat GROUP BY ALL) USING (category)),
  idf AS (SELECT item, ln(1 + count(*)) / ln(1 + n) AS v FROM idt, n GROUP BY item, n), brand AS (SELECT brand_norm, cume_dist() OVER (ORDER BY df) AS pct FROM (SELECT brand_norm, count(*) AS df FROM feat GROUP BY ALL)),
  kdf AS (SELECT ln(n / count(*)) / ln(n) AS v FROM feat, n WHERE two_brands GROUP BY n),
  val AS (SELECT id, 't' AS kind, item, v FROM tok JOIN gdf USING (item) UNION ALL SELECT id, 'c', item, v FROM tok JOIN cdf USING (category, item) UNION ALL SELECT id, 'i', item, v FROM idt JOIN idf USING (item)),
  side AS (SELECT id1, id2, kind, item, count(*) AS sides, min(v) AS v FROM (SELECT id1, id2, kind, item, v FROM co_ordered JOIN val ON id = id1 UNION ALL SELECT id1, id2, kind, item, v FROM co_ordered JOIN val ON id = id2) GROUP BY ALL),
  agg AS (SELECT id1, id2, {', '.join(f"coalesce(max(v) FILTER (kind = '{k}' AND sides = 2), 0) AS {k}_most, coalesce(avg(v) FILTER (kind = '{k}' AND sides = 2), 0) AS {k}_mean, coalesce(max(v) FILTER (kind = '{k}' AND sides = 1), 0) AS {k}_apart, coalesce(min(v) FILTER (kind = '{k}' AND sides = 2), 0) AS {k}_least" for k in 'tci')} FROM side GROUP BY ALL)
  SELECT id1, id2, round(t_most, 6) AS transductive_rarest_shared_token_idf, round(t_mean, 6) AS transductive_mean_shared_token_idf, round(t_apart, 6) AS transductive_max_unshared_token_idf,
  round(least(x.pct, y.pct), 6) AS transductive_brand_frequency_percentile_min, round(greatest(x.pct, y.pct), 6) AS transductive_brand_frequency_percentile_max, round(i_least, 6) AS transductive_identifier_df,
  round(c_most, 6) AS transductive_category_rarest_shared_token_idf, round(c_mean, 6) AS transductive_category_mean_shared_token_idf, round(c_apart, 6) AS transductive_category_max_unshared_token_idf,
  round(CASE WHEN a.two_brands AND b.two_brands THEN kdf.v ELSE 0 END, 6) AS aligned_attribute_common_key_idf_sum, round(CASE WHEN a.two_brands AND b.two_brands THEN kdf.v ELSE 0 END, 6) AS aligned_attribute_common_key_idf_max,
  (a.two_brands AND b.two_brands)::INT::DOUBLE AS aligned_attribute_key_idf_weighted_jaccard
  FROM agg JOIN feat a ON a.id = id1 JOIN feat b ON b.id = id2 JOIN brand x ON x.brand_norm = a.brand_norm JOIN brand y ON y.brand_norm = b.brand_norm, kdf""")
def transductive_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve corpus features of the widest profile."""
    items = _plain_items(spark, sf_dir)
    joined = P.join_items(co_ordered(spark, sf_dir), K.annotate(items, K.statistics(items)).drop(*items.columns[1:]))
    return joined.select("id1", "id2", *(v.alias(k) for k, v in K.transductive_features(joined).items())).select("id1", "id2", *map(_six, K.PROFILES["h12-v1-c1-c2"]))


@query("same_category_pairs", f"WITH {_COORD} SELECT id1, id2, a.p_type AS category FROM co_ordered JOIN part a ON a.p_partkey = id1 JOIN part b ON b.p_partkey = id2 AND b.p_type = a.p_type")
def same_category_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.same_category_pairs(co_ordered(spark, sf_dir), raw_items(spark, sf_dir))
