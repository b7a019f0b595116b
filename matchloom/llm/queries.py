"""The registered query of every operator, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import table


def vocabulary(name: str) -> str:
    """The default place of a public vocabulary file; every operator takes a path of its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the last reply of its partner."""
    from matchloom.llm import chat_pairs

    turns = chat_pairs.exchanged_replies(table(spark, sf_dir, "conversations"))
    return chat_pairs.format_preferences(turns, F.col("pair_id"), F.col("is_chosen"))


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import minhash

    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import quality

    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_template_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import html_text

    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def op6_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~F.coalesce(held_out(), F.lit(False)))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low quality first, then toxicity given it: the categories that ``labels`` has."""
    from matchloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories)
    found = toxicity.predict(docs, chain, list(categories))
    return found.withColumn("toxic", F.col("p_toxic") >= F.lit(chain[-1].threshold if chain else 0.5))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and with others: one bitwise aggregation over the ledger."""
    from matchloom.llm import quality

    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_preference_pairs, op2_minhash_fingerprints, op3_quality_ledger, op4_pair_index_bpe, op5_template_free_text, op6_language_backoff,
        op7_longest_match_counts, op8_mixture_packing, op9_toxicity_chain, op10_simhash_blocks, quality_ablations)}


_TURN = "'<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)"


def _mask(turns: str) -> str:
    size = f"list_transform({turns}, lambda t: length({_TURN}))"
    at = f"coalesce(list_sum(({size})[1:i - 1]), 0)::BIGINT"
    span = f"({at} + length(coalesce({turns}[i].role, '')) + 5) || ':' || ({at} + ({size})[i] - 1)"
    return f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), lambda i: {span}), ',')"


OP1_SQL = f"""WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
  l AS (SELECT pair_id, turn AS last_turn, text AS reply FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1),
  j AS (SELECT t.*, coalesce(l.pair_id IS NOT NULL AND turn IS NOT DISTINCT FROM l.last_turn AND role = 'assistant', false) AS final, o.pair_id IS NOT NULL AS partnered, coalesce(o.reply, '') AS other
    FROM t LEFT JOIN l USING (pair_id) LEFT JOIN l o ON o.pair_id = xor(t.pair_id, 1) WHERE l.pair_id IS NULL OR coalesce(turn <= l.last_turn, true)),
  b AS (SELECT pair_id, true AS chosen, turn, role, text FROM j UNION ALL SELECT pair_id, false, turn, role, CASE WHEN final THEN other ELSE text END FROM j WHERE NOT final OR partnered),
  s AS (SELECT pair_id, coalesce(list(DISTINCT {{'turn': turn, 'role': role, 'text': text}}) FILTER (chosen), []) AS c, coalesce(list(DISTINCT {{'turn': turn, 'role': role, 'text': text}}) FILTER (NOT chosen), []) AS r
    FROM b GROUP BY 1), o AS (SELECT pair_id, list_sort(c) AS c, list_sort(r) AS r, least(len(c), len(r)) AS m FROM s),
  p AS (SELECT *, list_filter(range(0, m + 1), lambda i: i = m OR c[i + 1].role IS DISTINCT FROM r[i + 1].role OR c[i + 1].text IS DISTINCT FROM r[i + 1].text)[1] AS n FROM o),
  x AS (SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM p)
  SELECT pair_id, n::INT AS n_prompt_turns, len(c)::INT AS n_chosen_turns, len(r)::INT AS n_rejected_turns, array_to_string(list_transform(p, lambda t: {_TURN}), '') AS prompt, array_to_string(list_transform(c, lambda t: {_TURN}), '') AS chosen,
  {_mask('c')} AS chosen_mask, array_to_string(list_transform(r, lambda t: {_TURN}), '') AS rejected, {_mask('r')} AS rejected_mask FROM x"""

_WORD = r"[^\x20\x09-\x0D]"
OP3_SQL = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words FROM documents),
  g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
  c AS (SELECT DISTINCT doc_id, i + k AS at FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1), (SELECT unnest(range(0, 8)) AS k)), n AS (SELECT doc_id, count(*) AS n_repeat_words FROM c GROUP BY doc_id),
  l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM w),
  m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bangs, length(regexp_replace(text, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS n_letters,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutters FROM l LEFT JOIN n USING (doc_id)),
  b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 3 * n_words)::BIGINT
    + 32 * (word_chars > 12 * n_words)::BIGINT + 64 * (10 * n_letters < 6 * word_chars)::BIGINT + 128 * (5 * n_bangs > n_words)::BIGINT + 256 * (10 * n_stutters > 3 * n_words)::BIGINT AS failed_bits FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 > 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b"""


_RULES = "few_words repeated_windows symbols duplicate_lines short_words long_words few_letters exclamations stuttered_words".split()
ABLATIONS_SQL = f"""WITH ledger AS ({OP3_SQL}), rules AS (SELECT unnest({_RULES}) AS rule, unnest({[1 << i for i in range(len(_RULES))]}) AS bit), whole AS (SELECT count(*) FILTER (failed_bits = 0) AS n FROM ledger)
  SELECT 'v2' AS version, rule, count(*) FILTER (failed_bits & bit > 0) AS failed, count(*) FILTER (failed_bits = bit) AS failed_only, any_value(n) AS kept, any_value(n) + count(*) FILTER (failed_bits = bit) AS kept_without
  FROM ledger, rules, whole GROUP BY rule"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; tests hold the others against brute force, a round trip or held-out accuracy."""
    return {"op1_preference_pairs": OP1_SQL, "op3_quality_ledger": OP3_SQL, "quality_ablations": ABLATIONS_SQL}
