"""Preference formatting: shared prompt and masked completions, with built-in functions only.

Two conversations, one chosen and one rejected, share their longest common prefix of turns (equal role and
text, nulls equal). The prefix is rendered once as the prompt. What follows is each side's
completion: its rendered turns, and a mask with a character range for every turn
that a model would be trained on, those of ``trained_role``.

A turn is rendered as ``<|role|>\\ntext<|end|>\\n``. Turns are ordered by number, then role and text; a
repeated identical turn counts once. Null roles and texts are rendered as empty. A side
without turns has an empty completion; its pair's prompt is empty. Turns of no pair (null) are left out; ids may be any 64-bit numbers. Very long
texts are whole; other columns are not read, whatever their names. No rows: no rows.

``exchanged_replies`` makes pairs from conversations alone: each is chosen, up to its last reply, against itself with that reply taken from
its partner, the conversation whose id differs in the last bit only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(turn: Column) -> Column:
    role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _spans(turns: Column, trained_role: str) -> Column:
    """``[start, end)`` ranges, as ``start:end`` joined by commas, of the trained texts with their end mark."""
    head = lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + F.lit(5)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(_rendered(t))
        span = F.concat_ws(":", (acc["at"] + head(t)).cast("string"), (end - F.lit(1)).cast("string"))
        spans = F.when(t["role"] == trained_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                       trained_role: str = "assistant") -> DataFrame:
    """One row per pair: ``pair_id, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``.

    ``pair`` names a turn's pair and ``chosen`` says whether it belongs to the chosen side. Turns are
    deduplicated by partial aggregation before they meet.
    """
    side = F.struct(turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("is_chosen"), side.alias("t")).where("pair_id is not null")
    sides = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_chosen"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_set(F.when(~F.col("is_chosen"), F.col("t")))).alias("r"),
    )
    same = lambda i: F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"])
    most = F.least(F.size("c"), F.size("r"))
    parting = F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | ~same(i))
    cut = sides.withColumn("n_prompt_turns", F.array_min(parting))
    after = lambda x: F.slice(F.col(x), F.col("n_prompt_turns") + 1, F.greatest(F.size(x), F.lit(1)))
    cut = cut.withColumn("p", F.slice(F.col("c"), F.lit(1), F.col("n_prompt_turns"))).withColumn("ca", after("c")).withColumn("ra", after("r"))
    text = lambda x: F.array_join(F.transform(F.col(x), _rendered), "")
    return cut.select(
        "pair_id", "n_prompt_turns", F.size("ca").alias("n_chosen_turns"), F.size("ra").alias("n_rejected_turns"), text("p").alias("prompt"),
        text("ca").alias("chosen"), _spans(F.col("ca"), trained_role).alias("chosen_mask"), text("ra").alias("rejected"), _spans(F.col("ra"), trained_role).alias("rejected_mask"),
    )


def exchanged_replies(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """``pair_id, is_chosen, turn, role, text``: every conversation as the chosen side of a pair, and with its partner's last reply for its own as the rejected side.

    Turns after the last reply are on neither side. Without a reply of its own both sides are the conversation; without one of its partner's
    the rejected side ends before the reply. A null turn number comes first; of replies with one number the text greater in order is the last.
    """
    t = turns.select(turns[id_col].cast("long").alias("pair_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text")).where("pair_id is not null")
    last = t.where(F.col("role") == trained_role).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.coalesce("last.text", F.lit("")).alias("other"))
    joined = t.join(last.select("pair_id", F.col("last.turn").alias("end"), F.lit(True).alias("replied")), "pair_id", "left").join(other, "pair_id", "left")
    joined = joined.where(F.coalesce(F.col("turn") <= F.col("end"), F.lit(True)) | F.col("replied").isNull())
    final = F.col("replied").isNotNull() & F.col("turn").eqNullSafe(F.col("end")) & (F.col("role") == trained_role)
    final = F.coalesce(final, F.lit(False))
    own = F.struct(F.lit(True).alias("is_chosen"), F.col("text").alias("text"))
    theirs = F.struct(F.lit(False).alias("is_chosen"), F.when(final, F.col("other")).otherwise(F.col("text")).alias("text"))
    sides = F.when(final & F.col("other").isNull(), F.array(own)).otherwise(F.array(own, theirs))
    return joined.select("pair_id", "turn", "role", F.explode(sides).alias("side")).select("pair_id", "side.is_chosen", "turn", "role", "side.text")
