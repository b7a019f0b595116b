"""Serving: items and pairs in, one score a pair out, as one lazy plan with two consumers of the canonical items."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import corpus as K
from matchloom.operators import fusion as X
from matchloom.operators import pairs as P
from matchloom.operators import ranking as R
from matchloom.operators.canonical import canonicalize
from matchloom.operators.scoring import score_pairs
from matchloom.plans.durable import materialize

Load = Callable[[], Callable[[list[str], list[str]], list[float]]]


def predict_pairs(items: DataFrame, pairs: DataFrame, scorers: list[Load], fusion: PipelineModel | None = None, names: list[str] | None = None, weights: list[float] | None = None,
                  two_scores: bool = False, ranked: bool = False, constant_categories: list[str] | None = None, constant: float = 0.5) -> DataFrame:
    """``row_id, id1, id2, predict`` for every pair, in any order (``row_id`` is the pairs' own order).

    One scorer, a mean of several, or two scores side by side (``two_scores``: refuses weights, text-only use and any other
    number of scorers). Corpus statistics cover all items, of which only the pairs' are kept afterwards. Fusion
    sees all pairs at once, so a rank depends on no chunk. Raises if a pair's item is missing.
    """
    if two_scores and (weights or fusion is None or len(scorers) != 2):
        raise ValueError("two scores need a fusion model, exactly two scorers and no weights")
    if constant_categories and not 0 < constant < 1:
        raise ValueError("the constant lies in (0, 1)")
    names = names or []
    canonical = materialize(canonicalize(items), "serving-items")
    missing = P.missing_ids(pairs, canonical).count()
    if missing:
        raise ValueError(f"{missing} ids of pairs are missing")
    if names and set(names) & {f for p in K.PROFILES.values() for f in p}:
        annotated = K.annotate(canonical, K.statistics(canonical))
    else:
        annotated = canonical
    wanted = P.prepared_items(P.only_ids(annotated, P.endpoint_ids(pairs)))
    joined = P.join_items(pairs, wanted)
    texts = P.prepare_pairs(pairs, canonical, text_only=True)
    held = F.col("category").isin(*constant_categories) if constant_categories else F.lit(False)
    to_score = R.length_sorted(texts.where(~held).withColumns({"target": F.lit(0.0), "fold": F.lit(0)}), 8, "text_a", "text_b")
    scores = None
    for i, load in enumerate(scorers):
        one = score_pairs(to_score, load).select(F.col("row_index").alias("row_id"), F.col("text_score").alias(f"s{i}"))
        scores = one if scores is None else scores.join(one, "row_id")
    if two_scores:
        scores = scores.select("row_id", F.col("s0").alias("text_score"), F.col("s1").alias("second_score"))
    else:
        scores = scores.select("row_id", R.combine([F.col(f"s{i}") for i in range(len(scorers))], weights).cast("double").alias("text_score"))
    base = texts.select("row_id", "id1", "id2", "category").join(scores, "row_id", "left")
    if fusion is None:
        out = base.withColumn("predict", F.col("text_score"))
    else:
        known = any(n in K.BASE + K.CATEGORY + K.ATTRIBUTE for n in names)
        made = P.features(joined, extra=K.transductive_features(joined) if known else None)
        full = made.join(base.drop("id1", "id2", "category"), "row_id")
        if ranked:
            full = R.percentile_rank(full, "text_score")
        out = X.predict(fusion, full, names, strict=two_scores).withColumn("predict", F.col("score"))
    return out.select("row_id", "id1", "id2", F.when(held, F.lit(constant)).otherwise(F.col("predict")).alias("predict"))


def timed(stage: str, timings: dict[str, float], act: Callable[[], Any]) -> Any:  # noqa: ANN401
    """Run an action and note its seconds."""
    from time import perf_counter

    began = perf_counter()
    out = act()
    timings[stage] = round(perf_counter() - began, 3)
    return out
