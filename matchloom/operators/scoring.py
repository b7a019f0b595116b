"""Pluggable pair scorers, applied to Arrow batches with one model per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]], fold: int | None = None) -> DataFrame:
    """``row_index, id1, id2, target, fold, text_score`` by a scorer that ``load`` makes once per worker task.

    With a fold, only its real rows are scored; a row of it whose ``is_synthetic`` is null is an error.
    """
    rows = pairs
    if fold is not None:
        rows = rows.where(F.col("fold") == fold)
        if "is_synthetic" in pairs.columns:
            if not rows.where("is_synthetic is null").isEmpty():
                raise ValueError("is_synthetic is null in the fold")
            rows = rows.where(~F.col("is_synthetic"))

    def run(frames: Iterator) -> Iterator:  # noqa: ANN401
        scorer = None
        for frame in frames:
            scorer = scorer or load()
            frame["text_score"] = scorer(frame["text_a"].tolist(), frame["text_b"].tolist())
            yield frame[["row_index", "id1", "id2", "target", "fold", "text_score"]]

    wanted = rows.select(F.col("row_id").alias("row_index"), "id1", "id2", F.col("target").cast("double").alias("target"), F.col("fold").cast("int").alias("fold"), "text_a", "text_b")
    return wanted.mapInPandas(run, "row_index long, id1 long, id2 long, target double, fold int, text_score double")


def token_overlap_scorer() -> Callable[[list[str], list[str]], list[float]]:
    """A stand-in scorer without weights: token Jaccard of both texts."""

    def score(a: list[str], b: list[str]) -> list[float]:
        sets = ((set(x.split()), set(y.split())) for x, y in zip(a, b))
        return [len(x & y) / len(x | y) if x | y else 0.0 for x, y in sets]

    return score
