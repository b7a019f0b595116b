"""Score fusion with boosted trees of Spark ML, locked feature schemas, and covariate-shift diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import metrics as M
from matchloom.operators import ranking as R
from matchloom.operators.corpus import schema_digest
from matchloom.plans.durable import materialize

#: Columns that are never features.
EXCLUDED = ("id1", "id2", "target", "fold", "row_id", "category", "text_a", "text_b", "is_synthetic", "source_row_id")


def feature_names(df: DataFrame) -> list[str]:
    """Numeric columns but keys, labels and bookkeeping, sorted."""
    return sorted(f.name for f in df.schema if f.name not in EXCLUDED and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte"))


def assembled(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing columns and values are 0; the order is the schema's."""
    filled = df.select("*", *(F.lit(0.0).alias(n) for n in names if n not in df.columns)).fillna(0.0, [n for n in names if n in df.columns])
    return VectorAssembler(inputCols=names, outputCol="__x").transform(filled)


def train_oof(df: DataFrame, depths: tuple[int, ...] = (4,), rates: tuple[float, ...] = (0.1,), trees: int = 20, seed: int = 7) -> tuple[dict, DataFrame, PipelineModel]:
    """Grid over depth and step size: each fold is predicted by a model of the others; the best setting by macro average precision is refitted on all rows.

    Returns ``({depth, rate, macro_ap, features, digest}, rows with "score", model)``.
    """
    names = feature_names(df)
    rows = assembled(materialize(df, "fusion-rows"), names)
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    best = None
    for depth in depths:
        for rate in rates:
            tree = GBTRegressor(featuresCol="__x", labelCol="target", predictionCol="score", maxDepth=depth, stepSize=rate, maxIter=trees, seed=seed)
            parts = [tree.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)) for k in folds]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            ap = M.macro_average_precision(out).first()["macro_ap"]
            if best is None or ap > best[0]["macro_ap"]:
                best = {"depth": depth, "rate": rate, "macro_ap": ap, "features": names, "digest": schema_digest(names)}, out, tree
    facts, out, tree = best
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__x"), tree]).fit(df.fillna(0.0, names))
    return facts, out.drop("__x"), model


def ablations(df: DataFrame, score: str = "text_score", depth: int = 4, rate: float = 0.1, trees: int = 20, seed: int = 7) -> dict[str, float]:
    """Macro average precision by category of the score alone, of trees over the other features alone, and of trees over both, all out of fold."""
    settings = {"depths": (depth,), "rates": (rate,), "trees": trees, "seed": seed}
    alone = M.macro_average_precision(df, score=score).first()["macro_ap"]
    return {"score_only": alone, "features_only": train_oof(df.drop(score), **settings)[0]["macro_ap"], "fusion": train_oof(df, **settings)[0]["macro_ap"]}


def predict(model: PipelineModel, df: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    """Scores of the locked features; ``strict`` refuses rows of a table that lacks one, else it counts as 0."""
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise ValueError(f"missing features: {missing}")
    filled = df.select("*", *(F.lit(0.0).alias(n) for n in missing)).fillna(0.0, [n for n in names if n in df.columns])
    return model.transform(filled).drop("__x")


def fusion_shift(model: PipelineModel, rows: DataFrame, names: list[str], before: str, after: str, score: str = "text_score", key: str = "row_id", fraction: float = 0.01, strict: bool = True) -> DataFrame:
    """How a fixed fusion reacts to another score as its input: ``score_shift`` with ``what``: its input, its output, and input against output before and after.

    Only ranks are described; nothing here validates a model. Raises where a prediction is not finite or, if ``strict``, a rank correlation is undefined.
    """
    out = rows.select(key, "category", before, after)
    for name, column in (("fused_before", before), ("fused_after", after)):
        out = out.join(predict(model, rows.withColumn(score, F.col(column)).select(key, *names), names, strict=True).select(key, F.col("score").alias(name)), key)
    out = materialize(out, "fused")
    R.require_finite(out, "fused_before", "fused_after")
    pairs = {"input": (before, after), "output": ("fused_before", "fused_after"), "before": (before, "fused_before"), "after": (after, "fused_after")}
    parts = [M.score_shift(out, a, b, key, fraction=fraction).select(F.lit(what).alias("what"), "*") for what, (a, b) in pairs.items()]
    found = materialize(reduce(DataFrame.unionByName, parts), "fusion-shift")
    if strict and not found.where("spearman is null or isnan(spearman)").isEmpty():
        raise ValueError("a rank correlation is undefined")
    return found


def round_trip_gap(model: PipelineModel, df: DataFrame, path: str) -> float:
    """Greatest difference of predictions after saving and loading the model."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a, b = model.transform(df).select("row_id", F.col("score").alias("a")), again.transform(df).select("row_id", F.col("score").alias("b"))
    return float(a.join(b, "row_id").agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0))).first()[0])


def two_sample_auc(df: DataFrame, names: list[str], source: str, positive: str, folds: int = 5, seed: int = 7) -> float | None:
    """Out-of-fold AUC of a standardised logistic classifier that tells two sources apart; none if one has fewer than two rows."""
    rows = assembled(materialize(df.select(*names, (F.col(source) == positive).cast("double").alias("__y")), "two-samples"), names)
    n = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    if min(n.get(0.0, 0), n.get(1.0, 0)) < 2:
        return None
    rows = rows.withColumn("__k", F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(folds)))
    flow = Pipeline(stages=[StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol="__y", probabilityCol="__p", maxIter=50)])
    parts = [flow.fit(rows.where(F.col("__k") != k)).transform(rows.where(F.col("__k") == k)).select("__y", vector_to_array("__p")[1].alias("__s")) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return M.roc_auc(out.withColumn("g", F.lit(1)), ["g"], "__y", "__s").first()["auc"]
