"""Command line: one sub-command for each data operation. Tables are Parquet paths in any store that Spark reads."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import augmentation as A
from matchloom.operators import corpus as K
from matchloom.operators import fusion as X
from matchloom.operators import gates as G
from matchloom.operators import metrics as M
from matchloom.operators import pairs as P
from matchloom.operators import ranking as R
from matchloom.operators import sampling as B
from matchloom.operators import scoring
from matchloom.operators.canonical import canonicalize
from matchloom.plans.durable import materialize
from matchloom.plans.session import SETTINGS, ship
from matchloom.sources import archive, io

COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def command(name: str, *options: tuple[str, dict] | str) -> Callable:
    """Register a sub-command; a bare option name is a required path."""
    made = [(o, {"required": True}) if isinstance(o, str) else o for o in options]

    def put(function: Callable) -> Callable:
        COMMANDS[name] = (function, made)
        return function

    return put


def _opt(name: str, default: object, kind: type | None = None) -> tuple[str, dict]:
    return name, {"default": default, "type": kind or (type(default) if default is not None else str)}


def _categorised(spark: SparkSession, items: str, matches: str) -> DataFrame:
    """Matches with the category of both items."""
    from matchloom.functions.similarity import pair_category

    by = io.read_items(spark, items).select("id", "category")
    a, b = (by.select(F.col("id").alias(f"id{i}"), F.col("category").alias(f"c{i}")) for i in (1, 2))
    return io.read_table(spark, matches, ("id1", "id2", "target")).join(a, "id1").join(b, "id2").withColumn("category", pair_category(F.col("c1"), F.col("c2"))).drop("c1", "c2")


def _seen(spark: SparkSession, *paths: str) -> DataFrame:
    ids = [P.endpoint_ids(io.read_table(spark, p, ("id1", "id2"))) for p in paths if p]
    out = ids[0]
    for more in ids[1:]:
        out = out.union(more)
    return out.distinct()


@command("doctor", ("--inputs", {"nargs": "+", "required": True}))
def doctor(spark: SparkSession, a: argparse.Namespace) -> dict:
    facts = io.health(spark, {p: p for p in a.inputs})
    return {"inputs": facts, "exit": 0 if all(f["exists"] for f in facts) else 2}


@command("canonicalize", "--items", "--output", _opt("--ids-from", None), _opt("--remaining-chars", 1800))
def canonicalize_items(spark: SparkSession, a: argparse.Namespace) -> dict:
    items = io.read_items(spark, a.items)
    if a.ids_from:
        items = P.only_ids(items, P.endpoint_ids(io.read_table(spark, a.ids_from, ("id1", "id2"))))
    rows = io.write_table(canonicalize(items, a.remaining_chars), a.output)
    return {"rows": rows, "parse_errors": spark.read.parquet(a.output).agg(F.sum("parse_error")).first()[0]}


@command("make-folds", "--items", "--matches", "--output", _opt("--folds", 5), _opt("--seed", 20260812))
def make_folds(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = B.with_row_id(B.component_folds(_categorised(spark, a.items, a.matches), a.folds, a.seed), "id1", "id2", "target")
    n = io.write_table(rows.withColumn("fold", F.col("fold").cast("byte")), a.output)
    out = spark.read.parquet(a.output)
    if not B.fold_leaks(out).isEmpty():
        raise ValueError("an item is in two folds")
    per = out.groupBy("fold").agg(F.count("*").alias("rows"), F.avg("target").alias("rate")).orderBy("fold").collect()
    return {"rows": n, "components": out.select("component").distinct().count(), "folds": [r.asDict() for r in per]}


@command("sample-silver", "--matches", "--output", _opt("--max-rows", 2_000_000), _opt("--seed", 20260812))
def sample_silver(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"rows": io.write_table(B.silver_sample(io.read_table(spark, a.matches, ("id1", "id2", "target")), a.max_rows, a.seed), a.output)}


_HOLDOUT = ("--items", "--matches", "--gold", _opt("--silver", None), "--output")


@command("make-novel-holdout", *_HOLDOUT, _opt("--max-rows", 100_000), _opt("--seed", 20260812))
def make_novel_holdout(spark: SparkSession, a: argparse.Namespace) -> dict:
    out = B.novel_holdout(_categorised(spark, a.items, a.matches), _seen(spark, a.gold, a.silver), a.max_rows, a.seed)
    return {"rows": io.write_table(out, a.output)}


@command("make-public-proxy", *_HOLDOUT, _opt("--max-rows-per-category", 20_000), _opt("--seed", 20260820))
def make_public_proxy(spark: SparkSession, a: argparse.Namespace) -> dict:
    out = B.natural_rate_proxy(_categorised(spark, a.items, a.matches), _seen(spark, a.gold, a.silver), a.max_rows_per_category, a.seed)
    n = io.write_table(out, a.output)
    per = spark.read.parquet(a.output).groupBy("category").agg(F.count("*").alias("rows"), F.avg("target").alias("rate")).orderBy("category").collect()
    return {"rows": n, "categories": [r.asDict() for r in per]}


@command("research-llm-diagnostics", *_HOLDOUT)
def label_diagnostics(spark: SparkSession, a: argparse.Namespace) -> dict:
    out = B.label_slices(_categorised(spark, a.items, a.matches), _seen(spark, a.gold, a.silver))
    return {"rows": io.write_table(out, a.output)}


@command("prepare-pairs", "--items", "--pairs", "--output", ("--text-only", {"action": "store_true"}), ("--profile", {"choices": tuple(K.PROFILES), "default": None}))
def prepare_pairs(spark: SparkSession, a: argparse.Namespace) -> dict:
    items, pairs = spark.read.parquet(a.items), io.read_table(spark, a.pairs, ("id1", "id2"))
    if "name_norm" not in items.columns:
        items = canonicalize(items)
    missing = P.missing_ids(pairs, items).count()
    if missing:
        raise ValueError(f"{missing} ids of pairs are missing")
    if "row_id" not in pairs.columns:
        pairs = B.with_row_id(pairs, "id1", "id2")
    rows, wanted = io.write_table(P.prepare_pairs(pairs, items, a.text_only, a.profile), a.output), pairs.count()
    if rows != wanted:
        raise ValueError(f"{rows} rows for {wanted} pairs: item ids repeat")
    return {"rows": rows}


@command("prepare-novel-holdout", "--items", "--holdout", "--output", ("--profile", {"choices": tuple(K.PROFILES), "default": None}))
def prepare_holdout(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A holdout's own items made canonical and its pairs prepared; with a profile all items are, as its statistics cover them."""
    pairs, items = io.read_table(spark, a.holdout, ("id1", "id2", "row_id")), io.read_items(spark, a.items)
    canonical = materialize(canonicalize(items if a.profile else P.only_ids(items, P.endpoint_ids(pairs))), "holdout-items")
    missing = P.missing_ids(pairs, canonical).count()
    if missing:
        raise ValueError(f"{missing} ids of pairs are missing")
    return {"rows": io.write_table(P.prepare_pairs(pairs, canonical, profile=a.profile), a.output)}


@command("score-pairs", "--pairs", "--output", _opt("--fold", None, int))
def score(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The stand-in scorer; a trained one is passed to ``operators.scoring.score_pairs``."""
    return {"rows": io.write_table(scoring.score_pairs(io.read_table(spark, a.pairs, ("row_id", "text_a", "text_b")), scoring.token_overlap_scorer, a.fold), a.output)}


def _with_scores(spark: SparkSession, gold: str, **scores: str) -> DataFrame:
    rows = io.read_table(spark, gold, ("row_id", "id1", "id2", "target", "category"))
    for name, path in scores.items():
        rows = R.strict_score_join(rows, io.read_table(spark, path, ("row_index", "id1", "id2", "text_score")).select("row_index", "id1", "id2", "text_score")).withColumnRenamed("text_score", name)
    return rows


@command("mine-hard-negatives", "--gold", "--oof", "--output", _opt("--top-fraction", 0.15), _opt("--fold", None, int))
def mine(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _with_scores(spark, a.gold, score=a.oof)
    return {"rows": io.write_table(B.hard_negatives(rows, a.top_fraction, "score", a.fold).select("row_id"), a.output)}


@command("materialize-augmentation", ("--kind", {"choices": ("attribute-dropout", "hard-identifiers", "attribute-permutation"), "required": True}), "--pairs", "--output", _opt("--items", None), _opt("--seed", 20260812),
         _opt("--min-identifier-idf", 0.70), _opt("--min-lcp-fraction", 0.50), _opt("--max-rows", 4066), _opt("--probability", 0.5))
def augment(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = io.read_table(spark, a.pairs, ("row_id", "id1", "id2", "target", "category", "fold", "text_a", "text_b"))
    if "is_synthetic" in rows.columns and not rows.where("is_synthetic").isEmpty():
        raise ValueError("augmentation starts from real rows")
    if a.kind == "attribute-dropout":
        out = A.attribute_dropout(rows, a.seed)
    elif a.kind == "attribute-permutation":
        out = A.attribute_permutation(rows, a.probability, a.seed)
    else:
        made = A.hard_identifier_negatives(rows, spark.read.parquet(a.items), a.min_identifier_idf, a.min_lcp_fraction, a.max_rows)
        real = rows.withColumns({"is_synthetic": F.lit(False), "source_row_id": F.lit(None).cast("long")})
        out = real.unionByName(made, allowMissingColumns=True)
    return {"rows": io.write_table(out, a.output)}


_COMPARE = ("--gold", "--control", "--candidate", _opt("--samples", 1000), _opt("--seed", 20260812))


@command("research-compare", *_COMPARE)
def compare(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _with_scores(spark, a.gold, control=a.control, candidate=a.candidate)
    g = G.compare(rows, samples=a.samples, seed=a.seed)
    return {"control": g.control, "candidate": g.candidate, "difference": g.difference, "ci95_low": g.ci95_low, "ci95_high": g.ci95_high, "positive_rate": g.positive_rate}


@command("research-assess-candidate", *_COMPARE)
def assess(spark: SparkSession, a: argparse.Namespace) -> dict:
    g = G.compare(_with_scores(spark, a.gold, control=a.control, candidate=a.candidate), samples=a.samples, seed=a.seed)
    return {"verdict": g.verdict, "passed": g.passed, "worst_category": g.worst_category, "worst_difference": g.worst_difference, "reasons": list(g.reasons), "difference": g.difference}


@command("research-diagnose-scores", "--gold", "--oof", "--final", _opt("--top-fraction", 0.01))
def diagnose(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _with_scores(spark, a.gold, oof=a.oof, final=a.final)
    rank = M.spearman(rows, "oof", "final", ["category"]).join(M.top_overlap(rows, "oof", "final", "row_id", ["category"], a.top_fraction), "category")
    profiles = {s: M.quantile_profile(rows, s).first().asDict() for s in ("oof", "final")}
    return {"categories": [r.asDict() for r in rank.orderBy("category").collect()], "profiles": profiles}


@command("research-proxy-shift", "--pairs", ("--features", {"nargs": "+", "required": True}), _opt("--source", "source"), _opt("--cap", 1000), _opt("--least", 100), _opt("--seed", 20260812))
def shift(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Covariate shift between the two sources of a prepared pair table, over their common categories."""
    rows = io.read_table(spark, a.pairs, ("id1", "id2", "category", a.source, *a.features)).withColumnRenamed(a.source, "source")
    quotas = B.common_category_quotas(rows, a.cap, a.least)
    rows = rows.join(quotas, "category")
    rows = B.stratified(rows, ["category", "source"], F.col("take"), ["id1", "id2"], a.seed)
    one, two = sorted(r["source"] for r in rows.select("source").distinct().collect())
    support = M.support_summary(rows, a.features, "source", one, two)
    overlap = {f: M.histogram_overlap(rows, f, "source").first()["overlap"] for f in a.features}
    return {"sources": [one, two], "support": [r.asDict() for r in support.collect()], "overlap": overlap, "auc": X.two_sample_auc(rows, a.features, "source", two)}


@command("research-graph-diagnostics", "--gold", "--scores")
def graph_diagnostics(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = B.degree_stats(_with_scores(spark, a.gold, score=a.scores)).withColumn("part", F.when(F.col("isolated"), "isolated").otherwise("connected"))
    ap = {r["part"]: r["ap"] for r in M.average_precision(rows, ["part"]).collect()}
    counts = rows.agg(F.count("*").alias("edges"), F.sum(F.col("isolated").cast("int")).alias("isolated"), F.max(F.greatest("degree1", "degree2")).alias("most")).first()
    return counts.asDict() | {"average_precision": ap}


@command("train-fusion", "--pairs", "--oof", "--output", ("--depths", {"nargs": "+", "type": int, "default": [4]}), ("--rates", {"nargs": "+", "type": float, "default": [0.1]}), _opt("--trees", 20), ("--ranked", {"action": "store_true"}))
def train_fusion(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _with_scores(spark, a.pairs, text_score=a.oof)
    if a.ranked:
        rows = R.percentile_rank(rows, "text_score", ("fold", "category")).drop("text_score")
    facts, out, model = X.train_oof(rows, tuple(a.depths), tuple(a.rates), a.trees)
    io.write_table(out.select("row_id", "id1", "id2", "target", "fold", "category", "score"), f"{a.output}/oof")
    model.write().overwrite().save(f"{a.output}/model")
    return facts


@command("research-diagnose-fusion-shift", "--pairs", "--oof", "--final", "--model", _opt("--top-fraction", 0.01))
def diagnose_fusion(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _with_scores(spark, a.pairs, oof=a.oof, final=a.final)
    model = PipelineModel.load(a.model)
    names = model.stages[0].getInputCols()
    return {"shift": [r.asDict() for r in X.fusion_shift(model, rows, names, "oof", "final", fraction=a.top_fraction).orderBy("what", "slice").collect()]}


@command("evaluate-holdout", "--pairs", "--text", "--hybrid", _opt("--public-macro-ap", 0.3664957802653864))
def evaluate_holdout(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _with_scores(spark, a.pairs, text=a.text, hybrid=a.hybrid)
    ap = {s: M.macro_average_precision(rows, score=s).first()["macro_ap"] for s in ("text", "hybrid")}
    mode = G.score_mode(ap["text"], ap["hybrid"])
    return ap | {"mode": mode, "may_submit": G.may_submit(ap[mode], a.public_macro_ap)}


@command("build-submission", ("--members", {"nargs": "+", "required": True, "help": "name=local path"}), "--output")
def build_submission(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"members": archive.write_archive(dict(x.split("=", 1) for x in a.members), a.output)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    top.add_argument("--report", help="also write the result to this JSON file")
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = subs.add_parser(name)
        for option, settings in options:
            sub.add_argument(option, **settings)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("matchloom").config(map=SETTINGS).getOrCreate()
    ship(spark)
    result = COMMANDS[a.command][0](spark, a)
    print(json.dumps(result, ensure_ascii=False, indent=2, default=str))
    if a.report:
        io.write_report(result, a.report)
    return int(result.get("exit", 0))


if __name__ == "__main__":
    sys.exit(main())
