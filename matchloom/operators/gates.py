"""Acceptance gates: aggregates in Spark, verdicts on the driver from one row each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import metrics as M
from matchloom.operators import ranking as R
from matchloom.plans.durable import materialize

# Limits of the gates.
LEAST_GAIN, WORST_DROP, REGRESSION, SUBMISSION_MARGIN, MODE_MARGIN = 0.002, 0.02, -0.005, 0.05, 0.002


@dataclass(frozen=True)
class Gate:
    verdict: str
    passed: bool
    control: float
    candidate: float
    worst_category: str
    worst_difference: float
    ci95_low: float
    ci95_high: float
    positive_rate: float
    reasons: tuple[str, ...] = field(default=())

    @property
    def difference(self) -> float:
        return self.candidate - self.control


def compare(rows: DataFrame, control: str = "control", candidate: str = "candidate", samples: int = 300, seed: int = 20260812) -> Gate:
    """The graded out-of-fold gate: a regression, an improvement, or inconclusive and passed."""
    if samples < 10:
        raise ValueError("samples must be at least 10")
    one = M.average_precision(rows, ["category"], score=control).select("category", F.col("ap").alias("a"), "positives")
    two = M.average_precision(rows, ["category"], score=candidate).select("category", F.col("ap").alias("b"))
    per = one.join(two, "category").collect()  # a row a category
    if any(r["positives"] == 0 for r in per):
        raise ValueError("a category has no positive examples")
    a, b = (sum(r[x] for r in per) / len(per) for x in ("a", "b"))
    worst = min(per, key=lambda r: (r["b"] - r["a"], r["category"]))
    spread = M.bootstrap_summary(M.paired_bootstrap(rows, control, candidate, samples=samples, seed=seed)).first()
    drop = worst["b"] - worst["a"]
    reasons = []
    if drop < -WORST_DROP:
        reasons.append(f"category {worst['category']} drops by {-drop:.5f}")
    if b - a < REGRESSION:
        reasons.append(f"macro average precision falls by {a - b:.5f}")
    verdict = "regression" if reasons else "improvement" if b - a >= LEAST_GAIN else "inconclusive"
    return Gate(verdict, verdict != "regression", a, b, worst["category"], drop, spread["ci95_low"], spread["ci95_high"], spread["positive_rate"], tuple(reasons))


@dataclass(frozen=True)
class Release:
    """A gate over whole score tables: macro average precisions, differences by category, and the categories that lose too much."""

    passed: bool
    rows: int
    control: float
    candidate: float
    categories: dict[str, float]
    failing: dict[str, float]
    interval: tuple[float, float] | None = None
    positive_rate: float | None = None

    @property
    def gain(self) -> float:
        return self.candidate - self.control


def _both(gold: DataFrame, control: DataFrame, candidate: DataFrame) -> DataFrame:
    """Gold rows with both scores under their row and pair keys; each table must cover them exactly, once, finite."""
    first = R.strict_score_join(gold, control).withColumnRenamed("text_score", "control")
    return materialize(R.strict_score_join(first, candidate).withColumnRenamed("text_score", "candidate"), "gate-rows")


def _precisions(rows: DataFrame, score: str) -> dict[str, float]:
    per = M.average_precision(rows, ["category"], score=score).collect()  # a row a category
    if not per or any(r["positives"] == 0 for r in per):
        raise ValueError("a category has no positive examples")
    return {r["category"]: r["ap"] for r in per}


def _differences(before: dict[str, float], after: dict[str, float], drop: float) -> tuple[float, float, dict[str, float], dict[str, float]]:
    if drop < 0:
        raise ValueError("the drop allowed is not negative")
    if before.keys() != after.keys():
        raise ValueError("both sides have the same categories")
    each = {c: after[c] - before[c] for c in sorted(before)}
    return sum(before.values()) / len(before), sum(after.values()) / len(after), each, {c: d for c, d in each.items() if d < -drop}


def ordinary_gate(gold: DataFrame, control: DataFrame, candidate: DataFrame, drop: float = WORST_DROP) -> Release:
    """Over all folds: no loss of macro average precision, and no category that loses more than ``drop``."""
    rows = _both(gold, control, candidate)
    a, b, each, failing = _differences(_precisions(rows, "control"), _precisions(rows, "candidate"), drop)
    return Release(b >= a and not failing, rows.count(), a, b, each, failing)


def fusion_gate(gold: DataFrame, control: DataFrame, candidate: DataFrame, gain: float = LEAST_GAIN, drop: float = WORST_DROP, samples: int = 1000, seed: int = 20260812, redraws: int = 100) -> Release:
    """A gain of macro average precision, a paired bootstrap interval at or above 0, and no category that loses more than ``drop``. Samples in which a category loses its positives are drawn anew."""
    if samples < 10 or gain < 0:
        raise ValueError("samples are 10 at least and the gain asked for is not negative")
    rows = _both(gold, control, candidate)
    a, b, each, failing = _differences(_precisions(rows, "control"), _precisions(rows, "candidate"), drop)
    spread = M.bootstrap_summary(M.paired_bootstrap(rows, "control", "candidate", samples=samples, seed=seed, redraws=redraws)).first()
    return Release(b - a >= gain and spread["ci95_low"] >= 0 and not failing, rows.count(), a, b, each, failing, (spread["ci95_low"], spread["ci95_high"]), spread["positive_rate"])


def stress_gate(holdout: DataFrame, baseline: dict[str, float], candidate: DataFrame, drop: float = WORST_DROP) -> Release:
    """On a frozen holdout, against average precisions by category that were reported before: a gain above 0, and no category that loses more than ``drop``. Scores of other rows are ignored."""
    keys = ["row_id", "id1", "id2"]
    named = candidate.withColumnRenamed("row_index", "row_id") if "row_index" in candidate.columns else candidate
    if not named.groupBy("row_id").count().where("count > 1").isEmpty():
        raise ValueError("a row has two scores")
    rows = materialize(R.strict_score_join(holdout, named.join(holdout.select(*keys), keys, "left_semi")), "stress-rows")
    a, b, each, failing = _differences(baseline, _precisions(rows, "text_score"), drop)
    return Release(b > a and not failing, rows.count(), a, b, each, failing)


def combined_gate(ordinary: Release, stress: Release) -> bool:
    return ordinary.passed and stress.passed


def ordinary(gate: Gate) -> bool:
    return gate.difference >= 0


def stress(gate: Gate) -> bool:
    return gate.difference > 0


def paired_fusion(gate: Gate) -> bool:
    """Enough gain, an interval at or above zero, and no category that loses."""
    return gate.difference >= LEAST_GAIN and gate.ci95_low >= 0 and gate.worst_difference >= 0


def combined(ordinary_gate: Gate, stress_gate: Gate) -> bool:
    return ordinary(ordinary_gate) and stress(stress_gate)


def score_mode(text: float, hybrid: float, margin: float = MODE_MARGIN) -> str:
    return "hybrid" if hybrid - text >= margin else "text"


def may_submit(selected: float, public: float, margin: float = SUBMISSION_MARGIN) -> bool:
    return selected > public + margin
