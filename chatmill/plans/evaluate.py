"""Reports on predictions: against gold answers, against assertions, and the retest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.functions.text import preview
from chatmill.operators import ranking, scoring
from chatmill.operators.scoring import pct
from chatmill.session import materialise


@dataclass
class EvalReport:
    cases: DataFrame
    summary: DataFrame
    fields: DataFrame
    samples: DataFrame
    unreadable: DataFrame


@dataclass
class BacktestReport:
    cases: DataFrame
    summary: DataFrame
    outcomes: DataFrame
    fields: DataFrame
    confusion: DataFrame
    running: DataFrame


def eval_report(gold: DataFrame, predictions: DataFrame, samples: int = 5) -> EvalReport:
    """Score once into the shared folder (short columns only), then report from there."""
    scored = materialise(scoring.score_fields(gold, predictions, preview_of=preview))
    return EvalReport(
        scored,
        scoring.pass_summary(scored, F.col("outcome") == "passed"),
        scoring.field_accuracy(scored),
        scoring.failure_samples(scored, samples),
        scored.where(F.col("outcome") == "no_json").select("case_id", "raw_len", "raw_preview"),
    )


def running_pass_rate(scored: DataFrame) -> DataFrame:
    """``(case_pos, done, passed_so_far, running_pct)`` in case order."""
    rows = scored.select("case_pos", F.col("passed").cast("int").alias("_passed"))
    totals = ranking.running_totals(
        rows, "case_pos", {"done": F.lit(1), "passed_so_far": F.col("_passed")}
    )
    return totals.select(
        "case_pos", "done", "passed_so_far", pct(F.col("passed_so_far"), F.col("done")).alias("running_pct")
    )


def narrow_scores(cases: DataFrame) -> DataFrame:
    """Scored cases without their long input and raw output."""
    scored = scoring.score_asserts(cases)
    return scored.select(
        "case_pos",
        "name",
        "gold_class",
        "passed",
        "checks",
        scoring.outcome(scored).alias("outcome"),
    )


def backtest_report(cases: DataFrame) -> BacktestReport:
    """Score once into the shared folder (short columns only), then report from there."""
    scored = materialise(narrow_scores(cases))
    return BacktestReport(
        scored,
        scoring.pass_summary(scored, F.col("passed")),
        scored.groupBy("outcome").agg(F.count(F.lit(1)).alias("cases")),
        scoring.leaf_accuracy(scored),
        scoring.class_pairs(scored),
        running_pass_rate(scored),
    )


def retest_report(cases: DataFrame, raw: str = "raw_output", expected: str = "expected") -> DataFrame:
    """PASS / FAIL / ERROR counts."""
    scored = scoring.score_retest(cases, raw, expected)
    return scored.groupBy("outcome").agg(F.count(F.lit(1)).alias("cases"))
