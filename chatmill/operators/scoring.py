"""Scoring answers.  A case is scored inside its own row; only counts are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.answers import read_answer
from chatmill.functions.asserts import gold_class, parse_asserts
from chatmill.functions.text import or_empty, strip

# The scored fields and the path of the class label.
CORE_PATHS = [
    "$.extracted_data.document_classification",
    "$.extracted_data.service_type",
    "$.extracted_data.case_specific_fields.case_type_pre_service",
    "$.extracted_data.case_specific_fields.case_type_post_service",
    "$.extracted_data.case_specific_fields.case_type_grievance",
    "$.extracted_data.case_specific_fields.type_of_issue",
    "$.extracted_data.manual_review",
]
CLASS_PATH = "extracted_data.document_classification"
ERROR_PREFIX = "ERROR:"


def answer_class(text: Column, mode: str = "strict", path: str = CLASS_PATH) -> Column:
    """Class label of an answer, null when absent or unreadable."""
    return read_answer(text, [path], mode)["vals"][0]


def pct(part: Column, whole: Column) -> Column:
    """Percentage, null for an empty whole."""
    return F.when(whole > 0, part * F.lit(100.0) / whole)


# -- against a gold answer -------------------------------------------------------------


def score_fields(
    gold: DataFrame, predictions: DataFrame, paths: Sequence[str] = CORE_PATHS, preview_of=None
) -> DataFrame:
    """One row per gold case: ``outcome`` and the compared fields.

    Both sides are reduced to the scored fields before the join, so answers and
    raw outputs, which may be long, are never shuffled.  Values are compared as
    text, untrimmed; null, missing and empty are equal.
    """
    paths = list(paths)
    gold_side = gold.select(
        "case_id", read_answer(F.col("gold"), paths, "strict").alias("g")
    ).select("case_id", F.col("g.ok").alias("gold_ok"), F.col("g.vals").alias("gold_vals"))
    raw = F.col("raw_output")
    failed = raw.isNull() | raw.startswith(ERROR_PREFIX)
    read = read_answer(F.when(~failed, raw), paths, "clean")
    extra = [] if preview_of is None else [F.when(~F.col("p.ok") & ~F.col("errored"), preview_of(raw)).alias("raw_preview")]
    pred_side = (
        predictions.select("case_id", "raw_output", failed.alias("errored"), read.alias("p"))
        .select(
            "case_id",
            "errored",
            F.when(F.col("errored"), raw).alias("error"),
            F.length(raw).alias("raw_len"),
            F.col("p.ok").alias("pred_ok"),
            F.col("p.vals").alias("pred_vals"),
            *extra,
        )
    )
    joined = gold_side.join(pred_side, "case_id", "left")
    fields = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(path).alias("path"),
                or_empty(F.col("gold_vals")[i]).alias("gold"),
                or_empty(F.col("pred_vals")[i]).alias("pred"),
                (or_empty(F.col("gold_vals")[i]) == or_empty(F.col("pred_vals")[i])).alias("match"),
            )
            for i, path in enumerate(paths)
        ]
    )
    all_match = F.forall("fields", lambda f: f["match"])
    outcome = (
        F.when(~F.col("gold_ok"), "gold_invalid")
        .when(F.coalesce("errored", F.lit(True)), "error")
        .when(~F.col("pred_ok"), "no_json")
        .when(all_match, "passed")
        .otherwise("failed")
    )
    return joined.withColumn("fields", fields).withColumn("outcome", outcome).drop(
        "gold_vals", "pred_vals"
    )


def long_scores(scored: DataFrame) -> DataFrame:
    """``(case_id, path, gold, pred, match)`` of the readable cases."""
    readable = scored.where(F.col("outcome").isin("passed", "failed"))
    return readable.select("case_id", F.inline("fields")).drop("pos")


def field_accuracy(scored: DataFrame) -> DataFrame:
    """Correct, total and percentage per scored path over readable cases."""
    counts = long_scores(scored).groupBy("path").agg(
        F.count_if("match").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("pct", pct(F.col("correct"), F.col("total")))


def pass_summary(scored: DataFrame, passed: Column) -> DataFrame:
    """Cases, passed, failed, percentage; every case counts in the denominator."""
    cases, won = F.count(F.lit(1)), F.count_if(passed)
    return scored.agg(cases.alias("cases"), won.alias("passed")).select(
        "cases",
        "passed",
        (F.col("cases") - F.col("passed")).alias("failed"),
        pct(F.col("passed"), F.col("cases")).alias("pct"),
    )


def failure_samples(scored: DataFrame, n: int = 5) -> DataFrame:
    """Failing fields of the first ``n`` failed cases."""
    first = scored.where(F.col("outcome") == "failed").orderBy("case_id").limit(n)
    wrong = F.filter("fields", lambda f: ~f["match"])
    return first.select("case_id", F.inline(wrong)).drop("pos", "match")


# -- against assertions ----------------------------------------------------------------


def score_asserts(
    cases: DataFrame, output: str = "output", skip_errors: bool = True, keep_json: bool = False
) -> DataFrame:
    """Add ``gold_class, pred_ok, pred_json, checks, passed`` to assertion cases.

    Values are compared as trimmed text.  A case passes when its output was
    readable and every assertion holds; a case without assertions passes.
    """
    raw = F.col(output)
    usable = F.when(~raw.startswith(ERROR_PREFIX), raw) if skip_errors else raw
    parsed = cases.withColumn("_asserts", parse_asserts(F.col("asserts")))
    paths = F.transform("_asserts", lambda a: a["path"])
    read = parsed.withColumn("_read", read_answer(usable, paths, "raw", keep_json))
    checks = F.zip_with(
        "_asserts",
        "_read.vals",
        lambda a, v: F.struct(
            a["pos"].alias("pos"),
            a["path"].alias("path"),
            a["expected"].alias("expected"),
            or_empty(v).alias("actual"),
            (strip(or_empty(v)) == strip(a["expected"])).alias("match"),
        ),
    )
    return (
        read.withColumns(
            {
                "gold_class": gold_class(F.col("_asserts")),
                "pred_ok": F.col("_read.ok"),
                "pred_json": F.col("_read.json"),
                "checks": checks,
            }
        )
        .withColumn("passed", F.col("pred_ok") & F.forall("checks", lambda c: c["match"]))
        .drop("_asserts", "_read")
    )


def leaf_accuracy(scored: DataFrame) -> DataFrame:
    """Correct and total per last path segment over all assertions."""
    checks = scored.select(F.inline("checks"))
    return (
        checks.groupBy(F.element_at(F.split("path", r"\."), -1).alias("field"))
        .agg(F.count_if("match").alias("correct"), F.count(F.lit(1)).alias("total"))
        .withColumn("pct", pct(F.col("correct"), F.col("total")))
    )


def class_pairs(scored: DataFrame, name: str = "document_classification") -> DataFrame:
    """Counts of (gold, predicted) class, non-zero cells only."""
    named = F.filter("checks", lambda c: c["path"].contains(name))
    pairs = scored.select(F.inline(named)).select(
        F.col("expected").alias("gold"), F.col("actual").alias("pred")
    )
    return pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every (gold, predicted) cell over a given list of labels, zeros shown.

    Predicted labels are free text, so the caller says which ones make the grid;
    cells of other labels stay in ``pairs``.
    """
    spark = pairs.sparkSession
    axis = spark.createDataFrame([(x,) for x in dict.fromkeys(labels)], "label string")
    every = F.array(*[F.lit(x) for x in dict.fromkeys(labels)])
    grid = axis.select(F.col("label").alias("gold"), F.explode(every).alias("pred"))
    return grid.join(pairs, ["gold", "pred"], "left").select(
        "gold", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def outcome(scored: DataFrame, output: str = "output") -> Column:
    """``inference_error``, ``unparseable``, ``passed`` or ``failed``."""
    return (
        F.when(F.col(output).startswith(ERROR_PREFIX), "inference_error")
        .when(~F.col("pred_ok"), "unparseable")
        .when(F.col("passed"), "passed")
        .otherwise("failed")
    )


MARKS = {"passed": "✓", "failed": "✗", "unparseable": "?", "inference_error": "?"}


def outcome_counts(scored: DataFrame, output: str = "output") -> DataFrame:
    """Cases per outcome with the report's mark."""
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    return (
        scored.groupBy(outcome(scored, output).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("cases"))
        .withColumn("mark", F.element_at(mark, F.col("outcome")))
    )


# -- retest ----------------------------------------------------------------------------


def score_retest(cases: DataFrame, raw: str = "raw_output", expected: str = "expected") -> DataFrame:
    """``outcome`` PASS / FAIL / ERROR per case from a map of expected values.

    A field is looked up in the extracted data, then among the case-specific
    fields; falsy values fall through.  Compared trimmed and without case.
    """
    fields = F.map_keys(expected)
    paths = F.concat(
        F.transform(fields, lambda f: F.concat(F.lit("extracted_data."), f)),
        F.transform(fields, lambda f: F.concat(F.lit("extracted_data.case_specific_fields."), f)),
    )
    read = cases.withColumn("_fields", fields).withColumn(
        "_read", read_answer(F.col(raw), paths, "retest", drop_falsy=True)
    )
    size = F.size("_fields")

    def holds(field: Column, i: Column) -> Column:
        top, nested = F.col("_read.vals")[i], F.col("_read.vals")[i + size]
        got = F.coalesce(top, nested, F.lit(""))
        return F.lower(strip(got)) == F.lower(strip(F.col(expected)[field]))

    matches = F.transform("_fields", holds)
    result = (
        F.when(~F.col("_read.ok"), "ERROR")
        .when(F.forall(matches, lambda m: m), "PASS")
        .otherwise("FAIL")
    )
    return read.withColumn("outcome", result).drop("_fields", "_read")
