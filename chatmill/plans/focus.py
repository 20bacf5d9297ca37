"""Build a focused correction set from assertion-scored cases."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.answers import patch_json
from chatmill.functions.asserts import gold_class, parse_asserts
from chatmill.operators import ranking, scoring
from chatmill.operators.chat import canonical
from chatmill.plans.augment import variants
from chatmill.session import materialise

FAILURE_CLASS = "Pre-Service Appeal"
# Per class the fields set or cleared in a corrected answer, in order.
CLASS_DEFAULTS: dict[str, list[tuple[str, str]]] = {
    "Pre-Service Appeal": [
        ("extracted_data.service_type", "Pre-Service"),
        ("extracted_data.case_specific_fields.case_type_post_service", ""),
        ("extracted_data.case_specific_fields.case_type_grievance", ""),
        ("extracted_data.case_specific_fields.type_of_issue", ""),
    ],
    "Post-Service Appeal": [
        ("extracted_data.service_type", "Post-Service"),
        ("extracted_data.case_specific_fields.case_type_pre_service", ""),
        ("extracted_data.case_specific_fields.case_type_grievance", ""),
        ("extracted_data.case_specific_fields.type_of_issue", ""),
    ],
    "Grievance": [
        ("extracted_data.service_type", ""),
        ("extracted_data.case_specific_fields.case_type_pre_service", ""),
        ("extracted_data.case_specific_fields.case_type_post_service", ""),
    ],
    "Provider Dispute": [
        ("extracted_data.service_type", ""),
        ("extracted_data.case_specific_fields.case_type_pre_service", ""),
        ("extracted_data.case_specific_fields.case_type_post_service", ""),
        ("extracted_data.case_specific_fields.case_type_grievance", ""),
        ("extracted_data.case_specific_fields.type_of_issue", ""),
    ],
    "Inquiry": [
        ("extracted_data.service_type", ""),
        ("extracted_data.case_specific_fields.case_type_pre_service", ""),
        ("extracted_data.case_specific_fields.case_type_post_service", ""),
        ("extracted_data.case_specific_fields.case_type_grievance", ""),
        ("extracted_data.case_specific_fields.type_of_issue", ""),
    ],
}
NO_ANSWER = '{"extracted_data": {}}'
_EDITS = "array<struct<path: string, value: string>>"


@dataclass
class Focused:
    data: DataFrame
    summary: DataFrame


def categorise(
    cases: DataFrame, failure_class: str = FAILURE_CLASS, keep_json: bool = False
) -> DataFrame:
    """Scored cases with ``category``: anchor, failure, discarded or ignored (no gold class)."""
    scored = scoring.score_asserts(cases, skip_errors=False, keep_json=keep_json)
    category = (
        F.when(F.col("gold_class").isNull(), "ignored")
        .when(F.col("passed"), "anchor")
        .when(F.col("gold_class") == failure_class, "failure")
        .otherwise("discarded")
    )
    return scored.withColumn("category", category)


def _gold() -> Column:
    """Gold class straight from the assertion cell: a native test made before any parsing."""
    return gold_class(parse_asserts(F.col("asserts")))


def failures(cases: DataFrame, failure_class: str = FAILURE_CLASS) -> DataFrame:
    """Scored failures of one class; outputs of other classes are not even read."""
    scored = categorise(cases.where(_gold() == failure_class), failure_class, keep_json=True)
    return scored.where(F.col("category") == "failure")


def anchors(cases: DataFrame, per_class: int = 6, failure_class: str = FAILURE_CLASS) -> DataFrame:
    """``(gold_class, case_pos, row_no)`` of the first K passing cases of each class.

    Ranks two short columns; each map task hands on at most K rows per class.
    """
    scored = categorise(cases.where(_gold().isNotNull()), failure_class)
    narrow = scored.where(F.col("category") == "anchor").select("gold_class", "case_pos")
    return ranking.top_per_group(narrow, ["gold_class"], [F.col("case_pos")], per_class)


def anchor_cases(
    cases: DataFrame, per_class: int = 6, failure_class: str = FAILURE_CLASS
) -> DataFrame:
    """``(case_pos, gold_class, input, answer, row_no)`` of the anchors, materialised.

    Positions are chosen on short columns; only the chosen cases, K per class,
    are read again for their text and answer.
    """
    chosen = materialise(anchors(cases, per_class, failure_class).select("case_pos", "row_no"))
    winners = cases.join(chosen, "case_pos")
    scored = scoring.score_asserts(winners, skip_errors=False, keep_json=True)
    return materialise(
        scored.select("case_pos", "gold_class", "input", F.col("pred_json").alias("answer"), "row_no")
    )


def donors(anchor_table: DataFrame) -> DataFrame:
    """``(gold_class, donor)``: the first passing prediction of each class."""
    return anchor_table.where(F.col("row_no") == 1).select(
        "gold_class", F.col("answer").alias("donor")
    )


def with_base(scored: DataFrame, donor_table: DataFrame) -> DataFrame:
    """Add ``base``: the case's own prediction, else its class's donor, else an empty answer."""
    joined = scored.join(donor_table, "gold_class", "left")
    return joined.withColumn("base", F.coalesce("pred_json", "donor", F.lit(NO_ANSWER))).drop("donor")


def default_edits(gold: Column, defaults: Mapping[str, list[tuple[str, str]]] = CLASS_DEFAULTS) -> Column:
    """Edits of a class as an array; empty for a class without defaults."""
    table = {c: [{"path": p, "value": v} for p, v in pairs] for c, pairs in defaults.items()}
    constant = F.from_json(F.lit(json.dumps(table)), f"map<string, {_EDITS}>")
    return F.coalesce(F.try_element_at(constant, gold), F.array().cast(_EDITS))


def corrected(
    failing: DataFrame,
    donor_table: DataFrame,
    defaults: Mapping[str, list[tuple[str, str]]] = CLASS_DEFAULTS,
) -> DataFrame:
    """Add ``corrected``: base answer, class defaults, then the case's assertions; later wins."""
    asserted = F.transform(
        "checks", lambda c: F.struct(c["path"].alias("path"), c["expected"].alias("value"))
    )
    based = with_base(failing, donor_table)
    edits = F.concat(default_edits(F.col("gold_class"), defaults), asserted)
    return based.withColumn("corrected", patch_json(F.col("base"), edits)).drop("base")


def focus(
    cases: DataFrame,
    system: str,
    failure_class: str = FAILURE_CLASS,
    per_failure: int = 40,
    per_anchor: int = 15,
    anchors_per_class: int = 6,
    noise: float = 0.003,
    seed: int = 42,
    defaults: Mapping[str, list[tuple[str, str]]] = CLASS_DEFAULTS,
) -> Focused:
    """The whole job over ``(case_pos, name, input, asserts, output)``.

    Failures are decided and corrected in their own row.  Anchors are few (K per
    class): their positions are chosen first and only those cases read again.
    """
    table = anchor_cases(cases, max(anchors_per_class, 1), failure_class)
    donor_table = donors(table).where(F.col("gold_class") == failure_class)
    fixed = corrected(failures(cases, failure_class), donor_table, defaults).select(
        "case_pos", "input", F.lit("failure").alias("kind"), F.col("gold_class").alias("cls"),
        F.col("corrected").alias("answer"),
    )
    kept = table.where(F.col("row_no") <= anchors_per_class).select(
        "case_pos", "input", F.lit("anchor").alias("kind"), F.col("gold_class").alias("cls"),
        patch_json(F.col("answer"), F.array().cast(_EDITS)).alias("answer"),
    )
    seeds = fixed.unionByName(kept).select(
        F.col("case_pos").alias("rec_id"),
        "kind",
        "cls",
        F.coalesce("input", F.lit("")).alias("user_text"),
        "answer",
        F.lit(True).alias("answer_ok"),
    )
    count = F.when(F.col("kind") == "failure", per_failure).otherwise(per_anchor)
    made = variants(seeds, count, seed, noise)
    data = made.select(
        "rec_id", "kind", "cls", "variant",
        canonical(system.strip(), F.col("user_text"), F.col("answer")).alias("messages"),
    )
    return Focused(data, summary(seeds, count))


def summary(seeds: DataFrame, n_variants: Column) -> DataFrame:
    """Per class: records, failure seeds and anchor seeds; all variants of a seed are kept, so none is made here."""
    return seeds.groupBy("cls").agg(
        F.sum(n_variants + 1).cast("long").alias("records"),
        F.count_if(F.col("kind") == "failure").alias("failure_seeds"),
        F.count_if(F.col("kind") == "anchor").alias("anchor_seeds"),
    )
