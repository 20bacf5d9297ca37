"""Plan teacher work for seeds and gate the labelled variants that come back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.functions.answers import patch_json, read_answer
from chatmill.functions.text import first_fence, or_empty
from chatmill.operators.chat import WHOLE, canonical, record_text
from chatmill.operators.markers import flag_containing
from chatmill.operators.scoring import CLASS_PATH


@dataclass
class Gated:
    data: DataFrame
    summary: DataFrame


def work_list(
    seeds: DataFrame,
    markers: DataFrame,
    normal: int = 4,
    failure: int = 12,
) -> DataFrame:
    """``(rec_id, is_failure, n_variants)``: seeds with a marker anywhere in the record get more variants."""
    flagged = flag_containing(seeds, record_text(seeds), markers, "is_failure")
    return flagged.select(
        "rec_id", "is_failure", F.when(F.col("is_failure"), failure).otherwise(normal).alias("n_variants")
    )


def gate(variants: DataFrame, seeds: DataFrame, keep_label: bool = False) -> DataFrame:
    """``outcome`` of every variant, also of those without a seed or of an unreadable one.

    Seeds and labels are read down to their class before the join, so only short
    columns are shuffled unless the texts themselves are asked for.  A seed with
    a large share of all variants makes a skewed join, which the adaptive planner
    splits on the variants' side.
    """
    system = ["system"] if keep_label else []
    seed_side = (
        seeds.select(
            F.col("rec_id").alias("seed_id"),
            *system,
            read_answer(F.col("answer"), [CLASS_PATH], "strict").alias("s"),
        )
        .select("seed_id", *system, F.col("s.ok").alias("_seed_ok"), F.col("s.vals")[0].alias("seed_class"))
    )
    label = F.col("label_text")
    no_text = or_empty(F.col("variant_text")) == ""
    extra = [F.col("variant_text"), label] if keep_label else []
    variant_side = variants.select(
        "seed_id",
        "variant",
        no_text.alias("_no_text"),
        (first_fence(label) == "null").alias("_null_label"),
        read_answer(F.when(~no_text, label), [CLASS_PATH], "label").alias("l"),
        *extra,
    ).select(
        "seed_id", "variant", "_no_text",
        (~F.col("l.ok") | F.coalesce("_null_label", F.lit(False))).alias("_no_label"),
        F.col("l.vals")[0].alias("variant_class"),
        *[c for c in ("variant_text", "label_text") if keep_label],
    )
    outcome = (
        F.when(F.col("_seed_ok").isNull(), "no_seed")
        .when(~F.col("_seed_ok"), "seed_invalid")
        .when(F.col("_no_text"), "paraphrase_failed")
        .when(F.col("_no_label"), "label_failed")
        .when(~F.col("variant_class").eqNullSafe(F.col("seed_class")), "drift")
        .otherwise("kept")
    )
    return variant_side.join(seed_side, "seed_id", "left").withColumn("outcome", outcome).drop(
        "_no_text", "_no_label", "_seed_ok"
    )


def valid_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds whose answer is readable; the others are skipped wholly."""
    return (
        seeds.withColumn("_s", read_answer(F.col("answer"), [], "strict"))
        .where("_s.ok")
        .drop("_s")
    )


def outcome_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def synth_gate(variants: DataFrame, seeds: DataFrame) -> Gated:
    """The whole job: originals of valid seeds, whole as they are, plus variants that kept their class."""
    made = canonical(F.col("system"), F.col("user_text"), F.col("answer"))
    whole = [c for c in WHOLE if c in seeds.columns]
    originals = valid_seeds(seeds).select(
        F.col("rec_id").alias("seed_id"),
        F.lit(0).alias("variant"),
        (F.col("messages") if "messages" in whole else made).alias("messages"),
        *[c for c in whole if c == "raw"],
    )
    kept = gate(variants, seeds, keep_label=True).where(F.col("outcome") == "kept")
    no_edits = F.array().cast("array<struct<path: string, value: string>>")
    label = patch_json(first_fence(F.col("label_text")), no_edits, "indented")
    new = kept.select(
        "seed_id",
        "variant",
        canonical(F.col("system"), F.col("variant_text"), label).alias("messages"),
    )
    counted = outcome_counts(gate(variants, seeds))
    seeds_kept = originals.select(F.lit("original").alias("outcome")).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n")
    )
    return Gated(originals.unionByName(new, allowMissingColumns=True), counted.unionByName(seeds_kept))
