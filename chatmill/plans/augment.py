"""Fan records out into repeatable placeholder-substituted, noisy variants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions import placeholders as ph
from chatmill.functions.answers import json_ok, read_answer
from chatmill.functions.noise import add_noise
from chatmill.operators.chat import WHOLE, canonical, original_or
from chatmill.operators.scoring import CLASS_PATH

# Classes whose records get more variants.
PRIORITY_CLASSES = ("Pre-Service Appeal", "Provider Dispute")
UNKNOWN = "(unknown)"


@dataclass
class Augmented:
    data: DataFrame
    by_class: DataFrame


def with_class(records: DataFrame) -> DataFrame:
    """Add ``cls`` (``(unknown)`` when absent) and ``answer_ok``, parsing each answer once."""
    read = read_answer(F.col("answer"), [CLASS_PATH], "strict")
    named = F.coalesce(F.nullif(F.col("_read.vals")[0], F.lit("")), F.lit(UNKNOWN))
    return (
        records.withColumn("_read", read)
        .withColumns({"cls": named, "answer_ok": F.col("_read.ok")})
        .drop("_read")
    )


def variant_count(
    cls: Column, normal: int = 4, priority: int = 12, classes: Sequence[str] = PRIORITY_CLASSES
) -> Column:
    return F.when(cls.isin(*classes), priority).otherwise(normal)


def fan_out(records: DataFrame, n_variants: Column) -> DataFrame:
    """Original (``variant`` 0) and ``n_variants`` copies of each record."""
    return records.withColumn("variant", F.explode(F.sequence(F.lit(0), n_variants)))


def fill_variants(
    records: DataFrame,
    n_variants: Column,
    seed: int = 42,
    key: str = "rec_id",
) -> DataFrame:
    """Fan out and write each variant's ``user_text`` and ``answer``.

    Texts are cut at their placeholders once per record, before the fan-out; a
    variant draws one value per kind, used on both sides, and joins the pieces.
    The original (variant 0) stays as it is.
    """
    sides = ("user_text", "answer")
    present = ph.presence(*[F.col(c) for c in sides])
    cut = records.withColumns(
        {
            **{c: ph.pieces(F.col(c)) for c in sides},
            **{f"_has_{kind}": held for kind, held in present.items()},
        }
    )
    drawn = ph.with_values(fan_out(cut, n_variants), seed, key)
    original = F.col("variant") == 0
    return drawn.withColumns(
        {c: F.when(original, F.array_join(c, "")).otherwise(ph.fill(c)) for c in sides}
    ).drop(*[f"_{k}" for k in present], *[f"_has_{k}" for k in present])


def noisy_user(rate: float, seed: int = 42, key: str = "rec_id") -> Column:
    """User text with noise on variants, untouched on originals."""
    user = F.col("user_text")
    if rate <= 0:
        return user
    variant = F.col("variant")
    noisy = add_noise(F.when(variant > 0, user), rate, F.lit(seed), F.col(key), variant)
    return F.coalesce(noisy, user)


def variants(
    records: DataFrame,
    n_variants: Column,
    seed: int = 42,
    noise: float = 0.003,
    key: str = "rec_id",
) -> DataFrame:
    """Original and valid variants of records that carry ``answer_ok``.

    A valid answer stays valid: placeholders can only stand inside its strings
    and replacements hold no quotes or backslashes.  So only variants of an
    invalid answer that holds a placeholder are tested again.
    """
    marked = records.withColumn(
        "_retest", ~F.col("answer_ok") & ph.has_placeholder(F.col("answer"))
    )
    made = fill_variants(marked, n_variants, seed, key=key)
    recheck = F.when(F.col("_retest") & (F.col("variant") > 0), F.col("answer"))
    # Both Arrow functions sit in one projection, hence in one exchange with Python.
    checked = made.withColumns(
        {"_valid": json_ok(recheck), "user_text": noisy_user(noise, seed, key)}
    )
    keep = (F.col("variant") == 0) | F.coalesce(F.col("_valid"), F.col("answer_ok"))
    return checked.where(keep).drop("_retest", "_valid", "answer_ok")


def augment(
    records: DataFrame,
    normal: int = 4,
    priority: int = 12,
    noise: float = 0.003,
    seed: int = 42,
    classes: Sequence[str] = PRIORITY_CLASSES,
) -> Augmented:
    """The whole job over ``(rec_id, system, user_text, answer)``.

    Originals stay whole: all their messages, and the line they were read from as
    ``raw``, where the input has them.
    """
    whole = [c for c in WHOLE if c in records.columns]
    return from_classed(
        with_class(records.select("rec_id", "system", "user_text", "answer", *whole)), normal, priority, noise, seed, classes
    )


def from_classed(
    classed: DataFrame,
    normal: int = 4,
    priority: int = 12,
    noise: float = 0.003,
    seed: int = 42,
    classes: Sequence[str] = PRIORITY_CLASSES,
) -> Augmented:
    """The job over records that ``with_class`` has read."""
    whole = [c for c in WHOLE if c in classed.columns]
    count = variant_count(F.col("cls"), normal, priority, classes)
    made = variants(classed, count, seed, noise)
    original = F.col("variant") == 0
    new = canonical(F.col("system"), F.col("user_text"), F.col("answer"))
    raw = [F.when(original, F.col("raw")).alias("raw")] if "raw" in whole else []
    data = made.select("rec_id", "variant", "cls", original_or(made, original, new).alias("messages"), *raw)
    return Augmented(data, class_counts(classed, count, seed, classes).orderBy(F.desc("total"), "cls"))


def class_counts(classed: DataFrame, n_variants: Column, seed: int, classes: Sequence[str]) -> DataFrame:
    """Originals, variants and total per class, from the records alone.

    A valid answer keeps all its variants, an invalid one without placeholders
    none; only invalid answers with placeholders are filled in and tested.
    """
    unsure = ~F.col("answer_ok") & ph.has_placeholder(F.col("answer"))
    sure = classed.where(~F.coalesce(unsure, F.lit(False))).select(
        "cls", F.lit(1).alias("_original"), F.when(F.col("answer_ok"), n_variants).otherwise(0).alias("_variants")
    )
    tested = variants(classed.where(unsure).select("rec_id", "user_text", "answer", "cls", "answer_ok"), n_variants, seed, 0.0)
    first = F.col("variant") == 0
    tested = tested.select("cls", first.cast("int").alias("_original"), (~first).cast("int").alias("_variants"))
    counts = sure.unionByName(tested).groupBy("cls").agg(
        F.sum("_original").cast("long").alias("originals"), F.sum("_variants").cast("long").alias("variants"),
        F.sum(F.col("_original") + F.col("_variants")).cast("long").alias("total"),
    )
    return counts.withColumn("priority", F.col("cls").isin(*classes))
