"""Audit, split and render instruction records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.operators.chat import render_alpaca
from chatmill.plans.combine import split_exact

# Fields every row of a format must have.
REQUIRED = {"alpaca": ["instruction", "output"]}


@dataclass
class Prepared:
    audit: DataFrame
    data: DataFrame
    rejects: DataFrame


def audit(rows: DataFrame, fmt: str = "alpaca") -> DataFrame:
    """One row per required field: rows, rows without it, and the first such row.

    A null column stands for an absent field.
    """
    if fmt not in REQUIRED:
        raise ValueError(f"unknown format: {fmt}")
    required = REQUIRED[fmt]
    measured = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(k).isNull()).alias(f"_m_{k}") for k in required],
        *[F.min(F.when(F.col(k).isNull(), F.col("rec_id"))).alias(f"_f_{k}") for k in required],
    )
    per_field = F.array(
        *[
            F.struct(
                F.lit(k).alias("field"),
                F.col(f"_m_{k}").alias("missing"),
                F.col(f"_f_{k}").alias("first_rec_id"),
            )
            for k in required
        ]
    )
    return measured.select(F.lit(fmt).alias("format"), "rows", F.inline(per_field))


def check(rows: DataFrame, fmt: str = "alpaca") -> dict:
    """Raise on a missing field, naming the first row; else ``{count, format}``."""
    found = audit(rows, fmt).collect()  # one row per required field
    bad = [r for r in found if r["missing"]]
    if bad:
        first = min(bad, key=lambda r: (r["first_rec_id"], REQUIRED[fmt].index(r["field"])))
        raise ValueError(f"row {first['first_rec_id']} has no field '{first['field']}'")
    return {"count": found[0]["rows"], "format": fmt}


def prepare_alpaca(
    rows: DataFrame,
    ratios: Sequence[float] = (0.9, 0.05, 0.05),
    seed: int = 42,
    eos: str = "</s>",
) -> Prepared:
    """Audit, ``(rec_id, split, text)`` of the complete rows and ``(rec_id, field)`` of the others.

    A job that must refuse incomplete data calls ``check`` first.
    """
    missing = F.filter(
        F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED["alpaca"]]), lambda k: k.isNotNull()
    )
    split = split_exact(rows.where(F.size(missing) == 0), ratios, seed)
    return Prepared(
        audit(rows),
        split.select("rec_id", "split", render_alpaca(eos=eos).alias("text")),
        rows.select("rec_id", F.explode(missing).alias("field")),
    )
