"""Reconcile the model registry with the files on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.numbers import fixed

DIR_PREFIX = "models--"
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
TOTAL = "TOTAL"


def hf_id(directory: Column) -> Column:
    """``models--org--name`` -> ``org/name``."""
    return F.replace(F.substr(directory, F.lit(len(DIR_PREFIX) + 1)), F.lit("--"), F.lit("/"))


def sizes(files: DataFrame) -> DataFrame:
    """Bytes per model from a file listing ``(dir, length)``."""
    models = files.where(F.col("dir").startswith(DIR_PREFIX))
    return models.groupBy(hf_id(F.col("dir")).alias("hf_id")).agg(
        F.sum("length").alias("size_bytes")
    )


def human_size(size: Column) -> Column:
    """One decimal in units of 1024, rounded from the exact value."""
    number = name = None
    for power in range(len(UNITS) - 1, -1, -1):
        scaled = size.cast("double") / F.lit(float(1024**power))
        unit = F.lit(UNITS[power])
        number = scaled if number is None else F.when(scaled < 1024, scaled).otherwise(number)
        name = unit if name is None else F.when(scaled < 1024, unit).otherwise(name)
    return F.concat(fixed(number, 1), F.lit(" "), name)


def latest_definitions(registry: DataFrame) -> DataFrame:
    """One row per alias: the definition on the last line wins."""
    fields = [c for c in registry.columns if c not in ("alias", "line_no")]
    return registry.groupBy("alias").agg(
        *[F.max_by(F.col(c), F.col("line_no")).alias(c) for c in fields],
        F.max("line_no").alias("line_no"),
    )


def status(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registered aliases: downloaded?, size or a dash, backend."""
    local = sizes(files)
    return (
        latest_definitions(registry)
        .join(local, "hf_id", "left")
        .select(
            "alias",
            "hf_id",
            F.col("size_bytes").isNotNull().alias("downloaded"),
            F.coalesce(human_size(F.col("size_bytes")), F.lit("—")).alias("size"),
            F.coalesce("serve_backend", F.lit("vllm")).alias("backend"),
        )
    )


def unregistered(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Models on disk that no alias names."""
    known = latest_definitions(registry).select("hf_id")
    return sizes(files).join(known, "hf_id", "left_anti").select(
        "hf_id", "size_bytes", human_size(F.col("size_bytes")).alias("size")
    )


def totals(files: DataFrame) -> DataFrame:
    """Size per model and a TOTAL row, from one aggregation."""
    per_model = sizes(files)
    rolled = per_model.rollup("hf_id").agg(F.sum("size_bytes").alias("size_bytes"))
    return rolled.select(
        F.coalesce("hf_id", F.lit(TOTAL)).alias("hf_id"),
        "size_bytes",
        human_size(F.col("size_bytes")).alias("size"),
    ).where(F.col("size_bytes").isNotNull())


def reconcile(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The whole job: registered and unregistered models in one table."""
    extra = unregistered(registry, files)
    return status(registry, files).unionByName(
        extra.select(
            F.lit(None).cast("string").alias("alias"),
            "hf_id",
            F.lit(True).alias("downloaded"),
            "size",
            F.lit(None).cast("string").alias("backend"),
        )
    )
