"""Repeatable random order: digests keyed by record, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | int | str) -> Column:
    """MD5 hex of the parts joined by colons."""
    as_text = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *as_text))
