"""Numbers as report text."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the function with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fixed(value: Column, digits: int) -> Column:
    """The number with ``digits`` decimals, null for null.

    The exact binary value is rounded, halves to even: 2.675 is stored as a little
    less and gives 2.67.  Spark's own rounding starts from the shortest spelling.
    Meant for report tables, which have few rows.
    """

    @F.arrow_udf(T.StringType())
    def spelled(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return spelled(value.cast("double"))
