"""Token counters: a plug-in point, ``Column -> Column``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A word or one other visible character; leading blanks make the pieces lossless.
TOKEN = r"\w+|[^\w\s]"
LOSSLESS_TOKEN = r"\s*(?:\w+|[^\w\s])"


def count_words(text: Column) -> Column:
    """Words and punctuation marks, counted natively."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def count_quarter(text: Column) -> Column:
    """The usual four-characters-per-token estimate."""
    return F.ceil(F.length(text) / 4).cast("long")


def counter_from(load: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """Counter around any tokenizer: ``load`` runs once per Python worker batch stream."""

    @F.arrow_udf(LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        size_of = load()
        for texts in batches:
            yield pa.array(
                [None if t is None else size_of(t) for t in texts.to_pylist()], pa.int64()
            )

    return count
