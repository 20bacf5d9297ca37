"""What the operators share: tables written once, the package for the executors, folds of ids."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmill.session import shared_dir


#: Applications that have been sent the package.
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application.

    The functions that run in tasks import them; a cluster need not have the
    package installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)


def files_for(rows: int, rows_a_file: int = 5_000) -> int:
    """How many files a table of that many rows gets."""
    return 1 + rows // rows_a_file


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table that survives lost executors.  Each call makes
    a folder of its own; an operator's folders may be deleted once its result
    has been saved.  ``files`` bounds the number of files (and of the last
    stage's tasks) by the amount of data rather than by the shuffle's partitions.
    """
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: str, parts: int) -> Column:
    """``crc32(column as text) mod parts``: the fold of a row; a null id is in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def is_fold(column: str, parts: int, number: int) -> Column:
    return F.coalesce(fold(column, parts) == number, F.lit(False))
