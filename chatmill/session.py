"""Session settings and the few helpers that touch the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs are written for.  All are ordinary Spark SQL settings; a
#: cluster that already sets them keeps its own values for the rest.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are multiplied after some shuffles: a small partition is still worth a core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Texts run to hundreds of kilobytes: small Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Local fallback folders by application, for sessions that name no shared folder.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for materialised intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests, local runs) is a temporary folder taken instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="chatmill-")
        return _LOCAL[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it from there.

    Used for results that are read more than once: scored cases without their long
    texts, one row per class, group or input split.  Later reads take only the
    columns they need, and a lost executor costs no recomputation.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
