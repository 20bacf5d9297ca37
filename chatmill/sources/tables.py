"""Case tables, marker lists, retest cases, metadata, result files, logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmill.functions.answers import json_ok
from chatmill.functions.text import strip
from chatmill.operators.chat import first_n
from chatmill.operators.markers import clean_markers
from chatmill.sources.records import input_names, placed_lines, read_jsonl_strict

CASE_SCHEMA = "case_pos long, name string, input string, asserts string, output string"
RETEST_SCHEMA = "case_name string, input_text string"
RESULT_SCHEMA = (
    "max_concurrency long, request_throughput double, output_throughput double, "
    "p50_ttft_ms double, p99_ttft_ms double, mean_tpot_ms double, p99_e2el_ms double, failed long"
)


def tidy_cases(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """Named cases with empty text for null cells; the limit counts unnamed rows too."""
    limited = first_n(cases, limit, "case_pos") if limit else cases
    return limited.where(F.col("name").isNotNull()).na.fill("", ["input", "asserts", "output"])


def read_cases(spark: SparkSession, path: str, fmt: str = "parquet", limit: int | None = None) -> DataFrame:
    """A case table; CSV with a header row and JSON lines need a ``case_pos`` column too."""
    reader = spark.read.schema(CASE_SCHEMA)
    if fmt == "csv":
        reader = reader.options(header="true", multiLine="true", escape='"')
    return tidy_cases(reader.format(fmt).load(path), limit)


def write_cases(cases: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = cases.select("case_pos", "name", "input", "asserts", "output").write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header="true", escape='"')
    writer.format(fmt).save(path)


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed, non-blank marker per line, each once."""
    return clean_markers(spark.read.text(path), "value")


def read_retest(spark: SparkSession, path: str) -> DataFrame:
    """Retest cases; expected values are an object or a list of pairs.  A malformed line fails the job."""
    lines = read_jsonl_strict(spark, path, RETEST_SCHEMA)
    as_object = F.from_json("raw", "expected_failures map<string, string>")["expected_failures"]
    pairs = F.from_json("raw", "expected_failures array<array<string>>")["expected_failures"]
    as_map = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0], p[1])))
    return lines.select(
        F.col("rec_id").alias("case_id"), "case_name", "input_text", F.coalesce(as_object, as_map).alias("expected")
    )


@dataclass
class Objects:
    """What a reader of whole-file objects found; ``rejects``: file and text of those that hold none."""

    data: DataFrame
    rejects: DataFrame


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """``(src_file, raw, ok)``: each file with whether it is one JSON object; Spark reads no row of an empty file."""
    text = spark.read.text(path, wholetext=True)
    listed = spark.createDataFrame([(name,) for name in input_names(text)], "src_file string")
    files = text.select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("raw"))
    files = files.withColumn("_json", json_ok(F.col("raw")) & strip(F.col("raw")).startswith("{"))
    return listed.join(files, F.col("src_file") == F.col("_file"), "left").select(
        "src_file", F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce("_json", F.lit(False)).alias("ok")
    )


def read_results(spark: SparkSession, path: str) -> Objects:
    """Benchmark result files, one object each, with ``src_file``; a file that is none is a reject."""
    files = _whole(spark, path)
    parsed = files.where("ok").select("src_file", F.from_json("raw", RESULT_SCHEMA).alias("r")).select("src_file", "r.*")
    return Objects(parsed, files.where("NOT ok").select("src_file", "raw"))


def read_metadata(spark: SparkSession, root: str) -> Objects:
    """Metadata objects below ``root/<dir>/`` with the directory name; a file that holds no object is a reject."""
    path = f"{root}/*/metadata.json"
    named = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dir")
    files = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    good = files.where("_bad IS NULL") if "_bad" in files.columns else files
    data = good.select("*", named).drop("_bad")
    return Objects(data, _whole(spark, path).where("NOT ok").select("src_file", "raw"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines ``(run, line_no, value)``, read once; the run is the file's name without ending.

    ``line_no`` grows along a file; in files of more than one split it skips numbers.
    """
    name = F.element_at(F.split("src_file", "/"), -1)
    place = F.col("src_block") + F.col("src_row") + 1
    return placed_lines(spark, path).select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("run"), place.alias("line_no"), F.col("raw").alias("value")
    )
