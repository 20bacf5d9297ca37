"""JSONL records: lenient and strict readers, sink, registry of datasets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chatmill.functions.answers import json_ok
from chatmill.functions.text import strip
from chatmill.operators.ranking import running_totals

CHAT_SCHEMA = "messages array<struct<role: string, content: string>>"
ALPACA_SCHEMA = "instruction string, input string, output string"
#: Where a record stands.
PLACE = ("src_file", "src_block", "src_row", "rec_id")


#: Inputs are cut by their size alone, whatever the cluster: at most ``SPLIT`` bytes, and smaller
#: inputs in up to ``PARTS`` splits.  So the ids below are the same on any number of executors.
SPLIT, PARTS, SMALLEST = 128 << 20, 1024, 4 << 20
#: The lists of file names that are sent to every executor are no larger than this.
SENT = 64 << 20
#: Bits of a row's number within its task.
_ROW = (1 << 33) - 1
#: Line counts of a file are added up over this many bits of the split's position first (128 GB).
_FAR = 37


@dataclass
class Lines:
    """What a reader found: ``records``, ``rejects`` (file, line number, text), and the lines they come from."""

    records: DataFrame
    rejects: DataFrame
    lines: DataFrame

    def numbered(self, rows: DataFrame) -> DataFrame:
        """Add ``line_no`` to ``rows``, which have src_file, src_block and src_row of these lines."""
        return line_numbers(self.lines, rows)


def _reader(spark: SparkSession, split: int) -> SparkSession:
    """A session of the same application that cuts files as said above, with all other settings of ``spark``."""
    reader = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if not key.startswith("spark.sql.files.") and spark.conf.isModifiable(key):
            reader.conf.set(key, value)
    for name, value in (("maxPartitionBytes", split), ("minPartitionNum", PARTS), ("openCostInBytes", min(split, SMALLEST))):
        reader.conf.set(f"spark.sql.files.{name}", str(value))
    return reader


def input_names(files: DataFrame) -> list[str]:
    """Names of the files of a reader as its metadata column spells them; empty files too."""
    return [re.sub("^file:///", "file:/", name) for name in files.inputFiles()]


def placed_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``(src_file, src_block, src_row, rec_id, raw)``: every line with its place, in one scan.

    ``src_block`` is where the line's split begins in the file, ``src_row`` counts
    the lines of its task.  A split of full size is a task of its own and holds
    fewer lines than bytes; only the last, shorter split of a file may follow
    others in its task.  So ``src_block + src_row`` tells the lines of a file apart
    and grows along it, and with the file's number (by name) in the upper bits
    it is ``rec_id``: unique, in the order of names and lines, and no line has to
    be counted before it can be read.
    """
    reader = _reader(spark, split)
    text = reader.read.text(path)
    files = sorted(input_names(text))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    lines = text.select(
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_block"),
        row.alias("src_row"), F.col("value").alias("raw"),
    )
    # The caller's session goes on with the lines; the splits stay those of the reader.
    name = f"lines_{uuid.uuid4().hex}"
    lines.createGlobalTempView(name)
    lines = spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase', 'global_temp')}.{name}")
    position = F.col("src_block") + F.col("src_row")
    if len(files) < 2:
        return lines.select("src_file", "src_block", "src_row", position.alias("rec_id"), "raw")
    bits = 63 - len(files).bit_length()
    numbers = spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
    if sum(map(len, files)) + 16 * len(files) <= SENT:
        numbers = F.broadcast(numbers)
    return lines.join(numbers, F.col("src_file") == F.col("_file")).select(
        "src_file", "src_block", "src_row", F.shiftleft("_number", bits).bitwiseOR(position).alias("rec_id"), "raw"
    )


def line_numbers(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``line_no`` (from 1 in each file) to ``rows`` with src_file, src_block and src_row of some of ``lines``.

    A second scan counts the lines of each split, for the files that ``rows`` name
    only.  The counts are added up within stretches of 128 GB, then over the
    stretches of a file; texts take no part.
    """
    far = F.shiftright("src_block", _FAR).alias("_far")
    splits = lines.groupBy("src_file", "src_block").agg(F.min("src_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    splits = splits.join(rows.select("src_file").distinct(), "src_file", "left_semi").select("*", far)
    near = Window.partitionBy("src_file", "_far").orderBy("src_block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("src_file").orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    stretches = splits.groupBy("src_file", "_far").agg(F.sum("_lines").alias("_all"))
    stretches = stretches.select("src_file", "_far", F.coalesce(F.sum("_all").over(over), F.lit(0)).alias("_before"))
    placed = splits.withColumn("_near", F.coalesce(F.sum("_lines").over(near), F.lit(0))).join(stretches, ["src_file", "_far"])
    placed = placed.select("src_file", "src_block", (F.col("_before") + F.col("_near") - F.col("_first") + 1).alias("_shift"))
    return rows.join(placed, ["src_file", "src_block"]).withColumn("line_no", F.col("src_row") + F.col("_shift")).drop("_shift")


def read_jsonl(
    spark: SparkSession,
    path: str,
    schema: str = CHAT_SCHEMA,
    counted: Observation | None = None,
    split: int = SPLIT,
) -> Lines:
    """Skip blank lines; malformed ones come back as rejects with file and line number.

    The files are read once for the records.  ``rejects`` is a second reading, for
    those who ask for it: only then are lines counted.  ``counted`` receives the
    numbers of ``records`` and ``malformed`` lines while the records are consumed.
    """
    lines = placed_lines(spark, path, split)
    checked = lines.where(strip(F.col("raw")) != "").withColumn("_ok", json_ok(F.col("raw")))
    if counted is not None:
        checked = checked.observe(
            counted, F.count_if("_ok").alias("records"), F.count_if(~F.col("_ok")).alias("malformed")
        )
    records = checked.where("_ok").withColumn("_rec", F.from_json("raw", schema)).select(*PLACE, "_rec.*", "raw")
    bad = checked.where(~F.col("_ok")).select(*PLACE, "raw")
    return Lines(records, line_numbers(lines, bad).select("src_file", "line_no", "raw"), lines)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str = CHAT_SCHEMA, split: int = SPLIT) -> DataFrame:
    """As ``read_jsonl``, but any malformed line fails the job when it is reached, in the same single reading."""
    lines = placed_lines(spark, path, split).where(strip(F.col("raw")) != "")
    message = F.concat(
        F.lit("malformed JSON in "), "src_file", F.lit(" after byte "), F.col("src_block").cast("string"),
        F.lit(": "), F.left("raw", F.lit(80)),
    )
    good = F.when(json_ok(F.col("raw")), F.col("raw")).otherwise(F.raise_error(message))
    return lines.withColumn("raw", good).withColumn("_rec", F.from_json("raw", schema)).select(*PLACE, "_rec.*", "raw")


def indexed(records: DataFrame) -> DataFrame:
    """Add ``index``: the 0-based place of each record by ``rec_id``, blank lines not counted."""
    return running_totals(records, "rec_id", {"_n": F.lit(1)}).withColumn(
        "index", F.col("_n") - 1
    ).drop("_n")


def write_jsonl(df: DataFrame, path: str, *columns: str, mode: str = "errorifexists") -> None:
    """One object per line with the given columns (default: messages); text stays literal."""
    names = columns or ("messages",)
    line = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write made records as objects and originals (``raw`` is not null) as the lines they were."""
    line = F.to_json(F.struct("messages"), {"ignoreNullFields": "false"})
    if "raw" in df.columns:
        line = F.coalesce("raw", line)
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_raw(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write records back as the lines they were read from, extra keys included."""
    df.select(F.col("raw").alias("value")).write.mode(mode).text(path)


def resolve(registry: Mapping[str, Mapping], key: str, root: str) -> str:
    """Path of a registered dataset; a relative one is below ``root``."""
    path = registry[key]["path"]
    return path if "://" in path or PurePosixPath(path).is_absolute() else f"{root.rstrip('/')}/{path}"


def read_dataset(
    spark: SparkSession, registry: Mapping[str, Mapping], key: str, root: str = "."
) -> DataFrame:
    """Strictly read a dataset by its registry key; an absent field of a row is null."""
    schema = {"alpaca": ALPACA_SCHEMA, "chat": CHAT_SCHEMA}.get(registry[key]["format"])
    if schema is None:
        raise ValueError(f"unknown format: {registry[key]['format']}")
    return read_jsonl_strict(spark, resolve(registry, key, root), schema)
