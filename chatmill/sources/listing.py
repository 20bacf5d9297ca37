"""Listing of files by tasks, one level of directories after the other."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmill.session import materialise

DIRS_A_TASK = 64
BATCH = 10_000


def _local(root: str) -> str | None:
    """The path of a root in the file system that all machines mount; None for other stores."""
    parts = urlparse(root)
    if parts.scheme == "file":
        return unquote(parts.path)
    return None if parts.scheme else os.path.abspath(root)


def _entries(root: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    """``(below, length, is_dir)`` of what one directory holds.

    Links to files count as the files; links to directories and what cannot be read are left out.
    """
    path = _local(root)
    if path is None:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        store, base = FileSystem.from_uri(root)
        for item in store.get_file_info(FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
            if item.type in (FileType.File, FileType.Directory):
                below = f"{folder}/{item.base_name}" if folder else item.base_name
                yield below, item.size or 0, item.type == FileType.Directory
        return
    try:
        inside = os.scandir(os.path.join(path, folder))
    except OSError:
        return
    with inside:
        for item in inside:
            below = f"{folder}/{item.name}" if folder else item.name
            try:
                if not item.is_dir():
                    yield below, item.stat().st_size, False
                elif not item.is_symlink():
                    yield below, 0, True
            except OSError:
                continue


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, dir, length)`` of all files below ``root``; contents are not read.

    ``dir`` is the directory directly below the root (null for files in the root
    itself); each has a row of length 0 and its own path, so that empty ones are listed too.
    A missing root has no rows.  A level of directories is listed by tasks and
    written before the next, so the driver holds no listing: its work grows with the
    depth of the tree alone.  A task holds one batch of entries of a local
    directory (one directory of another store).
    """
    root = root.rstrip("/") or "/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["below", "length", "is_dir"], [pa.string(), pa.int64(), pa.bool_()]
        held: list[tuple[str, int, bool]] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*held), types)]
            held.clear()
            return pa.record_batch(columns, names)

        for batch in batches:
            for folder in batch.column("below").to_pylist():
                for entry in _entries(root, folder):
                    held.append(entry)
                    if len(held) >= BATCH:
                        yield flush()
        if held:
            yield flush()

    folders, levels, waiting = spark.createDataFrame([("",)], "below string"), [], 1
    while waiting:
        spread = folders.repartition(1 + waiting // DIRS_A_TASK, "below")
        level = materialise(spread.mapInArrow(run, "below string, length long, is_dir boolean"))
        levels.append(level)
        folders = level.where("is_dir").select("below")
        waiting = folders.count()
    first = F.substring_index("below", "/", 1)
    top = ~F.contains(F.col("below"), F.lit("/"))
    everything = reduce(DataFrame.unionByName, levels).where(~F.col("is_dir") | top)
    return everything.select(
        F.concat(F.lit(root.rstrip("/") + "/"), "below").alias("path"),
        F.when(F.col("is_dir") | ~top, first).alias("dir"),
        "length",
    )
