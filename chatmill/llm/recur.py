"""Stretches of ``length`` units (words or bytes) that may occur more than once.

Every window of ``length`` units has an anchor, the leftmost least of its grams
(:class:`chatmill.llm.text.Anchors`).  Equal windows share the anchor's gram and
its place, so a window can recur only if its anchor's gram does.  Runs of
windows with one anchor (spans) are about ``length / 2`` windows long, which
leaves a few rows per hundred units to shuffle instead of one per unit.

The anchors that recur come in two kinds: *plain*, when all their spans are
equal (then all windows of these spans recur), and *mixed*, when they stand in
different spans, whose windows must be compared one by one.

Rows are known by ``doc`` and ``tag``, 80 bits of two digests of id and text, so
that rows sharing an id keep apart unless their texts agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import ship, written
from chatmill.llm.text import Anchors, Words, byte_rolling, chunks, flat, mix, word_rolling


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """``doc`` (64 bits) and ``tag`` (16 bits): independent digests of id and text."""
    return F.xxhash64(doc_id, text), F.hash(doc_id, text).bitwiseAND(0xFFFF).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, tag, doc_id, text``; also sends the package to the executors."""
    ship(docs.sparkSession)
    doc, mark = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(doc.alias("doc"), mark.alias("tag"), "doc_id", "text")


# A span's place in one long: first window (32 bits), windows (14), seen again in its row (1), tag (16).
def pack(first: np.ndarray, count: np.ndarray, again: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return (first << 32) | (count << 18) | (again << 16) | tag


def first(spot: Column) -> Column:
    return F.shiftright(spot, 32)


def count(spot: Column) -> Column:
    return F.shiftright(spot, 18).bitwiseAND(0x3FFF)


def weight(spot: Column) -> Column:
    return F.shiftright(spot, 16).bitwiseAND(1) + 1


def tag(spot: Column) -> Column:
    return spot.bitwiseAND(0xFFFF)


def anchors(texts: pa.Array, unit: str, length: int, gram: int) -> tuple[Anchors, np.ndarray]:
    """Spans of a chunk, and the first unit of each row."""
    data, offsets = flat(texts)
    if unit == "byte":
        return Anchors(byte_rolling(data), offsets, length, gram), offsets
    words = Words(data, offsets)
    return Anchors(word_rolling(words.hashes()), words.first, length, gram), words.first


def row_of(starts: np.ndarray, units: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, units, "right") - 1


def in_row(spans: Anchors, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First of each group of equal spans of one row, the group of every span, the group sizes."""
    same = mix(spans.whole ^ mix(spans.key, 5)) ^ mix(rows.astype(np.uint64), 6)
    _, firsts, group, sizes = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    return firsts, group, sizes


def spans(keyed_docs: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """``key, whole, doc, spot``: every different span of every row, marked if its row holds it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found, starts = anchors(chunk.column("text"), unit, length, gram)
            if not len(found.first):
                continue
            rows = row_of(starts, found.first)
            firsts, _, sizes = in_row(found, rows)
            own = rows[firsts]
            spot = pack(
                found.first[firsts] - starts[own], found.count[firsts], (sizes > 1).astype(np.int64),
                chunk.column("tag").to_numpy()[own],
            )
            columns = [found.key[firsts].view(np.int64), found.whole[firsts].view(np.int64),
                       chunk.column("doc").to_numpy()[own], spot]
            yield pa.record_batch([pa.array(c) for c in columns], ["key", "whole", "doc", "spot"])

    return keyed_docs.select("doc", "tag", "text").mapInArrow(run, "key long, whole long, doc long, spot long")


def repeated(all_spans: DataFrame, files: int) -> DataFrame:
    """``key, whole, doc, spot, mixed``: the spans whose anchor recurs.  Written once."""
    keys = (
        all_spans.groupBy("key")
        .agg(F.sum(weight(F.col("spot"))).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
        .where("n > 1")
        .select(F.col("key").alias("_key"), (F.col("low") != F.col("high")).alias("mixed"))
    )
    return written(all_spans.join(keys, F.col("key") == F.col("_key")).drop("_key"), "spans", files)


def distinct_spans(recurring: DataFrame) -> DataFrame:
    """``key, whole, mixed, doc, spot, n``: one representative and the weight of each different span."""
    return (
        recurring.groupBy("key", "whole", "mixed")
        .agg(F.min(F.struct("doc", "spot")).alias("at"), F.sum(weight(F.col("spot"))).alias("n"))
        .select("key", "whole", "mixed", "at.doc", "at.spot", "n")
    )


def touched(keyed_docs: DataFrame, recurring: DataFrame, files: int) -> DataFrame:
    """The rows that hold a recurring anchor.  Written once."""
    rows = recurring.select(F.col("doc").alias("_doc"), tag(F.col("spot")).alias("_tag")).distinct()
    same = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    return written(keyed_docs.join(rows, same, "left_semi"), "touched", files)


def runs(first_units: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the units 0..size that the stretches cover."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, first_units, 1)
    np.add.at(change, first_units + counts, -1)
    covered = np.cumsum(change)[:size] > 0
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
