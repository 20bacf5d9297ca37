"""Suffix-array dedup: bytes inside long byte strings that occur again.

A 200-byte string (``length``) that starts anywhere else, in this text or
another, is a repeat; every byte it covers is removed.  The work runs in steps:

1. Anchors (see :mod:`chatmill.llm.recur`) leave only stretches around byte
   grams that recur.  Equal stretches are counted once.
2. Where an anchor stands in different stretches, these are brought together by
   their anchor and sorted as suffixes by the difference-cover algorithm: sort
   the triples at positions not divisible by three, recurse on their names,
   sort the others by first symbol and rank, merge by rank.
3. Neighbours in suffix order are compared by their first ``length`` bytes.
4. Each text is cut by what was found in it.

Shuffles carry the anchors' rows and the differing stretches, not a row per
byte.  A task sorts whole anchors in blocks of about a megabyte.  An anchor whose
different stretches exceed a block (*hot*: a phrase in very many surroundings) is
not sorted in one task: its stretches are dealt out singly, and its windows are
counted over all tasks by a 128-bit digest, a row per window.

Defined cases: null counts as empty text; rows shorter than ``length`` keep all;
rows with equal id and text get equal results, one each; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.llm import recur
from chatmill.llm.store import files_for, written
from chatmill.llm.text import Rolling, byte_rolling, chunks, flat, mix

GRAM = 64
BLOCK = 1 << 20
_VALUES = mix(np.arange(256, dtype=np.uint64), 11)
_BASE = 0xD6E8FEB86659FD93 | 5


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes.

    ``symbols`` are positive integers; zero stands behind the end.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    s = np.zeros(n + 3, dtype=np.int64)
    s[:n] = symbols
    if int(s.max()) > n + 256:
        s = np.unique(s, return_inverse=True)[1]
    base = int(s.max()) + 1
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.concatenate([ones, twos])
    ranks = len(cover) + 1
    pair = s[:-1] * base + s[1:]
    if base * base * max(base, ranks) >= 1 << 63:  # three names do not fit into one long: rank the first two
        pair = np.unique(pair, return_inverse=True)[1]
    triples = pair[cover] * base + s[cover + 2]
    _, names = np.unique(triples, return_inverse=True)
    names = names.astype(np.int64) + 1
    if names.max() < len(cover):
        order = suffix_order(names)
    else:
        order = np.argsort(names, kind="stable")
    sampled = cover[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]

    rest = np.arange(0, n, 3)
    first = s[rest] * ranks + rank[rest + 1]
    by_first = np.argsort(first, kind="stable")
    rest, first = rest[by_first], first[by_first]
    second = pair[rest] * ranks + rank[rest + 2]
    is_one = sampled % 3 == 1
    one, two = sampled[is_one], sampled[~is_one]
    before = np.searchsorted(s[one] * ranks + rank[one + 1], first)
    before = before + np.searchsorted(pair[two] * ranks + rank[two + 2], second)
    place = before + np.arange(len(rest))
    order = np.empty(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    free[place] = False
    order[place] = rest
    order[free] = sampled
    return order


def equal_prefix(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each pair of positions agree (eight at a time)."""
    eights = np.lib.stride_tricks.as_strided(
        data[: len(data) - 7], shape=(len(data) - 7, 8), strides=(1, 1)
    )
    same = np.ones(len(left), dtype=bool)
    at = np.arange(len(left))
    for offset in [*range(0, length - 8, 8), length - 8]:
        a, b = eights[left[at] + offset], eights[right[at] + offset]
        agree = (np.ascontiguousarray(a).view(np.uint64) == np.ascontiguousarray(b).view(np.uint64)).ravel()
        same[at[~agree]] = False
        at = at[agree]
    return same


def recurring_windows(stretches: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """For all windows of all stretches, one after the other: whether another has the same bytes."""
    sizes = np.fromiter((len(x) + 1 for x in stretches), dtype=np.int64, count=len(stretches))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(stretches) + b"\0" * 9, dtype=np.uint8)
    symbols = data[: int(sizes.sum())].astype(np.int64) + 1
    symbols[begin + sizes - 1] = 0
    symbols += 1  # the end of a stretch sorts before every byte
    order = suffix_order(symbols)
    number = np.full(len(symbols), -1, dtype=np.int64)
    firsts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    number[firsts] = np.arange(len(firsts))
    order = order[number[order] >= 0]
    same = equal_prefix(data, order[:-1], order[1:], length)
    again = np.zeros(len(firsts), dtype=bool)
    again[number[order[:-1][same]]] = True
    again[number[order[1:][same]]] = True
    return again


def _contexts(touched: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """``key, doc, spot, n, hot, bytes``: the text of the different stretches around mixed anchors."""
    wanted = mixed.groupBy(F.col("doc").alias("_doc"), recur.tag(F.col("spot")).alias("_tag")).agg(
        F.collect_list(F.struct("spot", "key", "n", "hot")).alias("wanted")
    )
    same = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    rows = touched.dropDuplicates(["doc", "tag"]).join(wanted, same).select("doc", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            data, offsets = flat(chunk.column("text"))
            wanted = chunk.column("wanted")
            ends = wanted.offsets.to_numpy()
            spot = wanted.values.field("spot").to_numpy()[ends[0] : ends[-1]]
            row = np.repeat(np.arange(len(chunk)), np.diff(ends))
            start = offsets[row] + (spot >> 32)
            stop = start + ((spot >> 18) & 0x3FFF) + length - 1
            raw = data.tobytes()
            parts = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]
            fields = [wanted.values.field(x).slice(ends[0], ends[-1] - ends[0]) for x in ("key", "n", "hot")]
            doc = chunk.column("doc").take(pa.array(row))
            yield pa.record_batch(
                [fields[0], doc, pa.array(spot), fields[1], fields[2], pa.array(parts, pa.binary())],
                ["key", "doc", "spot", "n", "hot", "bytes"],
            )

    return rows.mapInArrow(run, "key long, doc long, spot long, n long, hot boolean, bytes binary")


def _digests(stretches: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Every window of the stretches: its place, weight and 128-bit digest."""
    sizes = pc.binary_length(stretches.column("bytes")).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(stretches.column("bytes").to_pylist()), dtype=np.uint8)
    spot = stretches.column("spot").to_numpy()
    counts = (spot >> 18) & 0x3FFF
    owner = np.repeat(np.arange(len(spot)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[owner] + inside
    key = mix(stretches.column("key").to_numpy().view(np.uint64), 9)[owner]
    one = byte_rolling(data).of(at, at + length) ^ key
    two = Rolling(_VALUES[data], _BASE).of(at, at + length)
    columns = [stretches.column("doc").to_numpy()[owner], (spot & 0xFFFF)[owner], inside + (spot >> 32)[owner], np.ones(len(owner)),
               stretches.column("n").to_numpy()[owner], one.view(np.int64), two.view(np.int64)]
    return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["doc", "tag", "first", "count", "n", "one", "two"])


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """``doc, tag, first, count``: runs of recurring windows of the stretches seen once.

    Windows of hot anchors come one by one, with ``n, one, two``: weight and digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            spot = table.column("spot").to_numpy()
            counts = (spot >> 18) & 0x3FFF
            again = recurring_windows(table.column("bytes").to_pylist(), counts, length)
            once = np.repeat(table.column("n").to_numpy() == 1, counts)
            owner = np.repeat(np.arange(len(spot)), counts)
            window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + (spot >> 32)[owner]
            keep = np.flatnonzero(again & once)
            own, win = owner[keep], window[keep]
            new = np.ones(len(keep), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (win[1:] != win[:-1] + 1)
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(keep)))
            docs = table.column("doc").to_numpy()[own[begin]]
            columns = [docs, spot[own[begin]] & 0xFFFF, win[begin], size]
            columns = [pa.array(c, pa.int64()) for c in columns] + [pa.nulls(len(begin), pa.int64())] * 3
            return pa.record_batch(columns, ["doc", "tag", "first", "count", "n", "one", "two"])

        size = 0
        for batch in batches:
            for some in chunks([batch.filter(batch.column("hot"))], "bytes"):
                yield _digests(some, length)
            batch = batch.filter(pc.invert(batch.column("hot")))
            key = batch.column("key").to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1  # a block ends between two anchors
            last = held[-1].column("key")[-1].as_py() if held else None
            if size >= BLOCK and len(key) and key[0] != last:
                cuts = np.concatenate([[0], cuts])
            bytes_upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())])
            done = 0
            for cut in cuts.tolist():
                if size + bytes_upto[cut] - bytes_upto[done] >= BLOCK:
                    if cut > done:
                        held.append(batch.slice(done, cut - done))
                    yield solve()
                    held, size, done = [], 0, cut
            if done < len(batch):
                held.append(batch.slice(done))
                size += int(bytes_upto[-1] - bytes_upto[done])
        if held:
            yield solve()

    alone = F.when(F.col("hot"), F.xxhash64("doc", "spot")).otherwise(0)
    by_anchor = contexts.repartition("key", alone).sortWithinPartitions("key")
    return by_anchor.mapInArrow(run, "doc long, tag long, first long, count long, n long, one long, two long")


def _marked(different: DataFrame, length: int) -> DataFrame:
    """``different`` with ``hot``: whether the stretches of its anchor exceed a block."""
    stretch = recur.count(F.col("spot")) + (length - 1)
    hot = different.groupBy(F.col("key").alias("_key")).agg(F.sum(stretch).alias("size")).where(F.col("size") > BLOCK)
    # At most one anchor for each block of stretches; written, so that the planner knows their size.
    hot = written(hot.select("_key", F.lit(True).alias("hot")), "hot", 1)
    joined = different.join(hot, F.col("key") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("hot", F.coalesce("hot", F.lit(False)))


def _recurring(windows: DataFrame) -> DataFrame:
    """``doc, tag, first, count``: what was sorted, and the hot anchors' windows whose digest occurs again."""
    hot = windows.where("one IS NOT NULL")
    again = hot.groupBy(F.col("one").alias("_one"), F.col("two").alias("_two")).agg(F.sum("n").alias("times"))
    # Written, so that a join with a very common window can be split.
    again = written(again.where("times > 1").select("_one", "_two"), "again")
    same = (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    found = windows.where("one IS NULL").unionByName(hot.where("n = 1").join(again, same, "left_semi"))
    return found.select("doc", "tag", "first", "count")


def _cut(touched: DataFrame, found: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc, tag, removed, pieces, sha, kept``: each touched text without what was found."""
    lists = found.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("first", "count")).alias("found")
    )
    same = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    rows = touched.dropDuplicates(["doc", "tag"]).join(lists, same, "left").select("doc", "tag", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            data, offsets = flat(chunk.column("text"))
            own, _ = recur.anchors(chunk.column("text"), "byte", length, gram)
            own_row = recur.row_of(offsets, own.first)
            _, group, sizes = recur.in_row(own, own_row) if len(own.first) else (None, np.zeros(0, int), np.zeros(0, int))
            twice = sizes[group] > 1 if len(group) else np.zeros(0, dtype=bool)
            found = chunk.column("found")
            lists = np.zeros(len(chunk) + 1, dtype=np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(), out=lists[1:])
            pairs = found.flatten()
            row = np.repeat(np.arange(len(chunk)), np.diff(lists))
            start = np.concatenate([offsets[row] + pairs.field("first").to_numpy(), own.first[twice]])
            count = np.concatenate([pairs.field("count").to_numpy(), own.count[twice]])
            begin, end = recur.runs(start, count + length - 1, len(data))
            # a run that touches the next row's run would join it: cut at row borders
            border = np.unique(offsets[1:-1])
            inside = border[np.searchsorted(begin, border, "left") > np.searchsorted(end, border, "right")]
            begin, end = np.sort(np.concatenate([begin, inside])), np.sort(np.concatenate([end, inside]))
            piece_row = recur.row_of(offsets, begin)
            raw = data.tobytes()
            removed, pieces, kept = [], [], []
            upto = np.searchsorted(piece_row, np.arange(len(chunk) + 1))
            for r in range(len(chunk)):
                at, left, gone = int(offsets[r]), [], 0
                for a, b in zip(begin[upto[r] : upto[r + 1]].tolist(), end[upto[r] : upto[r + 1]].tolist()):
                    left.append(raw[at:a])
                    at, gone = b, gone + b - a
                left.append(raw[at : int(offsets[r + 1])])
                removed.append(gone)
                pieces.append(int(upto[r + 1] - upto[r]))
                kept.append(b"".join(left))
            yield pa.record_batch(
                [chunk.column("doc"), chunk.column("tag"), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                ["doc", "tag", "removed", "pieces", "sha", "kept"],
            )

    return rows.mapInArrow(run, "doc long, tag long, removed long, pieces long, sha string, kept binary")


def dedup(docs: DataFrame, length: int = 200, gram: int | None = None, texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (doc_id, text).

    With ``texts`` the column ``kept`` (the remaining bytes) is added.
    """
    gram = gram or min(GRAM, max(1, length // 3))
    keyed = recur.keyed(docs)
    files = files_for(docs.count())
    recurring = recur.repeated(recur.spans(keyed, "byte", length, gram), files)
    touched = recur.touched(keyed, recurring, files)
    different = written(recur.distinct_spans(recurring.where("mixed")), "different", files)
    windows = _windows(_contexts(touched, _marked(different, length), length), length)
    alone = _recurring(written(windows, "windows"))
    known = different.where("n > 1").select(F.col("key").alias("_key"), F.col("whole").alias("_whole"))
    equal = (F.col("key") == F.col("_key")) & (F.col("whole") == F.col("_whole"))
    spot = F.col("spot")
    whole = recurring.where("NOT mixed").unionByName(recurring.where("mixed").join(known, equal, "left_semi"))
    whole = whole.select("doc", recur.tag(spot).alias("tag"), recur.first(spot).alias("first"), recur.count(spot).alias("count"))
    cut = _cut(touched, whole.unionByName(alone), length, gram)
    if not texts:
        cut = cut.drop("kept")
    cut = cut.withColumnsRenamed({"doc": "_doc", "tag": "_tag"})
    same = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    columns = [
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"),
        F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("pieces", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "whole_sha").alias("kept_sha256"),
    ]
    if texts:
        return keyed.withColumn("whole_sha", F.sha2(raw, 256)).join(cut, same, "left").select(
            *columns, F.coalesce("kept", raw).alias("kept")
        )
    base = keyed.select("doc", "tag", "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole_sha"))
    columns[1] = "n_bytes"
    return base.join(cut, same, "left").select(*columns)
