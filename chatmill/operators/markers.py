"""Which texts contain any of a list of markers: exact substring matching in one pass."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.functions.text import strip
from chatmill.session import materialise

# Ship the function with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def clean_markers(lines: DataFrame, column: str = "marker") -> DataFrame:
    """Trimmed, non-blank, distinct markers."""
    trimmed = lines.select(strip(F.col(column)).alias("marker"))
    return trimmed.where(F.col("marker") != "").distinct()


def _finder(listed):
    """Arrow function: does a text hold one of the (broadcast) markers?

    The markers form one automaton, built once per task, which reads each text
    once whatever their number, up to its first hit.
    """
    built: list = []

    @F.arrow_udf(T.BooleanType())
    def found(texts: pa.Array) -> pa.Array:
        if not built:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for marker in listed.value:
                machine.add_word(marker, True)
            machine.make_automaton()
            built.append(machine)
        search = built[0].iter if listed.value else lambda text: iter(())
        return pa.array(
            [None if t is None else next(search(t), None) is not None for t in texts.to_pylist()], pa.bool_()
        )

    return found


#: Lists up to this many bytes are one automaton that travels with the tasks; longer ones stay distributed.
LISTED = 8 << 20
#: Bytes of the markers of one automaton, and of the texts that pass one copy of it.
SHARD, PASSED = 1 << 20, 256 << 20
#: Bits of the pre-test, and buckets in which the grams of the texts are counted.
BITS, BUCKETS = 26, 1 << 18
GRAM = 8  # bytes
_SEGMENT = 1 << 20


def _mixed(grams: np.ndarray, q: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (grams ^ np.uint64(q * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _grams(data: bytes, q: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all stretches of ``q`` bytes, a segment of the text at a time, with the segment's start."""
    for start in range(0, max(len(data) - q + 1, 0), _SEGMENT):
        part = np.frombuffer(data[start : start + _SEGMENT + q - 1], dtype=np.uint8).astype(np.uint64)
        grams = np.zeros(len(part) - q + 1, dtype=np.uint64)
        for i in range(q):
            grams |= part[i : len(part) - q + 1 + i] << np.uint64(8 * i)
        yield start, _mixed(grams, q)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, n``: how often the grams of a task's texts fall into each bucket."""
    found = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for _, grams in _grams(text.encode() if text else b"", GRAM):
                found += np.bincount((grams & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(found[used])], names=["bucket", "n"])


def _keyed(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``marker, q, key``: the gram of each marker that is rarest in the texts; a short marker is one gram whole."""
    for batch in batches:
        markers, sizes, keys = batch.column(0).to_pylist(), [], []
        for marker in markers:
            data = marker.encode()
            q = min(len(data), GRAM)
            grams = np.concatenate([g for _, g in _grams(data, q)])
            often = counts[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)]
            sizes.append(q)
            keys.append(int(grams[np.lexsort((grams, often))[0]].astype(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(markers, pa.string()), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], names=["marker", "q", "key"]
        )


def _bit(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _shards_of(shared, shards: int):
    """Arrow function: the shards that may hold a marker of a text, by the (broadcast) bits of their keys."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def may(texts: pa.Array) -> pa.Array:
        sizes, bits = shared.value
        out = []
        for text in texts.to_pylist():
            found: set[int] = set()
            data = text.encode() if text else b""
            for q in sizes:
                for _, grams in _grams(data, q):
                    at = _bit(grams)
                    hit = grams[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    found.update(np.unique((hit >> np.uint64(32)) % np.uint64(shards)).tolist())
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.int32()))

    return may


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``digest`` of the texts that hold a marker of their automaton.

    Rows come sorted, so that the markers of an automaton precede its texts; a
    task holds one automaton at a time and no more than a batch of texts.
    """
    import ahocorasick

    now, machine, ready = None, None, False
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("shard", "piece", "salt", "digest", "text"))
        for shard, piece, salt, digest, text in zip(*columns):
            if (shard, piece, salt) != now:
                now, machine, ready = (shard, piece, salt), ahocorasick.Automaton(), False
            if digest is None:
                machine.add_word(text, True)
                continue
            if not ready:
                machine.make_automaton()
                ready = True
            if len(machine) and next(machine.iter(text), None) is not None:
                out.append(digest)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["digest"])


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def matching_digests(texts: DataFrame, text: Column, markers: DataFrame, shard: int = SHARD, passed: int = PASSED) -> DataFrame:
    """``digest`` of every text that contains a marker, for a list of any length.

    Each marker is filed under its gram that is rarest in the texts; a bitmap of
    fixed size over these grams tells each text which shards of the list may
    concern it, usually none.  A shard is cut into automata of bounded size, and
    its texts over as many copies of them as their amount asks for.  Neither the
    list nor the texts meet on the driver or in one task.
    """
    spark = texts.sparkSession
    session = spark.sparkContext
    listed = materialise(markers.select("marker").distinct())
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for row in texts.select(text.alias("t")).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[row[0]] = row[1]  # at most BUCKETS rows
    shared = session.broadcast(counts)
    keyed = listed.mapInArrow(lambda batches: _keyed(batches, shared.value), "marker string, q int, key long")
    keyed = materialise(keyed)
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("marker")), F.lit(0))).head()[0]
    shards = 1 + total // shard
    bit = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
    maps = keyed.groupBy(F.shiftright(bit, 15).alias("at")).agg(F.bitmap_construct_agg((bit % 32768)).alias("bits"))
    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for row in maps.collect():  # 2^BITS bits in all
        bits[row["at"] * 4096 : (row["at"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    sizes = sorted(r[0] for r in keyed.select("q").distinct().collect())
    may = _shards_of(session.broadcast((sizes, bits)), shards).asNondeterministic()

    part = (F.shiftrightunsigned("key", 32) % shards).cast("int")
    filed = keyed.select("marker", part.alias("shard"))
    asked = texts.select(text.alias("text")).where(F.col("text").isNotNull()).withColumn("shards", may(F.col("text")))
    asked = asked.where(F.size("shards") > 0).select(_digest(F.col("text")).alias("digest"), "text", F.explode("shards").alias("shard"))
    asked = materialise(asked)
    load = asked.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes"))
    cut = filed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("marker")) / shard).cast("int").alias("pieces"))
    plan = materialise(cut.join(load, "shard").select("shard", "pieces", F.ceil(F.col("bytes") / passed).cast("int").alias("salts")))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    words = filed.join(plan, "shard").select(
        "shard", F.pmod(F.xxhash64("marker"), F.col("pieces")).cast("int").alias("piece"),
        F.explode(F.transform(numbers("salts"), lambda i: i)).alias("salt"), F.lit(None).cast("binary").alias("digest"),
        F.col("marker").alias("text"),
    )
    rows = asked.join(plan, "shard").select(
        "shard", F.explode(numbers("pieces")).alias("piece"),
        F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int").alias("salt"), "digest", "text",
    )
    place = ["shard", "piece", "salt"]
    met = words.unionByName(rows).repartition(*place).sortWithinPartitions(*place, F.col("digest").asc_nulls_first())
    return met.mapInArrow(_matched, "digest binary").distinct()


def flag_containing(texts: DataFrame, text: Column, markers: DataFrame, flag: str, listed_bytes: int = LISTED) -> DataFrame:
    """Add the boolean ``flag``: does ``text`` contain at least one marker?

    A list of up to ``listed_bytes`` travels with the tasks, and every row of
    ``texts`` is decided by itself.  A longer one stays distributed: see ``matching_digests``.
    """
    few = markers.select("marker").distinct()
    if few.agg(F.coalesce(F.sum(F.octet_length("marker")), F.lit(0))).head()[0] > listed_bytes:
        found = materialise(matching_digests(texts, text, markers)).withColumnRenamed("digest", "_digest")
        marked = texts.withColumn("_of", _digest(text)).join(found, F.col("_of") == F.col("_digest"), "left")
        return marked.withColumn(flag, F.col("_digest").isNotNull()).drop("_of", "_digest")
    listed = sorted(row[0] for row in few.collect())
    shared = texts.sparkSession.sparkContext.broadcast(listed)
    return texts.withColumn(flag, F.coalesce(_finder(shared).asNondeterministic()(text), F.lit(False)))


def containing(texts: DataFrame, text: Column, markers: DataFrame, listed_bytes: int = LISTED) -> DataFrame:
    """Rows of ``texts`` whose ``text`` contains at least one marker (each row once)."""
    return flag_containing(texts, text, markers, "_hit", listed_bytes).where("_hit").drop("_hit")
