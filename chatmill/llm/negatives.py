"""Hard negatives by Fagin's threshold algorithm on integer vectors.

Vectors are quantised to integers once and written in an order that puts equal labels side
by side.  A task cuts the rows it reads into chunks of ``CHUNK`` rows and sorts
each chunk once in every dimension.  An anchor walks these lists from the end
that its sign prefers (*sorted access*), scores every row it meets for the first
time by the exact integer inner product (*random access*), and keeps the best
rows of every window of scores.  What has not been met yet scores at most the
threshold, the inner product of the anchor with the values its lists have come
to.  It stops once the threshold lies strictly below each window's kth score
(so that ties by id are all met), or below the window's lower end.  What the
task kept from earlier chunks counts, so later chunks stop sooner.

Anchors are taken in blocks of about ``BLOCK``; a block and its windows are what the
driver and every task hold, whatever the table's size.  Each block is one pass over all
vectors for the positives (one window without bounds, rows of the anchor's label) and one for the
negatives (a window for each positive, rows of other labels); every task returns at most k rows a window, which are
cut to k again after one small shuffle.  Labels need no groups, so a label that holds a
third of all rows is spread over as many chunks.

Defined cases: rows with a null id, label, vector or component, or a component that is not
finite, take no part; shorter vectors count as if filled up with zeros, an
empty one scores 0; quantised components beyond ``LIMIT`` (|x| above 65,536) count as the limit, so
scores fit a long up to 16,384 dimensions; a row is known by its id: rows that
repeat an anchor's id are not its positives, repeated anchor rows are anchors of
their own and all their rows come out; anchors with no positive or windows with
no row return nothing; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.llm.store import ship, written
from chatmill.session import shared_dir

CHUNK = 4096
BLOCK = 1024
LIMIT = 1 << 24
FIRST = 16  # depth of the first sorted access

_FOUND = "anchor long, place int, vec_id long, score long"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, parts`` of the rows that take part; ``parts``: floor(scale * x) of every component."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    held = F.transform(whole, lambda x: F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    taking = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    return rows.where(taking).select("vec_id", F.col("label").cast("long").alias("label"), held.alias("parts"))


def _matrix(parts: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    sizes = np.diff(parts.offsets.to_numpy())
    out = np.zeros((len(parts), width))
    row = np.repeat(np.arange(len(parts)), sizes)
    column = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = parts.flatten().to_numpy(zero_copy_only=False)
    return out


class Anchors:
    """A block of anchors with the score windows each is asked for."""

    def __init__(self, table: pa.Table, width: int, windows: dict[int, list[tuple[int, int]]] | None = None):
        table = table.combine_chunks()
        self.number = table["anchor"].to_pylist()
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        parts = table["parts"].combine_chunks() if isinstance(table["parts"], pa.ChunkedArray) else table["parts"]
        self.vectors = _matrix(parts, width)
        self.most = np.abs(self.vectors).max(initial=0)
        #: Per anchor (low, high) of each window; without windows one that takes all scores of the anchor's own label.
        self.windows = [[(None, None)] if windows is None else windows.get(n, []) for n in self.number]
        self.same = windows is None


class Chunk:
    """Rows with their lists: ``order[d]`` are the rows by ascending value in dimension d."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(vectors, self.order.T, axis=0).T
        self.most = np.abs(vectors).max(initial=0)


def dot(vectors: np.ndarray, anchor: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products: in doubles while all sums stay below 2^53, else in 64-bit integers."""
    if most * vectors.shape[1] < 1 << 53:
        return (vectors @ anchor).astype(np.int64)
    return vectors.astype(np.int64) @ anchor.astype(np.int64)


class Best:
    """The first k rows of one window: highest score first, ties by smaller id."""

    def __init__(self, low: int | None, high: int | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = self.ids = np.zeros(0, dtype=np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(self.scores) == self.k:
            better = scores >= self.scores[-1]
            scores, ids = scores[better], ids[better]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]

    def done(self, threshold: int) -> bool:
        """No row that scores at most ``threshold`` belongs here."""
        full = len(self.scores) == self.k and threshold < self.scores[-1]
        return full or (self.low is not None and threshold < self.low)


def search(chunk: Chunk, anchor: np.ndarray, taken, windows: list[Best], most: float) -> int:
    """Run the threshold algorithm for one anchor on one chunk; returns the number of rows scored.

    ``taken(ids, labels)`` says which rows count.
    """
    rows, used = len(chunk.ids), np.flatnonzero(anchor)
    weights = anchor[used]
    down = weights > 0  # lists read from their upper end
    most *= chunk.most
    if not len(used):  # every score is 0: any row is as good as met
        met = taken(chunk.ids, chunk.labels)
        for window in windows:
            window.take(np.zeros(int(met.sum()), dtype=np.int64), chunk.ids[met])
        return rows

    def threshold(depth: int) -> int:
        return int(dot(chunk.values[used, np.where(down, rows - 1 - depth, depth)][None, :], weights, most)[0])

    met = np.zeros(rows, dtype=bool)
    depth, step, scored = 0, FIRST, 0
    while depth < rows and scored < rows:
        if all(window.done(threshold(depth)) for window in windows):
            break
        upto = min(rows, depth + step)
        along = np.arange(depth, upto)
        got = chunk.order[used[:, None], np.where(down[:, None], rows - 1 - along, along)].ravel()
        before = met.copy()
        met[got] = True
        fresh = np.flatnonzero(met & ~before)
        scored += len(fresh)
        counts = fresh[taken(chunk.ids[fresh], chunk.labels[fresh])]
        if len(counts):
            scores, ids = dot(chunk.vectors[counts], anchor, most), chunk.ids[counts]
            for window in windows:
                window.take(scores, ids)
        depth, step = upto, 2 * step
    return scored


def searched(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The first k rows of every window among the rows of one task, as ``_FOUND``."""
    width = anchors.vectors.shape[1]
    best = [[Best(low, high, k) for low, high in windows] for windows in anchors.windows]

    def run(held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        parts = table["parts"].combine_chunks()
        parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
        rows = Chunk(table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(parts, width))
        labels = set(np.unique(rows.labels).tolist())
        for number in range(len(anchors.ids)):
            me, label = anchors.ids[number], anchors.labels[number]
            if not best[number] or (anchors.same and label not in labels):
                continue
            if anchors.same:
                taken = lambda ids, of, me=me, label=label: (of == label) & (ids != me)
            else:
                taken = lambda ids, of, label=label: of != label
            search(rows, anchors.vectors[number], taken, best[number], anchors.most)

    held, size = [], 0
    for batch in batches:
        while size + batch.num_rows >= chunk:
            held.append(batch.slice(0, chunk - size))
            batch = batch.slice(chunk - size)
            run(held)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        run(held)
    numbers, places, ids, scores = [], [], [], []
    for number, windows in zip(anchors.number, best):
        for place, window in enumerate(windows):
            numbers += [number] * len(window.ids)
            places += [place] * len(window.ids)
            ids += window.ids.tolist()
            scores += window.scores.tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
        names=["anchor", "place", "vec_id", "score"],
    )


def _first(rows: DataFrame, anchors: Anchors, k: int, chunk: int) -> DataFrame:
    """``anchor, place, vec_id, score, rank``: the first k rows of every window over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)  # at most a block of anchors
    found = rows.mapInArrow(lambda batches: searched(batches, shared.value, k, chunk), _FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has vec_id, label, embedding; ``is_anchor`` is a condition on them.
    Negatives score between ``percent[0]`` and ``percent[1]`` per cent of their positive.
    """
    spark = rows.sparkSession
    ship(spark)
    ready = quantised(rows).withColumn("salt", F.xxhash64("vec_id", "parts"))
    ready = written(ready.repartitionByRange("label", "salt").sortWithinPartitions("label", "salt"), "negatives-vectors")
    width = ready.agg(F.max(F.size("parts"))).head()[0] or 0
    numbered = ready.where(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "parts")
    numbered = written(numbered, "negatives-anchors")
    blocks = -(-numbered.count() // block)
    path = f"{shared_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ready = ready.select("vec_id", "label", "parts")
    for number in range(blocks):
        mine_ = numbered.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == number).toArrow()
        near = _first(ready, Anchors(mine_, width), positives, chunk).toArrow().to_pylist()  # block * positives rows
        near.sort(key=lambda r: (r["anchor"], r["rank"]))
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in near:
            low, high = -(-percent[0] * r["score"] // 100), percent[1] * r["score"] // 100
            windows.setdefault(r["anchor"], []).append((low, high))
        told = {r["anchor"]: [] for r in near}
        for r in near:
            told[r["anchor"]].append((r["vec_id"], r["score"]))
        names = dict(zip(mine_["anchor"].to_pylist(), mine_["vec_id"].to_pylist()))
        pairs = [(a, place, names[a], *p) for a, all_ in told.items() for place, p in enumerate(all_)]
        given = spark.createDataFrame(pairs, "_anchor long, _place int, anchor_id long, positive_id long, positive_score long")
        far = _first(ready, Anchors(mine_, width, windows), negatives, chunk)
        same = (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place"))
        far.join(given, same).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.parquet(f"{path}/block={number}")
    if not blocks:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")


def sql(embeddings: str = "embeddings") -> str:
    """The same in DuckDB's SQL (5 positives, 10 negatives, 30 to 90 per cent, every seventh label moved)."""
    return f"""
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM {embeddings}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a_id, b_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 5)
SELECT p.a_id AS anchor_id, p.b_id AS positive_id,
       row_number() OVER (PARTITION BY p.a_id, p.b_id ORDER BY s.score DESC, s.b_id)::INT AS rank,
       s.b_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a_id = p.a_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a_id, p.b_id ORDER BY s.score DESC, s.b_id) <= 10"""
