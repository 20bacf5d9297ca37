"""Embedding near-dedup by collision-counting projections.

Vectors are scaled to length one and projected on many random directions.  A
table consists of a few coarsely quantised projections, which name a cell, and
one projection by which Spark sorts the cell.  A pair collides in a table when
both lie in one cell and each lies in the window centred on the other.  Pairs
that collide in at least ``need`` of the tables are verified by their cosine in
double precision.

The numbers are calibrated for pairs exactly at the limit: cells are made fine
enough that one holds about ``crowd`` unrelated vectors, whatever the size of
the table (more quantised projections for more vectors), and as many tables are
taken as give the wanted recall for ``need`` collisions.

Nothing is written per pair.  A pair is verified in the table of its
``need``-th collision only, so link counts simply add up; a cell passes on its
link counts and a spanning forest of its links.  Cells of more than ``block``
vectors are dealt out as pairs of blocks.  Equal vectors are one class and take
part once.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; a null
id links with nothing, its component is null and it is kept; rows that share an
id are one node with a vector for each row; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.llm.graph import components
from chatmill.llm.store import files_for, ship, written
from chatmill.llm.text import mix

CELL = 2.0  # width of a quantised projection, for vectors of length one and normal directions
SEED = 17


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(distance: float, width: float = CELL) -> float:
    """Chance that two points at ``distance`` get one cell number on a random shifted grid."""
    if distance == 0:
        return 1.0
    r = width / distance
    return 1 - 2 * _normal(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Plan:
    cells: int  # quantised projections of a table
    window: float  # half width of the query-centred window
    tables: int
    need: int

    @staticmethod
    def calibrated(n: int, least_cosine: float, recall: float = 0.998, crowd: int = 64, need: int = 2) -> Plan:
        distance = math.sqrt(max(2 - 2 * least_cosine, 1e-12))
        window = 2.6 * distance
        unrelated = same_cell(math.sqrt(2))
        cells = max(1, round(math.log(max(n / crowd, 1)) / -math.log(unrelated)))
        hit = same_cell(distance) ** cells * (1 - 2 * _normal(-2.6))
        tables = need
        while sum(math.comb(tables, k) * hit**k * (1 - hit) ** (tables - k) for k in range(need)) > 1 - recall:
            tables += 1
        return Plan(cells, window, tables, need)

    def directions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions (those of the cells, table by table, then one a table for the window) and shifts of the cells."""
        rng = np.random.default_rng([SEED, size])
        return rng.normal(size=(size, self.tables * (self.cells + 1))), rng.uniform(0, CELL, self.tables * self.cells)

    def project(self, unit: np.ndarray, tables: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and window positions of unit vectors, for the first ``tables`` (all) tables."""
        tables = self.tables if tables is None else tables
        directions, shifts = _directions(self, unit.shape[1])
        used, windows = tables * self.cells, self.tables * self.cells
        steps = np.floor((unit @ directions[:, :used] + shifts[:used]) / CELL).astype(np.int64)
        steps = steps.reshape(len(unit), tables, self.cells).view(np.uint64)
        key = np.full((len(unit), tables), unit.shape[1], dtype=np.uint64)
        for k in range(self.cells):
            key = mix(key ^ steps[:, :, k], 60)
        return key.view(np.int64), unit @ directions[:, windows : windows + tables]


@lru_cache(maxsize=8)
def _directions(plan: Plan, size: int) -> tuple[np.ndarray, np.ndarray]:
    return plan.directions(size)


def _single(vectors: DataFrame) -> bool:
    """Whether components are 32-bit floats, and travel as such."""
    return vectors.schema["embedding"].dataType.elementType.typeName() == "float"


def _units(raw: list[bytes], single: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float32 if single else np.float64).astype(np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """``vec, tag, copies, embedding``: the different usable vectors, by the smallest id and a digest."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    usable = usable.where(F.exists("embedding", lambda x: x != 0))
    return (
        usable.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"))
        .select("vec", F.xxhash64("embedding").alias("tag"), "copies", "embedding")
    )


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with vectors of one length, as matrices of unit vectors."""
    lists = batch.column("embedding")
    sizes = pc.list_value_length(lists).to_numpy()
    for size in np.unique(sizes).tolist():
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        x = part.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, size)
        yield part, x


def _cells(different: DataFrame, plan: Plan, with_vectors: bool) -> DataFrame:
    """``table, cell`` of every vector in every table, with ``at, vec, tag, copies, vector`` if wanted."""
    single = _single(different)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                for part, x in _by_length(whole.slice(start, 500)):
                    key, at = plan.project(x / np.linalg.norm(x, axis=1, keepdims=True))
                    exact = x.astype(np.float32) if single else x
                    raw = pa.array([row.tobytes() for row in exact], pa.binary())
                    for t in range(plan.tables):
                        columns = [pa.array(np.full(len(x), t)), pa.array(key[:, t])]
                        names = ["table", "cell"]
                        if with_vectors:
                            columns += [pa.array(at[:, t]), *(part.column(c) for c in ("vec", "tag", "copies")), raw]
                            names += ["at", "vec", "tag", "copies", "vector"]
                        yield pa.record_batch(columns, names)

    schema = "table long, cell long" + (", at double, vec long, tag long, copies long, vector binary" if with_vectors else "")
    return different.mapInArrow(run, schema)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = (np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()
        if held and values[0].tolist() != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, len(batch)]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = values[-1].tolist()
    if held:
        yield pa.Table.from_batches(held)


def linked(
    unit: np.ndarray, at: np.ndarray, plan: Plan, table: int, left: np.ndarray, right: np.ndarray, least_cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left x right, each unordered pair once) that collide often enough, for the last time
    needed in ``table``, and have the cosine.

    ``at`` are the positions on the table's window projection, by which ``left`` and ``right`` are
    sorted: the partners of a vector are a run of ``right``.
    """
    begin = np.searchsorted(at[right], at[left] - plan.window, "left")
    end = np.searchsorted(at[right], at[left] + plan.window, "right")
    if left is right:
        begin = np.arange(1, len(left) + 1)
    upto = np.concatenate([[0], np.cumsum(np.maximum(end - begin, 0))])
    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if not upto[-1]:
        return found_i[0], found_j[0]
    key, other = plan.project(unit, table)
    row = 0
    while row < len(left):
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + 400_000, "right")) - 1)
        sizes = np.diff(upto[row : stop + 1])
        i = np.repeat(left[row:stop], sizes)
        j = right[np.arange(upto[row], upto[stop]) - np.repeat(upto[row:stop] - begin[row:stop], sizes)]
        row = stop
        before = np.zeros(len(i), dtype=np.int64)
        for t in range(table):
            before += (key[i, t] == key[j, t]) & (np.abs(other[i, t] - other[j, t]) <= plan.window)
        own = before == plan.need - 1
        i, j = i[own], j[own]
        good = np.einsum("ij,ij->i", unit[i], unit[j]) >= least_cosine
        found_i.append(i[good])
        found_j.append(j[good])
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that is connected, for each of n."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(different: DataFrame, plan: Plan, least_cosine: float, block: int) -> DataFrame:
    """``vec, tag, links, root``: link counts by cell, and the smallest id the cell connects the vector with."""
    crowded = (
        _cells(different, plan, False).groupBy("table", "cell").count().where(F.col("count") > block)
        .select(F.col("table").alias("_table"), F.col("cell").alias("_cell"), F.ceil(F.col("count") / block).alias("blocks"))
    )
    rows = _cells(different, plan, True).join(
        crowded, (F.col("table") == F.col("_table")) & (F.col("cell") == F.col("_cell")), "left"
    )
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vec", "tag"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    keys = ["table", "cell", "low", "high"]
    rows = rows.select(
        "table", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "at", "vec", "tag", "copies", "vector",
    )
    single = _single(different)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, keys):
            if len(group) < 2:
                continue
            unit = _units(group.column("vector").to_pylist(), single)
            own = group.column("own").to_numpy()
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            left = np.flatnonzero(own == low)
            right = left if low == high else np.flatnonzero(own == high)
            i, j = linked(unit, group.column("at").to_numpy(), plan, group.column("table")[0].as_py(), left, right, least_cosine)
            if not len(i):
                continue
            vec, copies = group.column("vec").to_numpy(), group.column("copies").to_numpy()
            order = np.argsort(vec, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            links = np.zeros(len(vec), dtype=np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = vec[order][forest(len(vec), place[i], place[j])][place]
            some = np.flatnonzero(links)
            columns = [vec[some], group.column("tag").to_numpy()[some], links[some], root[some]]
            yield pa.record_batch([pa.array(c) for c in columns], ["vec", "tag", "links", "root"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "at")
    return dealt.mapInArrow(run, "vec long, tag long, links long, root long")


def near_duplicates(
    vectors: DataFrame, least_cosine: float = 0.95, recall: float = 0.998, block: int = 2048
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding)."""
    ship(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    files = files_for(vectors.count(), 50_000)
    different = written(classes(vectors), "vector-classes", files)
    plan = Plan.calibrated(different.count(), least_cosine, recall)
    links = written(_links(different, plan, least_cosine, block), "vector-links")
    counts = links.groupBy(F.col("vec").alias("_vec"), F.col("tag").alias("_tag")).agg(F.sum("links").alias("links"))
    by_class = different.join(counts, (F.col("vec") == F.col("_vec")) & (F.col("tag") == F.col("_tag")), "left").select(
        "vec", F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    member = F.col("vec_id").isNotNull() & F.col("embedding").eqNullSafe(F.col("_embedding"))
    rows = written(vectors.join(by_class, member, "left").select("vec_id", "vec", "n_links"), "vector-rows", files)
    edges = links.select(F.col("vec").alias("a"), F.col("root").alias("b"))
    edges = edges.unionByName(rows.where("vec <> vec_id").select(F.col("vec").alias("a"), F.col("vec_id").alias("b")))
    groups = components(edges, files)
    found = rows.join(groups, F.col("vec_id") == F.col("node"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def sql(embeddings: str = "embeddings") -> str:
    """The same in DuckDB's SQL, all pairs compared (cosine of 0.95)."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM {embeddings}),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
      WHERE list_dot_product(p.e, q.e) / p.n / q.n >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.x),
c AS (SELECT x, min(c) AS c FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
