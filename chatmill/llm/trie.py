"""The prefix trie of conversations, by union-find over sorted neighbours.

A conversation is a sequence of turns; a node of the trie is a distinct prefix.
Turns are named by 128 bits of a digest of role and text, so a conversation
becomes one binary key of 16 bytes a turn whose byte order sorts prefixes before
their extensions.  Equal conversations are counted in the map tasks and go on
as one sequence; the distinct sequences are range-partitioned and sorted.

Each partition joins its neighbours by union-find over their LCP edges, deepest
first.  A merge at some depth makes the branching node of that depth; whatever
lies below it and does not touch the ends of the partition is finished, and the
unary nodes between a finished node and its parent are written with it.  What
touches an end stays open.  The partition is then *contracted*: only its open
nodes remain, each without its open child, in sorted order.  Sixty-four
consecutive contracted forests at a time are merged by the same union-find over
the LCP edges between them until one is left, so no task and no driver ever
holds more than a partition or the open nodes of 64 of them.

A node whose parent was still open names it by forest and place; joins with the
table of open nodes, a few rows a partition, fill in the parents at the end.

The digest over a node's own conversations needs all ids in one order: ids are
range-partitioned, joined to strings of ``PIECE`` bytes by the tasks that hold them, and
only these strings meet in the task that hashes a node, as a stream.

Defined cases: null roles and texts are empty; turns with equal numbers come in
the order of their digests, repeated rows are turns of their own; rows without
a conv_id belong to no conversation; an empty table has no nodes, not even a
root; other columns are ignored.  A conversation is one record: its digests (24
bytes a turn) are held by one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import ship, written
from chatmill.session import shared_dir

TURN = 16  # bytes of a turn's name
TOGETHER = 64  # forests merged by one task
ROWS = 200_000  # sequences of one partition at most, about
PIECE = 1 << 16

NODE = "conv_id long, depth long, parent_conv_id long, up int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
ITEM = "place int, lcp int, own_depth int, n long, least long, kids long, leaves long, saved long, own_ends string, key binary, sizes array<long>"
OPEN = "was long, was_place int"
#: A row is a finished node, an open node of this forest, or where an open node of a merged forest went.
ROW = f"kind int, forest long, {NODE}, {ITEM}, {OPEN}"
FIELDS = [part.split()[0] for part in ROW.split(", ")]
NODES, ITEMS, MOVED = 0, 1, 2


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, name, size`` of (conv_id, turn, role, text): texts stay behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return rows.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * TURN).alias("name"),
        F.octet_length(text).cast("long").alias("size"),
    )


def _sequence(turns: Column) -> tuple[Column, Column]:
    return (
        F.unhex(F.array_join(F.transform(turns, lambda t: t["name"]), "")).alias("key"),
        F.transform(turns, lambda t: t["size"]).alias("sizes"),
    )


def sequences(rows: DataFrame) -> DataFrame:
    """``conv_id, key, sizes`` of every conversation, in the order of its turns (null first)."""
    told = F.array_sort(F.collect_list(F.struct("turn", "name", "size")))
    return turns_of(rows).groupBy("conv_id").agg(told.alias("turns")).select("conv_id", *_sequence(F.col("turns")))


def rebuilt(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """As ``sequences``, with each conversation's first turns taken from the first of its family.

    ``h = crc32(conv_id) mod most``: the first h turns are those of conversation
    ``conv_id - conv_id mod family``, the rest its own after its first h.
    """
    head = F.col("conv_id") - F.col("conv_id") % family
    told = F.array_sort(F.collect_list(F.struct("turn", "name", "size")))
    each = turns_of(rows).withColumn("head", head).repartition("head").groupBy("head", "conv_id").agg(told.alias("turns"))
    first = F.first(F.when(F.col("conv_id") == F.col("head"), F.slice("turns", 1, most - 1)), ignorenulls=True)
    families = each.groupBy("head").agg(F.collect_list(F.struct("conv_id", "turns")).alias("all"), first.alias("first"))
    one = families.select("first", F.explode("all").alias("one")).select("first", "one.*")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    taken = F.coalesce(F.slice("first", F.lit(1), h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return one.select("conv_id", F.concat(taken, rest).alias("turns")).select("conv_id", *_sequence(F.col("turns")))


def _pieces(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Ids of one sequence after another, as comma-joined strings of about ``piece`` bytes."""
    part, number, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0
    out: list[tuple] = []

    def flush():
        nonlocal held, size, number
        if held:
            out.append((now, part, number, ",".join(held)))
            number += 1
        held, size = [], 0

    for batch in batches:
        for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
            if seq != now or size > piece:
                flush()
            now = seq
            held.append(str(conv))
            size += len(held[-1]) + 1
        if len(out) >= 1000:
            yield _batch(out, "seq binary, part int, number int, ids string")
            out.clear()
    flush()
    yield _batch(out, "seq binary, part int, number int, ids string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a sequence from its strings in order; only the running digest is held."""
    now, digest = None, None
    schema = "seq binary, ends string"
    for batch in batches:
        out = []
        for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if seq == now:
                digest.update(b",")
            else:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = seq, hashlib.sha256()
            digest.update(ids.encode())
        yield _batch(out, schema)
    if now is not None:
        yield _batch([(now, digest.hexdigest())], schema)


_ARROW = {
    "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), _ARROW[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def common(a: bytes, b: bytes) -> int:
    """Number of leading turns that two keys share."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:  # the longest equal prefix, by halves
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """Union-find over a run of items in sorted order.

    An item is a distinct sequence or an open node of an earlier forest without
    its open child: its depth and what was counted in it.  ``edges[i]`` is the LCP of items i and i + 1.
    """

    def __init__(self, items: list[dict], edges: list[int], whole: bool):
        self.edges, self.whole = edges, whole
        count = len(items)
        self.root = list(range(count))
        self.depth = [x["own_depth"] for x in items]
        self.n = [x["n"] for x in items]
        self.least = [x["least"] for x in items]
        self.kids = [x["kids"] for x in items]
        self.leaves = [x["leaves"] for x in items]
        self.saved = [x["saved"] for x in items]
        self.ends = [x["own_ends"] for x in items]
        self.sizes = [None if x["sizes"] is None else np.concatenate([[0], np.cumsum(x["sizes"], dtype=np.int64)]) for x in items]
        self.left = [i == 0 and not whole for i in range(count)]
        self.right = [i == count - 1 and not whole for i in range(count)]
        #: The node of a set of items: nodes at equal depth become one when their sets merge.
        self.node = list(range(count))
        self.alias = list(range(count))
        self.known: dict[int, int] = {}  # finished node: its smallest conversation
        self.open: dict[int, int] = {}  # open node: its place among the contracted items
        self.chains: list[tuple] = []
        self.spine_left: list[tuple] = []
        self.spine_right: list[tuple] = []

    @staticmethod
    def _find(up: list[int], x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def _open(self, x: int) -> tuple:
        return (
            self.node[x], self.depth[x], self.n[x], self.least[x], self.kids[x], self.leaves[x], self.saved[x], self.ends[x]
        )

    def _below(self, x: int, depth: int, parent: int) -> tuple:
        """Set x becomes a child of node ``parent`` at ``depth``: what it adds there (n, least, kids, leaves, saved)."""
        if self.left[x] or self.right[x]:
            (self.spine_left if self.left[x] else self.spine_right).append(self._open(x))
            return 0, None, 0, 0, 0
        return self._finish(x, depth, parent)

    def _finish(self, x: int, depth: int, parent: int | None) -> tuple:
        leaves = self.leaves[x] if self.kids[x] else 1
        upto = self.sizes[x]
        self.known[self.node[x]] = self.least[x]
        self.chains.append(
            (depth, self.depth[x], self.least[x], parent, self.n[x], self.kids[x], leaves, self.saved[x], self.ends[x], upto)
        )
        saved = self.saved[x] + (self.n[x] - 1) * int(upto[self.depth[x]] - upto[max(depth, 0)])
        return self.n[x], self.least[x], 1, leaves, saved

    def run(self) -> Forest:
        for edge in np.argsort(-np.asarray(self.edges, dtype=np.int64), kind="stable").tolist():
            depth = self.edges[edge]
            x, y = self._find(self.root, edge), self._find(self.root, edge + 1)
            same = [s for s in (x, y) if self.depth[s] == depth]
            deeper = [s for s in (x, y) if self.depth[s] > depth]
            if same:
                node = self.node[same[0]]
                if len(same) == 2:
                    self.alias[self._find(self.alias, self.node[y])] = self._find(self.alias, node)
            else:
                node = len(self.alias)
                self.alias.append(node)
            parts = [(self.n[s], self.least[s], self.kids[s], self.leaves[s], self.saved[s]) for s in same]
            parts += [self._below(s, depth, node) for s in deeper]
            ends = next((self.ends[s] for s in same if self.ends[s] is not None), None)
            self.root[y] = x
            self.depth[x], self.node[x], self.ends[x] = depth, node, ends
            self.n[x], self.kids[x], self.leaves[x], self.saved[x] = (sum(p[k] for p in parts) for k in (0, 2, 3, 4))
            self.least[x] = min((p[1] for p in parts if p[1] is not None), default=None)
            self.left[x], self.right[x] = self.left[x] or self.left[y], self.right[x] or self.right[y]
            if self.sizes[x] is None:
                self.sizes[x] = self.sizes[y]
        last = self._find(self.root, 0)
        if self.whole:
            self._finish(last, -1, None)
            self.contracted = []
        else:
            self.contracted = [*self.spine_left, self._open(last), *self.spine_right[::-1]]
            self.open = {self._find(self.alias, spine[0]): place for place, spine in enumerate(self.contracted)}
        self.known = {self._find(self.alias, node): least for node, least in self.known.items()}
        return self

    def where(self, node: int) -> tuple[int | None, int | None]:
        """The node's smallest conversation if it is finished, else its place among the contracted items."""
        node = self._find(self.alias, node)
        return self.known.get(node), self.open.get(node)

    def nodes(self) -> Iterator[tuple]:
        """All finished nodes, in the fields of ``NODE``."""
        for above, depth, least, parent, n, kids, leaves, saved, ends, upto in self.chains:
            conv, place = (None, None) if parent is None else self.where(parent)
            for d in range(depth, above, -1):
                saved += (n - 1) * int(upto[d] - upto[max(d - 1, 0)])
                top = d == above + 1
                yield (
                    least, d, conv if top else least, place if top else None, n, kids, leaves, saved, ends
                )
                kids, ends = 1, None

    def items(self, first: dict, last: dict) -> Iterator[tuple]:
        """The contracted forest, in the fields of ``ITEM``; its ends carry their keys and sizes."""
        before = None
        left = len(self.spine_left)
        for place, (_, depth, n, least, kids, leaves, saved, ends) in enumerate(self.contracted):
            lcp = None if before is None else depth if place <= left else before
            at = first if place == 0 else last if place == len(self.contracted) - 1 else None
            key, sizes = (None, None) if at is None else (at["key"], at["sizes"])
            yield place, lcp, depth, n, least, kids, leaves, saved, ends, key, sizes
            before = depth


_NO_NODE, _NO_ITEM, _NO_MOVE = ((None,) * len(s.split(", ")) for s in (NODE, ITEM, OPEN))


def _rows(forest: Forest, number: int, first: dict, last: dict, came: list[tuple]) -> Iterator[pa.RecordBatch]:
    """All rows of one forest; ``came``: (forest, place) of each item of merged forests."""
    out = []
    for node in forest.nodes():
        out.append((NODES, number, *node, *_NO_ITEM, *_NO_MOVE))
        if len(out) >= 10_000:
            yield _batch(out, ROW)
            out = []
    for item in forest.items(first, last):
        out.append((ITEMS, number, *_NO_NODE, *item, *_NO_MOVE))
    for at, (was, place) in enumerate(came):
        conv, up = forest.where(at)
        out.append((MOVED, number, conv, None, None, up, *_NO_NODE[4:], *_NO_ITEM, was, place))
    yield _batch(out, ROW)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one sorted partition of distinct sequences."""
    items: list[dict] = []
    for batch in batches:
        items += batch.to_pylist()
    if not items:
        return
    ends = (items[0], items[-1])
    for x in items:
        x |= {"own_depth": len(x["key"]) // TURN, "kids": 0, "leaves": 0, "saved": 0}
    edges = [common(a["key"], b["key"]) for a, b in zip(items, items[1:])]
    yield from _rows(Forest(items, edges, False).run(), TaskContext.get().partitionId(), *ends, [])


def _merged(table: pa.Table, whole: bool, together: int) -> pa.Table:
    """One forest from up to ``together`` contracted ones."""
    items = sorted(table.to_pylist(), key=lambda x: (x["forest"], x["place"]))
    edges, last = [], items[0]
    for a, b in zip(items, items[1:]):
        last = a if a["key"] is not None else last
        edges.append(b["lcp"] if a["forest"] == b["forest"] else common(last["key"], b["key"]))
    came = [(x["forest"], x["place"]) for x in items]
    ends = (items[0], items[-1])
    number = items[0]["forest"] // together
    return pa.Table.from_batches(list(_rows(Forest(items, edges, whole).run(), number, *ends, came)))


def trie(convs: DataFrame, together: int = TOGETHER, piece: int = PIECE) -> DataFrame:
    """Every node of the trie of ``convs`` (conv_id, key, sizes; conv_id unique).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  ``together``
    forests are merged by one task; ids are joined to strings of about ``piece`` bytes.
    """
    spark = convs.sparkSession
    ship(spark)
    convs = written(convs.withColumn("seq", F.substring(F.unhex(F.sha2("key", 256)), 1, 16)), "trie-conversations")
    sorted_ids = convs.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = sorted_ids.mapInArrow(lambda batches: _pieces(batches, piece), "seq binary, part int, number int, ids string")
    ends = pieces.repartition("seq").sortWithinPartitions("seq", "part", "number").mapInArrow(_hashed, "seq binary, ends string")
    groups = convs.groupBy("seq", "key", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    distinct = groups.join(ends.withColumnRenamed("ends", "own_ends"), "seq").select("key", "sizes", "n", "least", "own_ends")
    distinct = written(distinct, "trie-sequences")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + distinct.count() // ROWS)
    ranged = distinct.repartitionByRange(parts, "key").sortWithinPartitions("key")
    levels = [written(ranged.mapInArrow(_grown, ROW), "trie-forests")]
    while True:
        items = levels[-1].where(F.col("kind") == ITEMS).select("forest", *[p.split()[0] for p in ITEM.split(", ")])
        top = items.agg(F.max("forest")).head()[0]
        if top is None:
            break
        whole = top < together

        def merged(table: pa.Table) -> pa.Table:
            return _merged(table, whole, together)  # written, and so run, in this round

        group = F.floor(F.col("forest") / together)
        levels.append(written(items.groupBy(group.alias("group")).applyInArrow(merged, ROW), "trie-forests"))
        if whole:
            break
    return _with_parents(levels).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _with_parents(levels: list[DataFrame]) -> DataFrame:
    """All nodes of all levels; parents that were open are looked up level by level, from the last."""
    names = [part.split()[0] for part in NODE.split(", ")]
    path = f"{shared_dir(levels[0].sparkSession).rstrip('/')}/trie-open-{uuid.uuid4().hex}"
    found, nodes = None, None  # found: (was, was_place) of the level below -> smallest conversation
    for number in range(len(levels) - 1, -1, -1):
        level = levels[number]
        mine = level.where(F.col("kind") == NODES)
        moved = level.where(F.col("kind") == MOVED).select("forest", "was", "was_place", "conv_id", "up")
        if found is not None:
            at = found.withColumnsRenamed({"was": "_was", "was_place": "_place", "conv_id": "_conv"})
            same = (F.col("forest") == F.col("_was")) & (F.col("up") == F.col("_place"))
            done, still = mine.where("up IS NULL"), mine.where("up IS NOT NULL")
            told = still.join(at, same).withColumn("parent_conv_id", F.col("_conv"))
            mine = done.select(*names).unionByName(told.select(*names))
            further = moved.where("up IS NOT NULL").join(at, same)
            moved = moved.where("up IS NULL").select("was", "was_place", "conv_id").unionByName(
                further.select("was", "was_place", F.col("_conv").alias("conv_id"))
            )
        if number:
            to = f"{path}/{number}"
            moved.select("was", "was_place", "conv_id").write.parquet(to)
            found = level.sparkSession.read.schema("was long, was_place int, conv_id long").parquet(to)
        nodes = mine.select(*names) if nodes is None else nodes.unionByName(mine.select(*names))
    return nodes


def sql(conversations: str = "conversations") -> str:
    """The same of rebuilt conversations, in DuckDB's SQL (families of 5, crc32 mod 9)."""
    step = "xor(a >> 1, 3988292384::UBIGINT * (a & 1::UBIGINT))"
    byte = f"list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: {step})"
    digits = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {digits}), lambda c, b: {byte}), 4294967295::UBIGINT)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS name
  FROM {conversations} WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS place FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS head, ({crc} % 9)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, o.place, o.role, o.text FROM c JOIN o ON o.conv_id = c.head AND o.place <= h
  UNION ALL
  SELECT c.conv_id, o.place, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.place > h),
s AS (SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.place) FILTER (r.place IS NOT NULL), []) AS seq
      FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM s),
n AS (
  SELECT depth, seq[:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CASE WHEN len(seq) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends,
         (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(any_value(seq)[depth].text) ELSE 0 END AS own
  FROM p GROUP BY depth, seq[:depth]),
k AS (SELECT depth - 1 AS depth, prefix[:depth - 1] AS prefix, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (depth, prefix)),
u AS (SELECT f.*, unnest(range(0, depth + 1)) AS above FROM f),
a AS (SELECT above AS depth, prefix[:above] AS prefix, sum(own) AS saved, count(*) FILTER (kids = 0) AS leaves FROM u GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
       a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN a USING (depth, prefix) LEFT JOIN f up ON up.depth = f.depth - 1 AND up.prefix = f.prefix[:f.depth - 1]"""
