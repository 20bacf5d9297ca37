"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatmill.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, anchor string"


def plain(data, positives=5, k=10):
    """Result rows by scoring every pair with Python integers."""
    ready = []
    for v, e, label, *_ in data:
        if v is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [max(-negatives.LIMIT, min(negatives.LIMIT, math.floor(256 * float(x)))) for x in e]
        ready.append((v, label, q))
    out = []
    for a, label, q in ready:
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w)), v, of) for v, of, w in ready]
        near = sorted((s, v) for s, v, of in scored if of == label and v != a)[:positives]
        for s, p in near:
            far = sorted((t, v) for t, v, of in scored if of != label and 30 * -s <= 100 * -t <= 90 * -s)[:k]
            out += [(a, p, rank, v, -s, -t) for rank, (t, v) in enumerate(far, 1)]
    return sorted(out)


def data(seed=3, count=400, width=12):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    f32 = lambda x: float(np.float32(x))
    rows = []
    for v in range(count):
        label = 0 if v % 3 == 0 else draw.randrange(4)  # a third has one label
        e = [f32(c + draw.gauss(0, 0.8)) for c in centres[label]]
        if v % 11 == 0:
            e = [f32(x) for x in centres[1]]  # one very common vector: ties
        rows.append((v, e, label, 0, "x"))
    rows += [(1000, None, 1, 0, "x"), (1010, [1.0] * width, None, 0, "x"), (None, [1.0] * width, 1, 0, "x")]
    rows += [(1020, [float("nan")] + [1.0] * (width - 1), 1, 0, "x"), (1030, [None] + [1.0] * (width - 1), 1, 0, "x")]
    rows += [(1040, [float("inf")] * width, 1, 0, "x"), (1050, [], 1, 0, "x"), (1060, [0.0] * width, 2, 0, "x")]
    rows += [(1070, [1.5, -2.0], 1, 0, "x"), (1080, [3e38] * width, 2, 0, "x"), (1081, [-3e38] * width, 3, 0, "x")]
    rows += [(20, rows[20][1], rows[20][2], 0, "x"), (1090, [2.0] * width, 77, 0, "x")]  # a repeated anchor, a label of its own
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, chunk, k", [(1000, 4096, 10), (13, 16, 3)])
def test_against_all_pairs(spark, rows, block, chunk, k):
    got = negatives.mine(
        rows(data(), SCHEMA).repartition(5), F.col("vec_id") % 10 == 0, negatives=k, block=block, chunk=chunk
    )
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    found = sorted(map(tuple, got.collect()))
    want = plain(data(), k=k)
    assert found == want and len(want) > 100


def test_stops_before_it_has_met_all_rows():
    """With a few strong dimensions the threshold ends the search early, and the result is whole."""
    draw = np.random.default_rng(1)
    vectors = np.floor(draw.exponential(200, (4000, 4)))
    ids = draw.permutation(4000).astype(np.int64)
    chunk = negatives.Chunk(ids, np.zeros(4000, dtype=np.int64), vectors)
    anchor = np.array([300.0, -20.0, 0.0, 80.0])
    scores = (vectors @ anchor).astype(np.int64)
    top = int(scores.max())
    windows = [negatives.Best(None, None, 5), negatives.Best(top // 3, top * 9 // 10, 10), negatives.Best(top + 1, 2 * top, 10)]
    scored = negatives.search(chunk, anchor, lambda i, of: i % 2 == 0, windows, 300.0)
    assert scored < 2500
    for window in windows:
        order = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i % 2 == 0]
        order = [x for x in order if window.low is None or window.low <= -x[0] <= window.high]
        assert list(zip((-window.scores).tolist(), window.ids.tolist())) == sorted(order)[: window.k]


def test_integer_products_beyond_doubles():
    vectors = np.array([[2.0**24, 2.0**24 - 1, 3.0]] * 2)
    assert negatives.dot(vectors, vectors[0], 2.0**48)[0] == 2**48 + (2**24 - 1) ** 2 + 9
    assert negatives.dot(np.tile(vectors, 200), np.tile(vectors[0], 200), 2.0**48)[0] == 200 * (2**48 + (2**24 - 1) ** 2 + 9)


def test_ragged_vectors_are_filled_up():
    parts = pa.array([[1, 2], [], [3, 4, 5]], pa.list_(pa.int32()))
    assert negatives._matrix(parts, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 4, 5]]


def test_empty(spark, rows):
    assert negatives.mine(rows([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    one = rows([(10, [1.0], 1, 0, "x")], SCHEMA)
    assert negatives.mine(one, F.col("vec_id") % 10 == 0).collect() == []
