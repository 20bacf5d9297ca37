import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chatmill.operators import chat, ranking
from chatmill.plans.combine import shuffle_key, split_exact


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_rank_by_digest(spark, n):
    df = spark.range(n).withColumnRenamed("id", "rec_id").withColumn("k", shuffle_key(42, "rec_id"))
    got = {r.rec_id: r["rank"] for r in ranking.rank_by_digest(df, "k").collect()}
    order = sorted(range(n), key=lambda i: md5(f"42:{i}"))
    assert got == {rec: place + 1 for place, rec in enumerate(order)}


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 21, 2500])
@pytest.mark.parametrize("ratios", [(0.9, 0.05, 0.05), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)])
def test_split_sizes_and_order(spark, n, ratios):
    df = spark.range(n).withColumnRenamed("id", "rec_id")
    got = {r.rec_id: r.split for r in split_exact(df, ratios).collect()}
    order = sorted(range(n), key=lambda i: md5(f"42:{i}"))
    a, b = int(n * ratios[0]), int(n * (ratios[0] + ratios[1]))
    want = {r: "train" if i < a else "val" if i < b else "test" for i, r in enumerate(order)}
    assert got == want


def test_split_ignores_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "rec_id")
    one = sorted(split_exact(df.repartition(1)).collect())
    assert one == sorted(split_exact(df.repartition(16)).collect())


def test_running_totals_over_clumped_sparse_and_negative_positions(rows):
    rng = random.Random(1)
    near = rng.sample(range(2**21), 300)
    far = [rng.randrange(-(2**62), 2**62) for _ in range(200)]
    data = [(p, rng.randrange(5)) for p in set(near + far)]
    got = ranking.running_totals(
        rows(data, "pos long, v int"), "pos", {"n": F.lit(1), "total": F.col("v")}
    ).collect()
    total, want = 0, {}
    for i, (p, v) in enumerate(sorted(data)):
        total += v
        want[p] = (i + 1, total)
    assert {r.pos: (r.n, r.total) for r in got} == want


@pytest.mark.parametrize("k", [2, 1500])
def test_top_per_group_with_a_hot_group(rows, k):
    data = [("hot", i, (i * 37) % 101) for i in range(4000)] + [(f"g{i}", i, i) for i in range(50)]
    df = rows(data, "g string, id long, s long")
    got = ranking.top_per_group(df, ["g"], [F.desc("s"), F.col("id")], k, spread=F.col("id")).collect()
    best = sorted((d for d in data if d[0] == "hot"), key=lambda d: (-d[2], d[1]))[:k]
    assert [r.id for r in sorted(got, key=lambda r: r.row_no) if r.g == "hot"] == [d[1] for d in best]
    assert sum(r.g != "hot" for r in got) == 50


def test_histogram_order_statistics(rows):
    values = [random.Random(5).randrange(40) for _ in range(333)] + [1, 2, 3, 4]
    hist = rows([(v,) for v in values], "v int").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    got = ranking.nth_of_histogram(hist, "v", "c", {"p50": F.lit(0.5), "p99": F.lit(0.99)}).first()
    s = sorted(values)
    assert (got.n, got.p50, got.p99, got.max) == (len(s), s[len(s) // 2], s[int(len(s) * 0.99)], s[-1])
    small = rows([(1, 1), (2, 1), (3, 1), (4, 1)], "v int, c int")
    assert ranking.nth_of_histogram(small, "v", "c", {"p50": F.lit(0.5)}).first().p50 == 3
    none = ranking.nth_of_histogram(small.where("v > 9"), "v", "c", {"p50": F.lit(0.5)}).first()
    assert (none.n, none.p50, none.max) == (0, None, None)


def partitions_hold(df):
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


@pytest.mark.parametrize("n", [1, 37, 2500, 4999, 5000, 9000])
def test_selection_of_any_size_by_counts(spark, n):
    """Ties, negative and very distant keys; the cut equals a full sort."""
    rng = random.Random(4)
    data = [(i, rng.choice([0, 1, -5, 2**62, -(2**62), rng.randrange(10**6), rng.randrange(40)])) for i in range(5000)]
    df = spark.createDataFrame(data, "id long, size long").repartition(64)
    got = ranking.first_by(df, n, [-F.col("size"), F.col("id")], few=0)
    assert sorted(r.id for r in got.collect()) == sorted(i for i, _ in sorted(data, key=lambda x: (-x[1], x[0]))[:n])
    assert "TakeOrdered" not in got._jdf.queryExecution().toString()


def test_half_of_the_largest_records_in_place(spark):
    """Half of the table is chosen, and no task holds more than a 64th of it."""
    text = F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))
    chats = spark.range(0, 12_800, 1, 128).select(
        F.col("id").alias("rec_id"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages")
    )
    got = chat.biggest_records(chats, 6400, few=100)
    want = sorted(range(12_800), key=lambda i: (-(i % 97), i))[:6400]
    assert sorted(r.rec_id for r in got.select("rec_id").collect()) == sorted(want)
    assert max(partitions_hold(got)) <= 12_800 // 64
    assert [r.rec_id for r in chat.biggest_first(chats, 6400, few=100).collect()] == want
    assert sorted(r.rec_id for r in chat.first_n(chats, 6000, few=10).collect()) == list(range(6000))


def test_exact_percentiles_equal_the_built_in(spark):
    rng = random.Random(8)
    values = [0.0, -0.0, 1e300, -1e300, 5e-324, -3.5, 2.0, float("inf"), None]
    data = [(rng.choice(["a", "b", None]), rng.choice([*values, rng.gauss(0, 1), float(rng.randrange(50))]), rng.random()) for _ in range(3000)]
    data += [("hot", 7.0, float(i % 5)) for i in range(4000)] + [("one", 1.25, None), ("none", None, None)]
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(9)
    fractions = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    got = {r.g: (r.v, r.w) for r in ranking.exact_percentiles(df, ["g"], {"v": F.col("v"), "w": F.col("w")}, fractions).collect()}
    both = df.groupBy("g").agg(*[F.percentile(c, F.array(*map(F.lit, fractions))).alias(c) for c in ("v", "w")])
    want = {r.g: (r.v, r.w) for r in both.collect() if r.v or r.w}
    assert got.keys() == want.keys()
    for group, pair in want.items():
        for a, b in zip(got[group], pair):
            assert a == pytest.approx(b, rel=1e-12, nan_ok=True) if b else not a
