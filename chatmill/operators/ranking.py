"""Global ranks, running totals and exact order statistics without one-task windows.

All of them split the key space by leading digits of the key, so the size of
every window partition is bounded by the key type or shrinks with the number of
buckets, whatever the data looks like.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.session import materialise

# Ship the two bit functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hex digits of the bucket of a digest: 65,536 buckets of equal expected size.
BUCKET_DIGITS = 4
#: A window over unique positions holds at most 2**POSITION_BITS rows.
POSITION_BITS = 20


def _everything() -> Window:
    """Window over a table whose row count is bounded by construction."""
    return Window.partitionBy(F.lit(0))


def rank_by_digest(df: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """1-based global rank by a unique hex digest column.

    Rows are shuffled once by the leading digits; only the at most 65,536 bucket
    counts meet in one place, and that table is what is broadcast.
    """
    bucketed = df.withColumn("_bucket", F.substring(key, 1, BUCKET_DIGITS))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(rank, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_before", "_inside")
    )


def digest_cuts(df: DataFrame, key: str, fractions: Sequence[Column]) -> DataFrame:
    """One row ``(n, cut_0, cut_1, ...)``: the digests at 0-based position ``floor(n * f)``.

    A cut past the end is null.  Only the digest column is read; the two passes
    are a bucket count and the ordering of the few buckets that hold a cut.
    """
    keys = df.select(
        F.col(key).alias("_key"), F.substring(key, 1, BUCKET_DIGITS).alias("_bucket")
    )
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    through = _everything().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ladder = counts.select(
        "_bucket",
        "_n",
        F.sum("_n").over(through).alias("_end"),
        F.sum("_n").over(_everything()).alias("n"),
    )
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("cut"), F.floor(F.col("n") * f).cast("long").alias("at"))
            for i, f in enumerate(fractions)
        ]
    )
    wanted = ladder.select("_bucket", "_n", "_end", F.explode(targets).alias("t")).where(
        (F.col("t.at") >= F.col("_end") - F.col("_n")) & (F.col("t.at") < F.col("_end"))
    )
    spots = wanted.select(
        "_bucket", "t.cut", (F.col("t.at") - (F.col("_end") - F.col("_n")) + 1).alias("_nth")
    )
    # At most one row per requested fraction, hence safe to broadcast.
    few = F.broadcast(spots)
    counted = (
        keys.join(F.broadcast(spots.select("_bucket").distinct()), "_bucket", "left_semi")
        .groupBy("_bucket", "_key")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("_through", F.sum("_copies").over(inside)).join(few, "_bucket")
    found = found.where(F.col("_through") >= F.col("_nth"))
    columns = [
        F.min(F.when(F.col("cut") == i, F.col("_key"))).alias(f"cut_{i}")
        for i in range(len(fractions))
    ]
    return found.agg(*columns)


def running_totals(df: DataFrame, position: str, amounts: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``amounts`` in order of a unique whole-number position.

    Positions are split into digits of 20 bits: rows are summed inside blocks of
    2**20 positions, blocks inside super-blocks, and the few super-blocks of the
    64-bit range last.  Rows are shuffled once, by block.
    """
    block = F.shiftright(F.col(position).cast("long"), POSITION_BITS)
    rows = df.select("*", block.alias("_block"), *[a.alias(f"_v_{n}") for n, a in amounts.items()])

    def through(by: str, order: str) -> Window:
        return (
            Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        )

    per_block = rows.groupBy("_block").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in amounts]
    ).withColumn("_super", F.shiftright("_block", POSITION_BITS))
    per_super = per_block.groupBy("_super").agg(*[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in amounts])
    top = _everything().orderBy("_super").rowsBetween(Window.unboundedPreceding, 0)
    super_before = per_super.select(
        "_super",
        *[(F.sum(f"_s_{n}").over(top) - F.col(f"_s_{n}")).alias(f"_sb_{n}") for n in amounts],
    )
    block_before = per_block.join(super_before, "_super").select(
        "_block",
        *[
            (
                F.sum(f"_t_{n}").over(through("_super", "_block"))
                - F.col(f"_t_{n}")
                + F.col(f"_sb_{n}")
            ).alias(f"_b_{n}")
            for n in amounts
        ],
    )
    summed = rows.select(
        "*", *[F.sum(f"_v_{n}").over(through("_block", position)).alias(f"_r_{n}") for n in amounts]
    )
    helper = [f"_{k}_{n}" for n in amounts for k in ("v", "r", "b")]
    return (
        summed.join(block_before, "_block")
        .select("*", *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in amounts])
        .drop("_block", *helper)
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, spread: Column | None = None
) -> DataFrame:
    """First ``k`` rows of each group in ``order``, with their ``row_no``.

    For small ``k`` Spark itself cuts every map task down to ``k`` rows per group
    before the shuffle.  With ``spread`` (a column that tells rows apart) each group
    is cut in 64 parts first, so that no task receives more of a hot group than 1/64
    plus 64 * k rows, however large ``k`` is.  Ties in ``order`` are the caller's to break.
    """
    if spread is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(64)))
        part = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
        df = salted.withColumn("_part", part).where(F.col("_part") <= k).drop("_part", "_salt")
    row_no = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("row_no", row_no).where(F.col("row_no") <= k)


def nth_of_histogram(
    hist: DataFrame, value: str, count: str, fractions: Mapping[str, Column]
) -> DataFrame:
    """One row of order statistics ``sorted[floor(n * f)]`` from (value, count) rows.

    Also gives ``n`` and ``max``.  The caller bounds the number of distinct values.
    """
    through = _everything().orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ladder = hist.select(
        value,
        F.sum(count).over(through).alias("_through"),
        F.sum(count).over(_everything()).alias("_n"),
    )
    picks = [
        F.min(F.when(F.col("_through") >= F.floor(F.col("_n") * f) + 1, F.col(value))).alias(name)
        for name, f in fractions.items()
    ]
    n = F.coalesce(F.max("_n"), F.lit(0)).alias("n")
    return ladder.agg(n, *picks, F.max(value).alias("max"))


#: Up to so many rows a selection is a top-k of every task, merged on the driver.
FEW = 10_000
_DIGIT = 16


def _cut(keys: DataFrame, names: Sequence[str], n: int) -> list[int]:
    """The keys of the ``n``-th row in ascending order, by refining a histogram of one digit at a time.

    A round counts at most 65,536 digits, after counting them in the map tasks;
    what comes to the driver is one digit and one count.
    """
    sign, mask = 1 << 63, (1 << _DIGIT) - 1
    bound: list[int] = []
    same, left = F.lit(True), n
    for name in names:
        low, high = (x + sign for x in keys.where(same).agg(F.min(name), F.max(name)).head())
        bits = F.col(name).bitwiseXOR(F.lit(-sign))  # as an unsigned number: ascending with the key
        shift = 48
        while shift and low >> shift == high >> shift:  # digits that all keys share
            shift -= _DIGIT
        prefix = low >> shift + _DIGIT
        while shift >= 0:
            inside = same & (F.shiftrightunsigned(bits, shift + _DIGIT) == prefix) if shift < 48 else same
            digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(mask))
            hist = keys.where(inside).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("rows"))
            through = _everything().orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
            at = hist.withColumn("through", F.sum("rows").over(through)).where(F.col("through") >= left)
            found = at.orderBy("digit").select("digit", (F.col("through") - F.col("rows")).alias("before")).head()
            prefix = prefix << _DIGIT | found["digit"]
            left -= found["before"]
            shift -= _DIGIT
        bound.append(prefix - sign)
        same = same & (F.col(name) == prefix - sign)
    return bound


def first_by(df: DataFrame, n: int, order: Sequence[Column], few: int = FEW) -> DataFrame:
    """The first ``n`` rows in ascending ``order``: whole-number columns without nulls, unique together.

    For a large ``n`` the rows are not sorted or moved: the keys of the last row
    are found from counts, and each row is compared with them.
    """
    if n <= few:
        return df.orderBy(*order).limit(n)
    names = [f"_key_{i}" for i in range(len(order))]
    keys = materialise(df.select(*[k.cast("long").alias(name) for k, name in zip(order, names)]))
    if keys.count() <= n:
        return df
    bound = _cut(keys, names, n)
    below, same = F.lit(False), F.lit(True)
    for key, value in zip(order, bound):
        below = below | (same & (key < value))
        same = same & (key == value)
    return df.where(below | same)


@F.arrow_udf(T.LongType())
def _bits(values: pa.Array) -> pa.Array:
    """Doubles as whole numbers in the same order (NaN last)."""
    x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    x = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pa.array(x ^ ((x >> 63) & np.int64((1 << 63) - 1)))


@F.arrow_udf(T.DoubleType())
def _double(bits: pa.Array) -> pa.Array:
    x = bits.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array((x ^ ((x >> 63) & np.int64((1 << 63) - 1))).view(np.float64))


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], values: Mapping[str, Column], fractions: Sequence[float]
) -> DataFrame:
    """``groups`` and, for each named value, the array of its exact percentiles (interpolated, nulls left out).

    The order statistics are found digit by digit: four rounds, each counting the
    next 16 bits of the values that share the digits found so far.  Counts
    are made in the map tasks, so a group may hold any share of the rows
    and any number of different values.
    """
    each = F.array(*[F.struct(F.lit(name).alias("_name"), v.cast("double").alias("_value")) for name, v in values.items()])
    long = df.select(*groups, F.inline(each)).where("_value IS NOT NULL")
    of = [*groups, "_name"]
    keys = materialise(long.select(*of, _bits(F.col("_value")).bitwiseXOR(F.lit(-(1 << 63))).alias("_bits")))

    def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
        right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
        return left.join(right, same, how).drop(*[f"_r_{c}" for c in on])

    place = (F.col("_n") - 1) * F.col("_fraction")
    asked = F.array(*[F.struct(F.lit(i).alias("_no"), F.lit(float(f)).alias("_fraction")) for i, f in enumerate(fractions)])
    counted = keys.groupBy(*of).agg(F.count(F.lit(1)).alias("_n")).select(*of, "_n", F.inline(asked))
    ends = F.array(F.floor(place), F.ceil(place))
    at = F.posexplode(ends).alias("_end", "_rank")
    targets = materialise(counted.select(*of, "_no", place.alias("_place"), at).withColumn("_prefix", F.lit(0).cast("long")))
    for shift in (48, 32, 16, 0):
        found = keys
        if shift < 48:
            prefixes = targets.select(*of, "_prefix").distinct()
            found = keys.withColumn("_prefix", F.shiftrightunsigned("_bits", shift + _DIGIT))
            found = joined(found, prefixes, [*of, "_prefix"])
        else:
            found = keys.withColumn("_prefix", F.lit(0).cast("long"))
        digit = F.shiftrightunsigned("_bits", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        hist = found.groupBy(*of, "_prefix", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_rows"))
        through = Window.partitionBy(*of, "_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        ladder = hist.withColumn("_through", F.sum("_rows").over(through))
        step = joined(targets, ladder, [*of, "_prefix"])
        step = step.where((F.col("_rank") < F.col("_through")) & (F.col("_rank") >= F.col("_through") - F.col("_rows")))
        targets = materialise(step.select(
            *of, "_no", "_place", "_end", (F.col("_rank") - F.col("_through") + F.col("_rows")).alias("_rank"),
            F.shiftleft("_prefix", _DIGIT).bitwiseOR(F.col("_digit")).alias("_prefix"),
        ))
    exact = targets.withColumn("_exact", _double(F.col("_prefix").bitwiseXOR(F.lit(-(1 << 63)))))
    pair = exact.groupBy(*of, "_no", "_place").agg(
        F.max(F.when(F.col("_end") == 0, F.col("_exact"))).alias("_low"),
        F.max(F.when(F.col("_end") == 1, F.col("_exact"))).alias("_high"),
    )
    part = F.col("_place") - F.floor("_place")
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("_no", between.alias("_v")))), lambda x: x["_v"])
    arrays = pair.groupBy(*of).agg(told.alias("_all"))  # one value a fraction
    return arrays.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == n, F.col("_all"))).alias(n) for n in values])
