"""Mix sources: length cap, upsampling, union, repeatable shuffle, exact split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.draws import digest
from chatmill.operators import ranking
from chatmill.operators.chat import longest_user


@dataclass
class Mixed:
    data: DataFrame
    counts: DataFrame


def upsample(df: DataFrame, times: int) -> DataFrame:
    """Repeat every row ``times`` times with its ``copy`` number; 0 removes the source."""
    return df.select("*", F.posexplode(F.array_repeat(F.lit(0), times)).alias("copy", "_")).drop("_")


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Multiset union that keeps the columns of every source, named in ``source_name``."""
    named = [df.withColumn("source_name", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def shuffle_key(seed: int = 42, *parts: str) -> Column:
    """Digest that orders a repeatable shuffle."""
    return digest(seed, *[F.col(p) for p in parts])


def shuffled(
    df: DataFrame, seed: int = 42, parts: Sequence[str] = ("source_name", "rec_id", "copy"),
    partitions: int | None = None,
) -> DataFrame:
    """Rows in random but repeatable order for writing.

    The digest is uniform, so its leading digits split the rows evenly in one
    pass; sampling for range bounds, which would compute the input twice, is not
    needed.  Each output file is internally ordered by the digest.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, *parts))
    bucket = F.substring("_key", 1, 4)
    spread = keyed.repartition(partitions, bucket) if partitions else keyed.repartition(bucket)
    return spread.sortWithinPartitions("_key").drop("_key")


def shuffle_rank(
    df: DataFrame, seed: int = 42, parts: Sequence[str] = ("source_name", "rec_id", "copy")
) -> DataFrame:
    """Add the 1-based place of every row in the shuffled order."""
    return ranking.rank_by_digest(df.withColumn("shuffle_key", shuffle_key(seed, *parts)), "shuffle_key")


def split_exact(
    df: DataFrame, ratios: Sequence[float] = (0.9, 0.05, 0.05), seed: int = 42, key: str = "rec_id"
) -> DataFrame:
    """Add ``split``: train / val / test of exact sizes after a seeded shuffle.

    Cut positions are ``int(n * a)`` and ``int(n * (a + b))``; test takes the
    rest.  Only the two digests at the cuts are looked up, then every row decides
    for itself: the rows are not shuffled.
    """
    a, b = ratios[0], ratios[1]
    keyed = df.withColumn("_key", shuffle_key(seed, key))
    cuts = ranking.digest_cuts(keyed, "_key", [F.lit(float(a)), F.lit(float(a + b))])
    pair = cuts.select(F.struct("cut_0", "cut_1")).scalar()  # one subquery, used twice
    past_all = F.lit("g")  # sorts after every hex digest
    first = F.coalesce(pair["cut_0"], past_all)
    second = F.coalesce(pair["cut_1"], past_all)
    name = F.when(F.col("_key") < first, "train").when(F.col("_key") < second, "val").otherwise("test")
    return keyed.withColumn("split", name).drop("_key")


def combine(
    sources: Mapping[str, DataFrame],
    times: Mapping[str, int] | None = None,
    max_user_chars: int | None = None,
    longest: Column | None = None,
    shuffle: bool = True,
    seed: int = 42,
) -> Mixed:
    """The whole job: ``sources`` by name, each multiplied by ``times`` (1 if absent).

    ``longest`` is the length tested against the cap; by default the longest user
    message.  Counts are taken in one pass over the narrow (source, length) view.
    """
    times = times or {"real": 3, "synth": 1}
    longest = longest if longest is not None else longest_user(F.col("messages"))
    fits = (longest <= max_user_chars) if max_user_chars else F.lit(True)
    mixed = union_sources(
        {name: upsample(df.where(fits), times.get(name, 1)) for name, df in sources.items()}
    )
    seen = union_sources({name: df.select(fits.alias("_fits")) for name, df in sources.items()})
    factor = F.create_map(
        *[F.lit(x) for name in sources for x in (name, times.get(name, 1))]
    )
    counts = (
        seen.groupBy("source_name")
        .agg(F.count(F.lit(1)).alias("loaded"), F.count_if("_fits").alias("kept"))
        .withColumn("dropped", F.col("loaded") - F.col("kept"))
        .withColumn("combined", F.col("kept") * factor[F.col("source_name")])
    )
    return Mixed(shuffled(mixed, seed) if shuffle else mixed, counts)
