"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document falls into one of 2^20 buckets by a digest of its id.  Words are
summed by source and the upper ten bits; running sums over at most 1,024 rows
of a source find the bucket in which its budget ends, and only that bucket is
summed again by the lower ten bits.  The result is one threshold per source,
against which each document decides alone: nothing is sorted, and thresholds
of a larger budget take in those of a smaller one.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and
share ``share`` of all words; a target stops at ``repeats`` times its source's
words and the excess goes to the others by weight until none is above (found in
closed form by filling the sources in the order of limit over weight).

Defined cases: a null or blank text has size 0 and takes nothing; a null id
falls into the bucket of the empty text; rows that share an id are in or out
together; a null source is a source of its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
LEVEL = 10  # bits of a histogram


def bucket(doc_id: Column) -> Column:
    """20 bits of a digest of the id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, bucket`` of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), bucket(F.col("doc_id")).alias("bucket"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``source, source_size, target``: one row per source (windows run over that small table)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    every = Window.partitionBy()
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("double"))
        .withColumn("most", (F.col("source_size") * repeats).cast("double"))
        .withColumn("budget", share * F.sum("source_size").over(every))
    )
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    full = sources.withColumn("full", left * F.col("weight") > F.col("most") * F.sum("weight").over(rest))
    given = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(
        (F.col("budget") - given) * F.col("weight") / open_weight
    )
    return full.select("source", "source_size", target.alias("target"))


def _boundary(sums: DataFrame, budget: Column) -> DataFrame:
    """The first bucket of each source at which the running sum reaches the budget."""
    running = Window.partitionBy("source").orderBy("part")
    return (
        sums.withColumn("upto", F.sum("words").over(running))
        .where(F.col("upto") >= budget)
        .groupBy("source")
        .agg(F.min_by(F.struct("part", "words", "upto"), "part").alias("at"))
        .select("source", "at.*")
    )


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, source_size, target, copies, below``: every document is taken ``copies`` times,
    and once more if its bucket is below ``below``."""
    copies = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    need = wanted.where("rest > 0").select(F.col("source").alias("_source"), "rest")
    same = F.col("source").eqNullSafe(F.col("_source"))
    step = 1 << LEVEL

    coarse = sized.groupBy("source", F.floor(F.col("bucket") / step).alias("part")).agg(F.sum("size").alias("words"))
    edge = _boundary(coarse.join(need, same), F.col("rest")).select(
        F.col("source").alias("_at"), F.col("part").alias("_part"), (F.col("upto") - F.col("words")).alias("before")
    )
    # A row per source.  Written, so that the planner knows its size and sends it to the documents
    # rather than all documents of a source to one place.
    edge = written(edge, "mix-edges", 1)
    inside = F.col("source").eqNullSafe(F.col("_at")) & (F.floor(F.col("bucket") / step) == F.col("_part"))
    fine = (
        sized.join(edge, inside)
        .groupBy("source", F.col("bucket").alias("part"), "before")
        .agg(F.sum("size").alias("words"))
        .join(need, same)
    )
    last = _boundary(fine, F.col("rest") - F.col("before")).join(edge.select("_at", "before"), F.col("source").eqNullSafe(F.col("_at")))
    last = last.join(need, same)
    with_it = F.col("before") + F.col("upto") - F.col("rest")
    without = F.col("rest") - (F.col("before") + F.col("upto") - F.col("words"))
    cut = last.select(
        F.col("source").alias("_cut"), (F.col("part") + (with_it < without).cast("long")).alias("below")
    )
    return wanted.join(cut, F.col("source").eqNullSafe(F.col("_cut")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below")
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every document.

    ``docs`` has doc_id, text, source; ``taken`` is ``copies * size``.
    """
    sized = written(sizes(docs), "mix-sizes")
    limits = written(thresholds(sized, targets(sized, weights, share, repeats)), "mix-limits", 1)
    limits = limits.withColumnRenamed("source", "_limit")
    copies = F.col("copies") + (F.col("bucket") < F.col("below")).cast("long")
    return (
        sized.join(limits, F.col("source").eqNullSafe(F.col("_limit")))
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix itself: the columns of ``docs`` (doc_id, text, source, ...) once for every time a row is taken,
    with ``copy`` (from 1), ``size``, ``source_size`` and ``target``.

    Whether a row is taken depends on its id and source alone, so the rows need no shuffle by id.
    """
    sized = written(sizes(docs), "mix-sizes")
    limits = written(thresholds(sized, targets(sized, weights, share, repeats)), "mix-limits", 1)
    limits = limits.withColumnsRenamed({c: f"_{c}" for c in limits.columns})
    joined = docs.join(limits, docs["source"].eqNullSafe(limits["_source"]))
    times = limits["_copies"] + (bucket(docs["doc_id"]) < limits["_below"]).cast("long")
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    return joined.where(times > 0).select(
        *[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"),
        size.alias("size"), limits["_source_size"].alias("source_size"), limits["_target"].alias("target"),
    )


def sql(documents: str = "documents") -> str:
    """The same in DuckDB's SQL (weights 5, 2, 1; share 1.5; at most twice)."""
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 5))::BIGINT AS bucket
  FROM {documents}),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
            - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
         > most * sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM s),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN most ELSE (budget - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) * weight
              / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM f),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM t),
c AS (
  SELECT source, bucket, words, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto
  FROM (SELECT source, bucket, sum(size) AS words FROM d GROUP BY source, bucket)),
b AS (
  SELECT r.source, min(bucket) AS bucket, min_by(words, bucket) AS words, min_by(upto, bucket) AS upto, any_value(rest) AS rest
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source WHERE rest > 0 AND upto >= rest GROUP BY r.source),
k AS (SELECT source, bucket + CASE WHEN upto - rest < rest - (upto - words) THEN 1 ELSE 0 END AS below FROM b)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (r.copies + CASE WHEN d.bucket < coalesce(k.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source"""
