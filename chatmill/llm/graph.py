"""Connected components of an edge table, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import written


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """``node, component``: the smallest node that can be reached, for every node of ``edges`` (a, b).

    Every node points at a smaller or equal one.  Each round hooks the ends of
    every edge, and what they point at, under the grandparent of the other end,
    and shortens all paths; trees shrink by a factor each round, so long chains
    take a logarithmic number of rounds.  Minima are combined before the
    shuffle and the joins are ordinary ones that adaptive execution can split,
    so a node with very many edges is no bottleneck.  Each round is written to
    the shared folder, as ``files`` files.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "edges", files)
    start = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).select(F.col("a").alias("x"), "p")
    parent = written(start, "parents", files)
    while True:
        up = parent.select(F.col("x").alias("y"), F.col("p").alias("g"))
        grand = parent.join(up, F.col("p") == F.col("y")).select("x", "p", "g")
        far = grand.select(F.col("x").alias("v"), F.col("g").alias("reach"))
        near = grand.select(F.col("x").alias("u"), F.col("p").alias("q"))
        hooks = (
            both.join(far, F.col("b") == F.col("v"))
            .join(near, F.col("a") == F.col("u"))
            .select(F.explode(F.array("u", "q")).alias("x"), F.col("reach").alias("p"))
        )
        after = hooks.unionByName(grand.select("x", F.least("p", "g").alias("p"))).groupBy("x").agg(F.min("p").alias("p"))
        before, parent = parent, written(after, "parents", files)
        was = before.select(F.col("x").alias("w"), F.col("p").alias("old"))
        if parent.join(was, (F.col("x") == F.col("w")) & (F.col("p") != F.col("old"))).isEmpty():
            return parent.select(F.col("x").alias("node"), F.col("p").alias("component"))
