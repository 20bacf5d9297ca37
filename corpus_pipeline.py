"""A training corpus from raw documents: five stages, each one operator of ``chatmill.llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame with the columns of ``documents``; the last returns the
mix.  ``run`` writes each result to the shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatmill.llm import decontaminate, mixing, phrases, similar, toxicity
from chatmill.llm.store import is_fold, written
from chatmill.session import configure


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the text classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_fold("doc_id", 3, 1)).where("toxic IS NOT NULL")
    return toxicity.clean(docs, labels.selectExpr("doc_id", "toxic AS label"), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies."""
    return similar.one_of_each(docs, width=5, percent=75)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of 35-word windows that occur again."""
    return phrases.clean(docs, width=35)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every time a document is taken (``copy`` 1, 2), with its size in words and its source's target."""
    return mixing.taken(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing_sources", mix_sources),
]

#: Training and automata have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
