"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmill.llm import decontaminate, exact, language, mixing, negatives, phrases, quality, similar, suffixes, toxicity, trie, vectors, wrapper
from chatmill.llm.store import is_fold
from chatmill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
    """Register a function of (session, reader of a named table) under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@query
def op10_toxicity(spark, table):
    labels = table("labels").where(~is_fold("doc_id", 3, 1)).where("toxic IS NOT NULL")
    scored = toxicity.score(table("documents"), labels.selectExpr("doc_id", "toxic AS label"), threshold=0.7)
    return scored.select("doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query
def op3_mixing(spark, table):
    return mixing.mix(table("documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op3_mixing"] = mixing.sql()


@query
def op4_decontamination(spark, table):
    return decontaminate.report(table("documents"), table("benchmark")).drop("hit_items")


SQL["op4_decontamination"] = decontaminate.sql()


@query
def op8_suffix_array(spark, table):
    return suffixes.dedup(table("documents"), length=200)


@query
def op2_phrase_automata(spark, table):
    return phrases.dedup(table("documents"), width=35)


SQL["op2_phrase_automata"] = phrases.sql()


@query
def op1_jaccard_join(spark, table):
    return similar.join(table("documents"), width=5, percent=75)


SQL["op1_jaccard_join"] = similar.sql()


@query
def op7_language(spark, table):
    docs = table("documents")
    named = language.identify(docs, docs.where(~is_fold("doc_id", 3, 1)))
    return named.select("doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op9_quality(spark, table):
    labels = table("labels").where(~is_fold("doc_id", 5, 0)).selectExpr("doc_id", "quality AS label")
    scored = quality.score(table("documents"), labels, threshold=0.3)
    return scored.select("doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query
def op6_html_extraction(spark, table):
    return wrapper.extract(table("pages"))


@query
def op5_near_dedup(spark, table):
    return vectors.near_duplicates(table("embeddings"), least_cosine=0.95)


SQL["op5_near_dedup"] = vectors.sql()


@query
def op11_exact_dedup(spark, table):
    return exact.dedup(table("documents"))


SQL["op11_exact_dedup"] = exact.sql()


@query
def op13_conversation_trie(spark, table):
    return trie.trie(trie.rebuilt(table("conversations")))


SQL["op13_conversation_trie"] = trie.sql()


@query
def op12_hard_negatives(spark, table):
    moved = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label"
    rows = table("embeddings").selectExpr("vec_id", moved, "embedding")
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = negatives.sql()
