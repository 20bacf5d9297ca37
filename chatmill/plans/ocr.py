"""Assemble page transcriptions into one clean document each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.functions.text import clean_transcription
from chatmill.operators.ranking import top_per_group

PAGE_CAP = 20
# Prompt and repeat window of a single-page and a multi-page document.
SINGLE_PAGE = ("<image>document parsing.", 128)
MULTI_PAGE = ("<image>Multi page parsing.", 1024)


def capped_pages(pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """First ``cap`` pages of every document in page order, with ``row_no``.

    Map tasks drop the pages past the cap before the shuffle, so a document
    that holds a large share of all pages costs ``cap`` rows per task.
    """
    return top_per_group(pages, ["doc_id"], [F.col("page_no")], cap)


def page_counts(pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """Per document: pages, kept pages, prompt and window."""
    single = F.col("kept_pages") == 1
    return (
        pages.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("pages"))
        .withColumn("kept_pages", F.least("pages", F.lit(cap)))
        .withColumns(
            {
                "prompt": F.when(single, SINGLE_PAGE[0]).otherwise(MULTI_PAGE[0]),
                "ngram_window": F.when(single, SINGLE_PAGE[1]).otherwise(MULTI_PAGE[1]),
            }
        )
    )


def assembled(pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """``(doc_id, kept_pages, raw_text)``: kept pages joined in page order.

    The cap is applied first, so a collected list never exceeds ``cap`` pages,
    and it reuses the partitioning of the page ranking: one shuffle in all.
    """
    collected = capped_pages(pages, cap).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("row_no", "text"))).alias("_pages")
    )
    return collected.select(
        "doc_id",
        F.size("_pages").alias("kept_pages"),
        F.array_join(F.transform("_pages", lambda p: p["text"]), "\n").alias("raw_text"),
    )


def requests(pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """One request per document: a prompt part followed by its pages in order."""
    body = assembled(pages, cap)
    single = F.col("kept_pages") == 1
    prompt = F.when(single, SINGLE_PAGE[0]).otherwise(MULTI_PAGE[0])
    return body.select(
        "doc_id",
        "kept_pages",
        F.when(single, SINGLE_PAGE[1]).otherwise(MULTI_PAGE[1]).alias("ngram_window"),
        F.concat_ws("\n", prompt, "raw_text").alias("content"),
    )


def corpus(pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """The whole job: clean text, page count, pages dropped and characters removed per document."""
    text = assembled(pages, cap).withColumn("text", clean_transcription(F.col("raw_text")))
    counts = page_counts(pages, cap).select("doc_id", "pages")
    return text.join(counts, "doc_id").select(
        "doc_id",
        "pages",
        "kept_pages",
        (F.col("pages") - F.col("kept_pages")).alias("dropped_pages"),
        (F.length("raw_text") - F.length("text")).alias("removed_chars"),
        "text",
    )
