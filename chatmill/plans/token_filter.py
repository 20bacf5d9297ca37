"""Drop records over a token cap and report the lengths of the rest."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.tokens import count_words
from chatmill.operators import chat
from chatmill.operators.ranking import nth_of_histogram


@dataclass
class TokenFiltered:
    data: DataFrame | None
    report: DataFrame
    dropped_top: DataFrame
    dropped: DataFrame


def with_tokens(
    chats: DataFrame,
    counter: Callable[[Column], Column] = count_words,
    markers: Mapping[str, tuple[str, str]] = chat.ROLE_MARKERS,
) -> DataFrame:
    """Add ``n_tokens`` of the rendered record."""
    return chats.withColumn("n_tokens", counter(chat.render(F.col("messages"), markers)))


def within(counted: DataFrame, max_tokens: int) -> DataFrame:
    return counted.where(F.col("n_tokens") <= max_tokens)


def length_report(counted: DataFrame, max_tokens: int) -> DataFrame:
    """Kept records and their p50/p90/p95/p99/max token counts.

    Works on the histogram of lengths, which has at most ``max_tokens`` rows.
    """
    hist = within(counted, max_tokens).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("records"))
    half = F.lit(0.5)
    return nth_of_histogram(
        hist,
        "n_tokens",
        "records",
        {"p50": half, "p90": F.lit(0.90), "p95": F.lit(0.95), "p99": F.lit(0.99)},
    )


def longest_dropped(counted: DataFrame, max_tokens: int, n: int = 20) -> DataFrame:
    """The longest records over the cap."""
    place = [c for c in ("src_file", "src_block", "src_row") if c in counted.columns]
    over = counted.where(F.col("n_tokens") > max_tokens).select("rec_id", "n_tokens", *place)
    return over.orderBy(F.desc("n_tokens"), "rec_id").limit(n)


def token_filter(
    chats: DataFrame,
    max_tokens: int,
    counter: Callable[[Column], Column] = count_words,
    report_only: bool = False,
) -> TokenFiltered:
    """The whole job; with ``report_only`` no data comes back."""
    return filtered(with_tokens(chats, counter), max_tokens, report_only)


def filtered(counted: DataFrame, max_tokens: int, report_only: bool = False) -> TokenFiltered:
    """The job over records that carry ``n_tokens``; all of its four results read them."""
    data = None if report_only else within(counted, max_tokens).drop("n_tokens")
    total = counted.agg(F.count_if(F.col("n_tokens") > max_tokens).alias("dropped"))
    return TokenFiltered(
        data, length_report(counted, max_tokens), longest_dropped(counted, max_tokens), total
    )


def prepare(
    chats: DataFrame,
    max_tokens: int,
    limit: int | None = None,
    biggest: bool = False,
    counter: Callable[[Column], Column] = count_words,
    markers: Mapping[str, tuple[str, str]] = chat.ROLE_MARKERS,
) -> DataFrame:
    """Capped records rendered for training: all, the first N or the biggest N."""
    capped = within(with_tokens(chats, counter, markers), max_tokens)
    sized = capped.withColumn("total_chars", chat.total_chars(F.col("messages")))
    if limit and biggest:
        sized = sized.orderBy(F.desc("total_chars"), "rec_id").limit(limit)
    elif limit:
        sized = chat.first_n(sized, limit)
    return sized.select(
        "rec_id", "n_tokens", "total_chars", chat.render(F.col("messages"), markers).alias("text")
    )
