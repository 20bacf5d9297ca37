"""Clean a raw chat export into canonical training records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions import text as tx
from chatmill.functions.answers import json_ok
from chatmill.operators import chat

MAX_USER_CHARS = 160_000

#: Reasons in the order they are tested; the first that applies is reported.
REASONS = ("missing_role", "no_prefix", "oversize", "bad_json")


@dataclass
class Cleaned:
    data: DataFrame
    rejects: DataFrame
    summary: DataFrame


def from_chats(chats: DataFrame) -> DataFrame:
    """``(rec_id, user_text, assistant_text)``, null where the role is absent.

    A present message with null content counts as empty text; ``answer_was_null``
    marks such answers, whose text is changed by that.
    """
    view = chat.role_view(chats)
    return view.select(
        "rec_id",
        F.when(F.col("user_msg").isNotNull(), tx.or_empty(F.col("user_msg.content"))).alias("user_text"),
        F.when(F.col("assistant_msg").isNotNull(), tx.or_empty(F.col("assistant_msg.content"))).alias(
            "assistant_text"
        ),
        (F.col("assistant_msg").isNotNull() & F.col("assistant_msg.content").isNull()).alias("answer_was_null"),
        *[c for c in ("src_file", "src_block", "src_row") if c in chats.columns],
    )


def classify(
    rows: DataFrame, prefix: str | None = None, max_user_chars: int = MAX_USER_CHARS
) -> DataFrame:
    """Add the cleaned ``user``, ``answer``, ``drop_reason`` and the two strip flags.

    Cheap native tests come first; only rows that survive them reach the strict
    JSON test.
    """
    prefix = prefix.strip() if prefix else None
    user, answer = F.col("user_text"), F.col("assistant_text")
    present = user.isNotNull() & answer.isNotNull()
    if prefix:
        has_prefix = present & user.startswith(prefix)
        bare = tx.lstrip(F.substr(user, F.lit(len(prefix) + 1)))
        cleaned = F.when(has_prefix, bare).otherwise(user)
    else:
        has_prefix, cleaned = F.lit(False), user
    early = (
        F.when(~present, "missing_role")
        .when(~has_prefix if prefix else F.lit(False), "no_prefix")
        .when(F.length("user") > max_user_chars, "oversize")
    )
    # A null content is not equal to the empty text it becomes.
    was_null = F.col("answer").isNotNull() & F.col("answer_was_null") if "answer_was_null" in rows.columns else F.lit(False)
    staged = (
        rows.withColumns({"user": cleaned, "prefix_stripped": has_prefix})
        .withColumn("_early", early)
        .withColumn("answer", F.when(F.col("_early").isNull(), tx.unfence(answer)))
        .withColumn("fence_stripped", F.coalesce((F.col("answer") != answer) | was_null, F.lit(False)))
        .withColumn("_ok", json_ok(F.col("answer")))
    )
    reason = F.coalesce(F.col("_early"), F.when(~F.col("_ok"), "bad_json"))
    return staged.withColumn("drop_reason", reason).drop("_early", "_ok")



def counters() -> list[Column]:
    """Kept, dropped by cause, prefixes and fences stripped: aggregates over classified rows."""
    reason = F.col("drop_reason")
    return [
        F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason == "oversize").alias("dropped_oversize"),
        F.count_if(reason.isin("missing_role", "bad_json")).alias("dropped_invalid"),
        F.count_if(reason == "no_prefix").alias("dropped_no_prefix"),
        F.count_if("prefix_stripped").alias("prefixes_stripped"),
        F.count_if("fence_stripped").alias("fences_stripped"),
    ]


def summarise(classified: DataFrame) -> DataFrame:
    """The counters as one row."""
    return classified.agg(*counters())


def reason_counts(classified: DataFrame) -> DataFrame:
    """Rows per drop reason, ``kept`` included."""
    return classified.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def kept(classified: DataFrame, system: str) -> DataFrame:
    """Canonical records ``(rec_id, messages)`` of the rows that were kept."""
    good = classified.where(F.col("drop_reason").isNull())
    messages = chat.canonical(system.strip(), F.col("user"), F.col("answer"))
    return good.select("rec_id", messages.alias("messages"))


def clean(
    rows: DataFrame,
    system: str,
    prefix: str | None = None,
    max_user_chars: int = MAX_USER_CHARS,
) -> Cleaned:
    """The whole job over ``(rec_id, user_text, assistant_text)``."""
    classified = classify(rows, prefix, max_user_chars)
    rejects = classified.where(F.col("drop_reason").isNotNull()).select("rec_id", "drop_reason")
    return Cleaned(kept(classified, system), rejects, summarise(classified))
