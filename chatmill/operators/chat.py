"""Stages on chat records ``(rec_id, messages array<struct<role, content>>)``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.text import or_empty
from chatmill.functions.tokens import LOSSLESS_TOKEN
from chatmill.operators import ranking

# Text before and after a message, by role; "*" serves every other role.
ROLE_MARKERS: dict[str, tuple[str, str]] = {
    "system": ("<|system|>\n", "<|end|>\n"),
    "user": ("<|user|>\n", "<|end|>\n"),
    "assistant": ("<|assistant|>\n", "<|end|>\n"),
    "*": ("<|other|>\n", "<|end|>\n"),
}


def first_of_role(messages: Column, role: str) -> Column:
    """First message of a role as a struct, null when there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))


def role_view(chats: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``user_msg`` / ``assistant_msg`` (first of each role) as structs."""
    m = F.col(messages)
    return chats.withColumns(
        {"user_msg": first_of_role(m, "user"), "assistant_msg": first_of_role(m, "assistant")}
    )


def first_roles(chats: DataFrame, messages: str = "messages") -> DataFrame:
    """``(rec_id, user_text, assistant_text)`` of records that have both roles."""
    view = role_view(chats, messages)
    return view.where(F.col("user_msg").isNotNull() & F.col("assistant_msg").isNotNull()).select(
        "rec_id",
        or_empty(F.col("user_msg.content")).alias("user_text"),
        or_empty(F.col("assistant_msg.content")).alias("assistant_text"),
    )


def positional(messages: Column) -> dict[str, Column]:
    """The first three messages by position."""
    return {
        name: F.try_element_at(messages, F.lit(i + 1))["content"]
        for i, name in enumerate(("system", "user_text", "answer"))
    }


#: What a record keeps besides its first three messages, where the input has it.
WHOLE = ("messages", "raw")


def triples(chats: DataFrame, messages: str = "messages") -> DataFrame:
    """``(rec_id, system, user_text, answer)`` of the first three messages, and the whole
    record (all messages, the line it was read from) where there is one."""
    parts = positional(F.col(messages))
    whole = [c for c in WHOLE if c in chats.columns]
    return chats.select("rec_id", *[content.alias(name) for name, content in parts.items()], *whole)


def record_text(records: DataFrame) -> Column:
    """Everything a record says: the three texts, all messages and the line it was read from."""
    parts = [F.col(c) for c in ("system", "user_text", "answer")]
    if "messages" in records.columns:
        parts.append(F.array_join(F.transform("messages", lambda m: or_empty(m["content"])), "\n"))
    if "raw" in records.columns:
        parts.append(F.col("raw"))
    return F.concat_ws("\n", *parts)


def original_or(records: DataFrame, is_original: Column, made: Column) -> Column:
    """All messages of an original record, the made ones of a variant."""
    if "messages" not in records.columns:
        return made
    return F.when(is_original, F.col("messages")).otherwise(made)


def longest_user(messages: Column) -> Column:
    """Length of the longest user message, 0 when there is none."""
    sizes = F.transform(
        F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.length(or_empty(m["content"]))
    )
    return F.coalesce(F.array_max(sizes), F.lit(0))


def cap_longest_user(df: DataFrame, max_chars: int | None, messages: str = "messages") -> DataFrame:
    """Drop records with a user message over the cap; no cap when 0 or None."""
    return df.where(longest_user(F.col(messages)) <= max_chars) if max_chars else df


def total_chars(messages: Column) -> Column:
    """Characters over all messages."""
    sizes = F.transform(messages, lambda m: F.length(or_empty(m["content"])).cast("long"))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)


def biggest_first(chats: DataFrame, n: int, messages: str = "messages", few: int = ranking.FEW) -> DataFrame:
    """``rec_id, total_chars`` of the ``n`` records with the most text, biggest first, ties by ``rec_id``.

    Only sizes are ranked, and for a large ``n`` only counts of sizes.
    """
    sized = chats.select("rec_id", total_chars(F.col(messages)).alias("total_chars"))
    found = ranking.first_by(sized, n, [-F.col("total_chars"), F.col("rec_id")], few)
    return found.orderBy(F.desc("total_chars"), "rec_id")


def biggest_records(chats: DataFrame, n: int, messages: str = "messages", few: int = ranking.FEW) -> DataFrame:
    """The ``n`` records with the most text, whole, with ``total_chars``; needs a unique ``rec_id``.

    Few winners are fetched by their ids; many are the records that pass the cut, which move nowhere.
    """
    if n > few:
        sized = chats.withColumn("total_chars", total_chars(F.col(messages)))
        return ranking.first_by(sized, n, [-F.col("total_chars"), F.col("rec_id")], few)
    winners = biggest_first(chats, n, messages, few).withColumnRenamed("rec_id", "_id")
    return chats.join(winners, chats["rec_id"] == winners["_id"]).drop("_id")


def first_n(df: DataFrame, n: int, order: str = "rec_id", few: int = ranking.FEW) -> DataFrame:
    """First ``n`` rows in the order of a unique whole-number column."""
    return ranking.first_by(df, n, [F.col(order)], few)


def render(messages: Column, markers: Mapping[str, tuple[str, str]] = ROLE_MARKERS) -> Column:
    """One training string: every message between the marks of its role."""

    def one(m: Column) -> Column:
        before, after = F.lit(markers["*"][0]), F.lit(markers["*"][1])
        for role, (head, tail) in markers.items():
            if role != "*":
                before = F.when(m["role"] == role, F.lit(head)).otherwise(before)
                after = F.when(m["role"] == role, F.lit(tail)).otherwise(after)
        return F.concat(before, or_empty(m["content"]), after)

    return F.array_join(F.transform(messages, one), "")


def canonical(system: str | Column, user: Column, answer: Column) -> Column:
    """Exactly system, user and assistant messages."""
    prompt = system if isinstance(system, Column) else F.lit(system)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", prompt), message("user", user), message("assistant", answer))


def keep_tail(
    system: Column, user: Column, max_input: int, reserve: int = 64, floor: int = 512
) -> Column:
    """User text cut from the left so that system and user fit in ``max_input`` tokens.

    The tail keeps ``max(floor, max_input - system tokens - reserve)`` tokens.
    """
    pieces = F.regexp_extract_all(user, F.lit(LOSSLESS_TOKEN), F.lit(0))
    sys_len = F.regexp_count(system, F.lit(LOSSLESS_TOKEN))
    budget = F.greatest(F.lit(floor), F.lit(max_input) - sys_len - reserve)
    over = (F.size(pieces) + sys_len > max_input) & (F.size(pieces) > budget)
    return F.when(over, F.array_join(F.slice(pieces, -budget, budget), "")).otherwise(user)


def render_alpaca(row: Column | None = None, eos: str = "</s>") -> Column:
    """Instruction / optional input / response as one training string."""
    field = (lambda n: F.col(n)) if row is None else (lambda n: row[n])
    extra = F.when(
        or_empty(field("input")) != "", F.concat(F.lit("### Input:\n"), field("input"), F.lit("\n\n"))
    ).otherwise("")
    return F.concat(
        F.lit("### Instruction:\n"),
        field("instruction"),
        F.lit("\n\n"),
        extra,
        F.lit("### Response:\n"),
        field("output"),
        F.lit(eos),
    )
