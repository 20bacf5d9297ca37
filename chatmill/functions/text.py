"""Whitespace, fence and reasoning-block handling as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: The same set inside a Java regular-expression character class.
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace; linear, unlike an anchored regex on long blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def unfence(text: Column) -> Column:
    """Inside of a text that is one fenced block (optionally tagged json/JSON), else the text.

    The result is trimmed either way.
    """
    whole = strip(text)
    inside = F.substr(whole, F.lit(4), F.length(whole) - 6)
    fenced = whole.startswith("```") & whole.endswith("```") & (F.length(whole) >= 6)
    return F.when(fenced, strip(F.regexp_replace(inside, "^(?:json|JSON)", ""))).otherwise(whole)


def first_fence(text: Column) -> Column:
    """Inside of the first fenced block anywhere in the text, else the text; trimmed."""
    whole = strip(text)
    block = rf"(?s)```(?:json)?[{WS_CLASS}]*\n?(.*?)\n?```"
    return F.when(whole.rlike(block), strip(F.regexp_extract(whole, block, 1))).otherwise(whole)


def leading_fence(text: Column) -> Column:
    """Text between the first pair of fences when the text opens with one."""
    whole = strip(text)
    between = F.element_at(F.split(whole, "```", 3), 2)
    untagged = F.when(between.startswith("json"), F.substr(between, F.lit(5))).otherwise(between)
    return F.when(whole.startswith("```"), strip(untagged)).otherwise(whole)


def drop_reasoning(text: Column) -> Column:
    """Remove complete ``<think>`` blocks, then everything from an unclosed one on."""
    closed = F.regexp_replace(text, rf"(?s)<think>.*?</think>[{WS_CLASS}]*", "")
    # The look-behind lets a match start only where a run of blanks starts.
    return F.regexp_replace(closed, rf"(?s)(?<![{WS_CLASS}])[{WS_CLASS}]*+<think>.*", "")


def drop_fences(text: Column) -> Column:
    """Remove every fence marker, its json tag and the blanks after it; trimmed."""
    return strip(F.regexp_replace(text, rf"```(?:json)?[{WS_CLASS}]*", ""))


def preview(text: Column, edge: int = 2000) -> Column:
    """The whole text up to twice ``edge`` characters, else head, a note and tail."""
    size = F.length(text)
    note = F.concat(
        F.lit("\n...[truncated "), (size - 2 * edge).cast("string"), F.lit(" chars]...\n")
    )
    return F.when(size <= 2 * edge, text).otherwise(
        F.concat(F.left(text, F.lit(edge)), note, F.right(text, F.lit(edge)))
    )


def clean_transcription(text: Column) -> Column:
    """Strip OCR grounding tokens and tidy blank space; ends with one newline."""
    text = F.regexp_replace(text, r"(?s)<\|ref\|>(.*?)<\|/ref\|>", "$1")
    text = F.regexp_replace(text, r"(?s)<\|det\|>.*?<\|/det\|>", "")
    # The look-behind lets a match start only where a run of blanks starts, so a
    # long run is read once instead of once per character.
    text = F.regexp_replace(text, r"(?<![ \t])[ \t]++\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.concat(strip(text), F.lit("\n"))
