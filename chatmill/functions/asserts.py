"""Assertion cells: ``name = "v" | json_path_exact @$.path | expected=v ; ...``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatmill.functions.text import WS_CLASS, or_empty, strip

_PATH = rf"@[{WS_CLASS}]*([^{WS_CLASS}]+)"
# (?d): only \n ends a line, so a value spanning lines does not match.
_EXPECTED = rf"(?d)expected[{WS_CLASS}]*=[{WS_CLASS}]*(.*)$"


def parse_asserts(cell: Column) -> Column:
    """Ordered ``array<struct<pos, path, expected>>`` of a cell; empty for null or no match."""

    def one(chunk: Column, pos: Column) -> Column:
        parts = F.split(chunk, r"\|")
        third = strip(F.try_element_at(parts, F.lit(3)))
        path = F.regexp_extract(F.try_element_at(parts, F.lit(2)), _PATH, 1)
        value = strip(F.regexp_extract(third, _EXPECTED, 1))
        unquoted = F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
        usable = (F.size(parts) >= 3) & (path != "") & third.rlike(_EXPECTED)
        return F.when(
            usable, F.struct(pos.alias("pos"), path.alias("path"), unquoted.alias("expected"))
        )

    return F.filter(F.transform(F.split(or_empty(cell), " ; "), one), lambda a: a.isNotNull())


def gold_class(asserts: Column, name: str = "document_classification") -> Column:
    """Expected value of the first assertion whose path contains ``name``."""
    named = F.filter(asserts, lambda a: a["path"].contains(name))
    return F.try_element_at(named, F.lit(1))["expected"]
