"""Reading and editing JSON answers: the only Python in the batch jobs.

Spark's own JSON readers are laxer than the rules the jobs must follow (they
take trailing text, keep the first of duplicate keys, print 1.0 as 1), so three
small Arrow functions apply Python's rules: validity, reading, patching.  All
text preparation around them is native, and they return only short values.

They are declared non-deterministic although they are not: that keeps the
optimizer from copying a filter on their result below the projection that
computes it, which would run them twice per row.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.functions import text as tx

# Ship the helpers below with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READING = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("json", T.StringType()),
        T.StructField("vals", T.ArrayType(T.StringType())),
    ]
)
_READING_ARROW = pa.struct(
    [("ok", pa.bool_()), ("json", pa.string()), ("vals", pa.list_(pa.string()))]
)
_UNREADABLE = (ValueError, RecursionError)
_MARKS = re.compile(r'\\.|"[^"\\]*(?:\\.[^"\\]*)*"?|[{}]', re.DOTALL)


def _utf8(value: str) -> str:
    """Replace lone surrogates, which a JSON escape can spell but UTF-8 cannot hold."""
    return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def _skip_block(text: str, start: int) -> int:
    """Index just after the balanced block opening at ``start``, or -1 if it never closes."""
    open_blocks = 0
    for mark in _MARKS.finditer(text, start):
        if mark.group() == "{":
            open_blocks += 1
        elif mark.group() == "}":
            open_blocks -= 1
            if not open_blocks:
                return mark.end()
    return -1


def last_object(text: str, decode):
    """Last top-level ``{...}`` that parses, as (value, source text), else (None, None).

    ``decode`` is a decoder's ``raw_decode``.  It finds the end of a good object itself;
    only a block that does not parse is measured by its braces, to skip it whole.
    """
    value = source = None
    start = text.find("{")
    while start >= 0:
        try:
            value, end = decode(text, start)
            source = text[start:end]
        except _UNREADABLE:
            end = _skip_block(text, start)
            if end < 0:
                break
        start = text.find("{", end)
    return value, source


def _steps(path: str) -> list[str]:
    return path.removeprefix("$").removeprefix(".").split(".") if path[:1] == "$" else path.split(".")


def _lookup(value, steps: Sequence[str], drop_falsy: bool = False) -> str | None:
    for step in steps:
        if not isinstance(value, dict):
            return None
        value = value.get(step)
    return None if value is None or drop_falsy and not value else _utf8(str(value))


def _assign(root: dict, steps: Sequence[str], new: str) -> None:
    for step in steps[:-1]:
        child = root.get(step)
        if not isinstance(child, dict):
            child = root[step] = {}
        root = child
    root[steps[-1]] = new


def _read(text: str | None, steps: list[list[str]], decode, keep: bool, drop_falsy: bool = False):
    """Reading of one text: its last object where ``decode`` is given, else all of it."""
    if text is None:
        return {"ok": False, "json": None, "vals": [None] * len(steps)}
    if decode:
        value, source = last_object(text, decode)
        ok = source is not None
    else:
        try:
            value, source, ok = json.loads(text), text, True
        except _UNREADABLE:
            value, source, ok = None, None, False
    return {
        "ok": ok,
        "json": source if keep else None,
        "vals": [_lookup(value, s, drop_falsy) for s in steps],
    }


@F.arrow_udf(T.BooleanType())
def _json_ok(texts: pa.Array) -> pa.Array:
    def valid(text):
        try:
            json.loads(text)
        except _UNREADABLE:
            return False
        return True

    return pa.array([None if t is None else valid(t) for t in texts.to_pylist()], pa.bool_())


def _reader(paths: tuple[str, ...] | None, scan: bool, keep: bool, drop_falsy: bool):
    """Arrow function reading fixed paths, or (paths is None) the paths of a second column."""

    def decoder():
        return json.JSONDecoder().raw_decode if scan else None

    if paths is None:

        @F.arrow_udf(READING)
        def read_each(texts: pa.Array, wanted: pa.Array) -> pa.Array:
            decode = decoder()
            rows = [
                _read(t, [_steps(p) for p in ps or []], decode, keep, drop_falsy)
                for t, ps in zip(texts.to_pylist(), wanted.to_pylist())
            ]
            return pa.array(rows, _READING_ARROW)

        return read_each

    steps = [_steps(p) for p in paths]

    @F.arrow_udf(READING)
    def read_fixed(texts: pa.Array) -> pa.Array:
        decode = decoder()
        rows = [_read(t, steps, decode, keep, drop_falsy) for t in texts.to_pylist()]
        return pa.array(rows, _READING_ARROW)

    return read_fixed


#: How an edited object is written: keyword arguments of ``json.dumps``.
STYLES = {
    "plain": {"ensure_ascii": False},
    "indented": {"ensure_ascii": False, "indent": 2},
    "compact": {"separators": (",", ":")},
}


def _patcher(style: str):
    options = STYLES[style]

    @F.arrow_udf(T.StringType())
    def patch(texts: pa.Array, edits: pa.Array) -> pa.Array:
        out = []
        for text, changes in zip(texts.to_pylist(), edits.to_pylist()):
            if text is None:
                out.append(None)
                continue
            root = json.loads(text)
            for change in changes or []:
                _assign(root, _steps(change["path"]), change["value"])
            out.append(_utf8(json.dumps(root, **options)))
        return pa.array(out, pa.string())

    return patch


def json_ok(text: Column) -> Column:
    """Whether the text is one JSON value by Python's rules; null for null."""
    return _json_ok.asNondeterministic()(text)


#: mode -> (native preparation, scan for the last object instead of parsing the whole text)
MODES = {
    "raw": (lambda c: c, True),
    "clean": (lambda c: tx.drop_fences(tx.drop_reasoning(c)), True),
    "strict": (lambda c: c, False),
    "label": (tx.first_fence, False),
    "retest": (tx.leading_fence, False),
}


def read_answer(
    text: Column,
    paths: Sequence[str] | Column = (),
    mode: str = "raw",
    keep_json: bool = False,
    drop_falsy: bool = False,
) -> Column:
    """Struct ``(ok, json, vals)``: readable?, the JSON text if kept, one text per path.

    ``vals`` holds ``str()`` of each value found, null for a missing or null one and,
    with ``drop_falsy``, for empty text, zero, false and empty containers (by the
    value's type: the text ``"0"`` stays).
    ``paths`` is a fixed list or an array column (paths that differ per row).
    """
    prepare, scan = MODES[mode]
    if isinstance(paths, Column):
        return _reader(None, scan, keep_json, drop_falsy).asNondeterministic()(prepare(text), paths)
    return _reader(tuple(paths), scan, keep_json, drop_falsy).asNondeterministic()(prepare(text))


def patch_json(text: Column, edits: Column, style: str = "plain") -> Column:
    """Apply ``array<struct<path, value>>`` in order to a JSON object; later edits win.

    The value is written out again in the given style, so an empty list normalises it.
    """
    return _patcher(style).asNondeterministic()(text, edits)
