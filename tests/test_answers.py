import json

import pytest
from pyspark.sql import functions as F

from chatmill.functions.answers import json_ok, last_object, patch_json, read_answer

DECODE = json.JSONDecoder().raw_decode
EDITS = "array<struct<path: string, value: string>>"


@pytest.mark.parametrize(
    "text, source",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('x {"a": 1} y {"b": {"c": 2}} z', '{"b": {"c": 2}}'),
        ('{"a": "}"} tail', '{"a": "}"}'),
        ('{"a": "\\"}"}', '{"a": "\\"}"}'),
        ('{"a": 1} {"b": 2', '{"a": 1}'),  # an unclosed block ends the scan
        ('{"b": 2 {"a": 1}', None),
        ('{bad {"a": 1} } {"c": 3}', '{"c": 3}'),  # a bad block is skipped as a whole
        ('{bad {"a": 1} }', None),
        ('{"x" "} {"} {"a": 1}', '{"a": 1}'),  # braces inside the strings of a bad block
        ("no json", None),
        ("", None),
        ('{"a": NaN, "a": 2}', '{"a": NaN, "a": 2}'),
        ('{"a": "line\nbreak"} {"ok": 1}', '{"ok": 1}'),
        ("\\{\"a\": 1}", '{"a": 1}'),
        ("{\\} {\"a\": 1}", None),  # an escaped brace does not close
    ],
)
def test_last_object(text, source):
    assert last_object(text, DECODE)[1] == source


def test_deep_nesting_is_unreadable_not_fatal():
    deep = '{"a":' * 100_000
    assert last_object(deep, DECODE) == (None, None)
    closed = deep + "1" + "}" * 100_000 + ' {"b": 1}'
    assert last_object(closed, DECODE)[1] == '{"b": 1}'


@pytest.mark.parametrize(
    "text, ok",
    [
        ('{"a":1} x', False), ('{"a":1,"a":2}', True), ('{"a":NaN}', True), ("", False),
        ("null", True), ("[1]", True), ("{'a':1}", False), (' {"a":1}\n', True), (None, None),
        ("1" * 5000, False),
    ],
)
def test_json_ok_follows_python(rows, text, ok):
    assert rows([(text,)], "t string").select(json_ok(F.col("t"))).first()[0] is ok


def read(rows, text, paths, mode, keep=False):
    df = rows([(text,)], "t string").select(read_answer(F.col("t"), paths, mode, keep).alias("r"))
    return df.first()["r"]


def test_paths_and_stringification(rows):
    text = '{"a": {"b": true, "f": 1.0, "n": null, "o": {"x": 1}, "l": [1, "z"]}, "a.b": 9, "": 3, "d": 1, "d": 2}'
    paths = ["$.a.b", "$a.f", "a.n", "a.o", "a.l", "a.l.0", "missing.x", "$", "d"]
    got = read(rows, text, paths, "strict")
    assert got["ok"]
    assert got["vals"] == ["True", "1.0", None, "{'x': 1}", "[1, 'z']", None, None, "3", "2"]


def test_lone_surrogate_survives_transport(rows):
    assert read(rows, '{"a": "\\ud800x"}', ["a"], "strict")["vals"] == ["?x"]


def test_paths_per_row(rows):
    df = rows([('{"a": 1, "b": 2}', ["b", "a"]), ('{"a": 1}', []), (None, ["a"])], "t string, p array<string>")
    got = df.select(read_answer(F.col("t"), F.col("p"), "raw").alias("r")).collect()
    assert [(g["r"]["ok"], g["r"]["vals"]) for g in got] == [
        (True, ["2", "1"]), (True, []), (False, [None]),
    ]


@pytest.mark.parametrize(
    "mode, text, kept",
    [
        ("clean", '<think>{"a": 1}</think> {"a": 2}', '{"a": 2}'),
        ("clean", 'x {"a": 3} <think> {"a": 4}', '{"a": 3}'),
        ("clean", '```json\n{"a": 5}\n```', '{"a": 5}'),
        ("clean", "<think>never closed {\"a\": 6}", None),
        ("raw", "<think>never closed {\"a\": 6}", '{"a": 6}'),
        ("retest", '```json\n{"a": 7}\n```', '{"a": 7}'),
        ("retest", 'say {"a": 8}', None),
        ("label", 'text ```json\n{"a": 9}\n``` more', '{"a": 9}'),
        ("strict", '```json\n{"a": 9}\n```', None),
    ],
)
def test_modes(rows, mode, text, kept):
    assert read(rows, text, [], mode, keep=True)["json"] == kept


@pytest.mark.parametrize(
    "text, edits, style, expected",
    [
        ('{"a": 1}', [("a", "x"), ("b.c", "y"), ("$.b.c", "z")], "plain", '{"a": "x", "b": {"c": "z"}}'),
        ('{"a": 1}', [("a.b", "x")], "plain", '{"a": {"b": "x"}}'),
        ('{"é":1}', [], "plain", '{"é": 1}'),
        ('{"é": 1}', [("m", "x")], "compact", '{"\\u00e9":1,"m":"x"}'),
        ('{"a": 1}', [], "indented", '{\n  "a": 1\n}'),
        (None, [("a", "b")], "plain", None),
    ],
)
def test_patch(rows, text, edits, style, expected):
    df = rows([(text, edits)], f"t string, e {EDITS}")
    assert df.select(patch_json(F.col("t"), F.col("e"), style)).first()[0] == expected


def test_arrow_function_runs_once_under_a_filter(rows):
    df = rows([('{"a": 1}',)], "t string").withColumn("r", read_answer(F.col("t"), ["a"], "strict"))
    plan = df.where(F.col("r.ok"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
