import re

import pytest
from pyspark.sql import functions as F

from chatmill.functions import text as tx
from chatmill.functions.asserts import gold_class, parse_asserts

ODD = "\x1c\u2003 a b \u3000\x85\n"
SAMPLES = ["", " ", ODD, "x", "\u00a0x\u200b ", "a\n\n\n\nb  \n c", "😀" * 3, "```", "``````", "`````"]


def apply(rows, fn, texts):
    df = rows([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


def test_strip_matches_python(rows):
    every = ["x" + chr(c) for c in range(0x3001) if chr(c).isspace()] + SAMPLES
    assert apply(rows, tx.strip, every) == [t.strip() for t in every]
    assert apply(rows, tx.lstrip, SAMPLES) == [t.lstrip() for t in SAMPLES]
    assert apply(rows, tx.rstrip, SAMPLES) == [t.rstrip() for t in SAMPLES]


@pytest.mark.parametrize(
    "text, inside",
    [
        ('```json\n{"a":1}\n```', '{"a":1}'), ('  ```JSON {"a":1}```  ', '{"a":1}'),
        ("```\nx\n```", "x"), ("``````", ""), ("`````", "`````"), ("````x````", "`x`"),
        ('```json\n{"a":1}', '```json\n{"a":1}'), ("plain ", "plain"), ("```Json x```", "Json x"),
        ("```json```", ""),
    ],
)
def test_unfence(rows, text, inside):
    assert apply(rows, tx.unfence, [text]) == [inside]


def test_drop_reasoning_and_fences(rows):
    got = apply(
        rows, tx.drop_reasoning,
        ["a<think>b\nc</think>  d<think>e</think>f", "a  <think>b", "<think>", "none", "x</think>y",
         "a \u2003\n<think>b\n<think>c", "  <think>", "a  b" + " " * 50_000 + "c"],
    )
    assert got == ["adf", "a", "", "none", "x</think>y", "a", "", "a  b" + " " * 50_000 + "c"]
    assert apply(rows, tx.drop_fences, ["```json\n{}\n```", " a ``` b "]) == ["{}", "a b"]


def test_preview(rows):
    short, long = "x" * 4000, "a" * 2000 + "b" * 7 + "c" * 2000
    assert apply(rows, tx.preview, [short, long]) == [
        short, "a" * 2000 + "\n...[truncated 7 chars]...\n" + "c" * 2000,
    ]


def test_transcription(rows):
    page = "<|ref|># Heading<|/ref|>\n<|det|>text [0,0,1,1]<|/det|>\nBody"
    many = "a \t \n\n\n\nb" + " " * 50_000 + "\nc"
    assert apply(rows, tx.clean_transcription, [page, many, ""]) == ["# Heading\n\nBody\n", "a\n\nb\nc\n", "\n"]


CELL = 'cls = "A" | json_path_exact @$.x.document_classification | expected="A" ; n | p @ $.b | expected = \'q\' '


@pytest.mark.parametrize(
    "cell, expected",
    [
        (CELL, [(0, "$.x.document_classification", "A"), (1, "$.b", "q")]),
        (None, []), ("", []), ("short | x", []), ("a | no path | expected=1", []),
        ("a | @p | nothing", []), ("a | @p | expected=", [(0, "p", "")]),
        ("a | @p | expected=x | y ; b | @q | expected=z", [(0, "p", "x"), (1, "q", "z")]),
        ("a | @p | expected=one\ntwo", []), ("a | @p | expected=\ntwo", [(0, "p", "two")]),
        ("a | @p | expected=\"'v'\"", [(0, "p", "v")]), ("a | @p | expected='\"v\"'", [(0, "p", '"v"')]),
        ("x ; a | @p | expected=1", [(1, "p", "1")]),
    ],
)
def test_parse_asserts(rows, cell, expected):
    got = rows([(cell,)], "c string").select(parse_asserts(F.col("c")).alias("a")).first()["a"]
    assert [tuple(g) for g in got] == expected


def test_gold_class(rows):
    df = rows([(CELL,), ("short",)], "c string").select(gold_class(parse_asserts(F.col("c"))))
    assert [r[0] for r in df.collect()] == ["A", None]


def test_whitespace_class_equals_python():
    pattern = re.compile(f"[{tx.WS_CLASS}]")
    assert all(bool(pattern.match(chr(c))) == chr(c).isspace() for c in range(0x3100))
