"""Exact deduplication against a plain dictionary of texts."""

import hashlib
import re

import pytest

from chatmill.llm import exact

SCHEMA = "doc_id long, text string, hash string, kept string, n int"


def data():
    texts = ["one two", "one  two", "one\t\n two", " one two", "One two", "", None, " ", "\r\n", "one two", "é" * 3, "x" * 300_000]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    rows += [(200 + i, "hot  text" if i % 2 else "hot text") for i in range(400)]
    rows += [(7, "twice"), (7, "twice"), (7, "else"), (None, "twice"), (None, "no id"), (None, "no\x0bid"), (3, "y\x0c \x0bz"), (2, "y z")]
    return [(i, t, "h", "k", 1) for i, t in rows]


def plain(rows):
    """Per text: the id that stays, the number of rows; as sorted result rows."""
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, order[0], len(ids), k == 0, sha) for k, i in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [16, 1, 0])
def test_against_dictionary(spark, rows, width):
    """Also with hashes of one byte and of none, where nearly all groups hold several texts."""
    got = exact.dedup(rows(data(), SCHEMA).repartition(7), width)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(data())


def test_clean_keeps_one_row_and_all_columns(spark, rows):
    df = rows(data(), SCHEMA).repartition(5)
    got = exact.clean(df)
    assert got.columns == df.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in got.collect())
    want = sorted((i is None, i or 0, sha) for i, _, _, k, sha in plain(data()) if k)
    assert sorted((a, b, hashlib.sha256(c.encode()).hexdigest()) for a, b, c in kept) == want


def test_empty(spark, rows):
    assert exact.dedup(rows([], SCHEMA)).collect() == []
    assert exact.clean(rows([], SCHEMA)).collect() == []


def test_no_python_and_hot_group(spark, rows):
    df = rows([(i, "same") for i in range(5000)] + [(9000 + i, f"t{i % 900}") for i in range(1800)], "doc_id long, text string")
    got = exact.dedup(df)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
    assert got.where("group_size = 5000 AND keep_id = 0").count() == 5000
    assert got.where("kept").count() == 901
