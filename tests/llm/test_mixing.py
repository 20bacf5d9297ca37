"""Mixing against a plain computation."""

import hashlib

import duckdb
import pytest

from chatmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, bucket string, size int"


def data():
    rows = [(i, "w " * (i % 37 + (400 if i % 50 == 0 else 0)), f"s{i * i % 7}") for i in range(400)]
    rows += [(i, "one two", None) for i in range(400, 430)] + [(430, None, "s1"), (431, "", "empty"), (432, " \n", "empty")]
    rows += [(1, "again again", "s1"), (1, "again again", "s1"), (None, "no id", "s2"), (433, "x y\x0bz" * 4000, "é"), (434, "a", "é")]
    return [(i, t, s, "clash", 7) for i, t, s in rows]


def plain(rows):
    """Targets by sharing the excess round after round."""
    sizes = {}
    docs = [(i, s, len((t or "").encode().split())) for i, t, s, *_ in rows]
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if target[s] > 2 * sizes[s]}
        if not above:
            return docs, sizes, target
        full |= above


def test_targets_and_taken(spark, rows):
    docs, sizes, target = plain(data())
    got = mixing.mix(rows(data(), SCHEMA).repartition(6)).collect()
    assert len(got) == len(docs)
    taken, largest = {}, {}
    by_id = {}
    for i, s, n in docs:
        by_id.setdefault(i, []).append((n, sizes[s], s))
        largest[s] = max(largest.get(s, 0), n)
    for r in got:
        n, of_source, s = next(x for x in by_id[r["doc_id"]] if x[0] == r["size"])
        assert r["source_size"] == of_source and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, n, 2 * n) and r["taken"] == n * r["copies"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, words in taken.items():
        assert abs(words - target[s]) <= largest[s] / 2 + 4  # rows of one id are taken together


def test_same_as_sql_and_repeatable(spark, rows):
    given = [r for r in data() if r[0] is not None]
    docs = rows(given, SCHEMA)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({mixing.sql()})").fetchall())
    first = sorted(tuple(r) for r in mixing.mix(docs.repartition(3)).select(columns).collect())
    assert first == want
    assert sorted(tuple(r) for r in mixing.mix(docs.repartition(9)).select(columns).collect()) == first


def test_taken_repeats_rows_as_mix_says(spark, rows):
    docs = rows(data(), SCHEMA)
    counts = {}
    for r in mixing.mix(docs).where("doc_id IS NOT NULL").collect():
        key = (r["doc_id"], r["size"])
        counts[key] = counts.get(key, 0) + r["copies"]
    clean = docs.drop("bucket", "size")
    got = {}
    out = mixing.taken(clean)
    assert out.columns == ["doc_id", "text", "source", "copy", "size", "source_size", "target"]
    for r in out.where("doc_id IS NOT NULL").collect():
        got[(r["doc_id"], r["size"])] = got.get((r["doc_id"], r["size"]), 0) + 1
    assert got == {k: v for k, v in counts.items() if v}


def test_buckets_are_twenty_bits_of_the_digest(spark, rows):
    got = rows([(5,), (None,)], "doc_id long").select(mixing.bucket(mixing.F.col("doc_id")).alias("b")).collect()
    assert [r["b"] for r in got] == [int(hashlib.md5(x).hexdigest()[:5], 16) for x in (b"5", b"")]


def test_empty_table(spark, rows):
    assert mixing.mix(rows([], SCHEMA)).collect() == [] and mixing.taken(rows([], "doc_id long, text string, source string")).collect() == []
