import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chatmill.operators.markers import clean_markers, containing, flag_containing, matching_digests


def fixture(seed):
    rng = random.Random(seed)
    words = ["case", "appeal", "é😀", "A-17", "x", "00", "claim 9", "\n"]
    texts = [(i, "".join(rng.choice(words + [" "]) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    texts.append((999, None))
    marks = {t[j : j + n] for _, t in texts[:6] for j, n in [(rng.randrange(1 + len(t)), rng.choice([1, 2, 3, 5, 9, 15]))]}
    marks |= {"case-0000001", "case-0000002", "nope", "appealA-17", "é😀case"}
    return texts, sorted(marks)


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(rows, seed):
    texts, marks = fixture(seed)
    df = rows(texts, "rec_id long, text string")
    listed = clean_markers(rows([(m,) for m in marks] + [("  ",), (marks[0],)], "marker string"))
    kept = [m.strip() for m in marks if m.strip()]
    want = {i for i, t in texts if t is not None and any(m in t for m in kept)}
    got = containing(df, F.col("text"), listed).collect()
    assert sorted(r.rec_id for r in got) == sorted(want)
    flags = flag_containing(df, F.col("text"), listed, "hit").collect()
    assert {r.rec_id for r in flags if r.hit} == want and len(flags) == len(texts)


def test_thousands_of_markers_and_repeated_ids(rows):
    marks = clean_markers(rows([(f"mark-{i:05d}-",) for i in range(5000)], "marker string"))
    texts = [(i % 3, f"text {'mark-%05d-' % i if i % 2 else 'mark-'} tail") for i in range(40)]
    df = rows(texts, "rec_id long, text string")
    flags = flag_containing(df, F.col("text"), marks, "hit").collect()
    assert sorted((r.rec_id, r.text, r.hit) for r in flags) == sorted((i, t, k % 2 == 1) for k, (i, t) in enumerate(texts))


def test_no_markers(rows):
    df = rows([(1, "a")], "rec_id long, text string")
    empty = clean_markers(rows([("",)], "marker string"))
    assert containing(df, F.col("text"), empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_list_agrees_with_brute_force(rows, seed):
    texts, marks = fixture(seed)
    df = rows(texts, "rec_id long, text string")
    listed = clean_markers(rows([(m,) for m in marks], "marker string"))
    kept = [m.strip() for m in marks if m.strip()]
    want = {i for i, t in texts if t is not None and any(m in t for m in kept)}
    flags = flag_containing(df, F.col("text"), listed, "hit", listed_bytes=0).collect()
    assert {r.rec_id for r in flags if r.hit} == want and len(flags) == len(texts)
    assert {r.rec_id for r in containing(df, F.col("text"), listed, listed_bytes=0).collect()} == want


def test_many_shards_pieces_and_copies_of_automata(rows):
    """Automata of a few hundred bytes; one marker is in a third of the texts, one gram in most markers."""
    marks = [f"mark-{i:05d}-" for i in range(3000)] + ["common phrase", "zz", "é"]
    texts = [(i, f"text {'mark-%05d-' % (i * 7) if i % 2 else 'mark-'} {'common phrase' if i % 3 == 0 else 'x'} tail") for i in range(900)]
    texts += [(5000, "x" * 70_000 + "zz" + "y" * 70_000), (5001, "a é"), (5002, ""), (5003, None), (5004, "common"), (0, "mark-00000- again")]
    df = rows(texts, "rec_id long, text string").repartition(4)
    found = matching_digests(df, F.col("text"), clean_markers(rows([(m,) for m in marks], "marker string")), shard=400, passed=2000)
    want = {t for _, t in texts if t and any(m in t for m in marks)}
    assert {bytes(r[0]) for r in found.collect()} == {hashlib.sha256(t.encode()).digest()[:16] for t in want}
