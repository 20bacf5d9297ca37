"""The suffix-array operator against brute force on small texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chatmill.llm import suffixes
from tests.llm.test_phrases import same_low_bits


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by counting every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_up(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : len(p) - rng.randint(0, len(p) // 3)], " ".join(word() for _ in range(rng.randint(0, 6)))]
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x"), (n + 3, "ab" * 200), (n + 4, "z" * 300), (3, "again " * 30), (3, "again " * 30)]
    rows += [(n + 5, rows[0][1]), (n + 6, rows[0][1] + " tail"), (None, rows[1][1]), (n + 7, "longer " + "word " * 5000)]
    return rows


def test_order_of_suffixes():
    rng = random.Random(5)
    for _ in range(200):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 50))], dtype=np.int64)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_order(s).tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, rows, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 2000)
    data = made_up(seed)
    docs = rows(data, "doc_id long, text string").selectExpr("*", "1 AS tag", "text AS kept", "doc_id AS doc").repartition(5)
    got = suffixes.dedup(docs, length=40, gram=12, texts=True).collect()
    assert sorted([tuple(r[:5]) for r in got], key=str) == brute(data, 40)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_many_equal_stretches():
    rng = random.Random(9)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    parts = [base[k : k + 60] for k in range(0, 240, 7)] * 3 + [bytes(rng.choice(b"ab") for _ in range(50)) for _ in range(20)]
    counts = np.array([len(x) - 29 for x in parts])
    seen = Counter(x[k : k + 30] for x in parts for k in range(len(x) - 29))
    want = [seen[x[k : k + 30]] > 1 for x in parts for k in range(len(x) - 29)]
    assert suffixes.recurring_windows(parts, counts, 30).tolist() == want


def test_empty_table(spark, rows):
    assert suffixes.dedup(rows([], "doc_id long, text string")).collect() == []


def test_order_of_many_names():
    s = np.random.default_rng(3).permutation(3_000_000) + 1
    assert (suffixes.suffix_order(s) == np.argsort(s)).all()
    rng = random.Random(6)
    t = np.array([rng.choice((1, 7_000_000, 9_000_000, 1 << 40)) for _ in range(90)], dtype=np.int64)
    assert suffixes.suffix_order(t).tolist() == sorted(range(90), key=lambda i: t[i:].tolist())


def test_hot_anchor_is_not_sorted_in_one_task(spark, rows, monkeypatch):
    solve, most = suffixes.recurring_windows, 4000

    def bounded(stretches, counts, length):
        assert sum(map(len, stretches)) <= 2 * most
        return solve(stretches, counts, length)

    monkeypatch.setattr(suffixes, "BLOCK", most)
    monkeypatch.setattr(suffixes, "recurring_windows", bounded)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, ends = word(36), [word(12) for _ in range(40)]
    data = [(k, word(60) + rng.choice(ends) + phrase + rng.choice(ends) + word(60)) for k in range(300)]
    data += [(300 + k, data[k][1]) for k in range(3)]
    got = suffixes.dedup(rows(data, "doc_id long, text string").repartition(4), length=40, gram=12).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(data, 40)


def test_texts_that_share_an_id_keep_apart(spark, rows):
    one, two = same_low_bits(spark)
    got = suffixes.dedup(rows([(1, one), (1, two), (2, "x" * 50)], "doc_id long, text string"), length=100).where("doc_id = 1")
    want = brute([(1, one), (1, two)], 100)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == want
    assert all(r[2] < r[1] for r in want)
