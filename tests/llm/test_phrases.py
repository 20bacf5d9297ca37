"""Repeated-phrase automata against brute force on small texts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatmill.llm import phrases


def brute(rows, width):
    """(doc_id, n_words, n_removed, kept) by counting every window."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def made_up(seed, n=60):
    rng = random.Random(seed)
    words = lambda k: [rng.choice("a b c dé É f,".split()) + rng.choice(["", "", "x"]) for _ in range(k)]
    passages = [words(rng.randint(6, 40)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = words(rng.randint(0, 12))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            text += p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)] + words(rng.randint(0, 5))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "ha " * 100), (n + 4, "one two " * 40), (3, rows[5][1]), (3, rows[5][1])]
    rows += [(n + 5, rows[0][1]), (None, rows[1][1]), (None, "lone"), (n + 6, "longer " + "word " * 3000), (n + 7, "u v " * 30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, rows, seed):
    data = made_up(seed)
    docs = rows(data, "doc_id long, text string").selectExpr("*", "1 AS tag", "'' AS kept", "doc_id AS doc").repartition(5)
    got = sorted([tuple(r) for r in phrases.dedup(docs, width=9, block_bytes=3000).collect()], key=str)
    want = [(i, n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in brute(data, 9)]
    assert got == sorted(want, key=str)


def test_clean_keeps_rows_columns_and_untouched_texts(spark, rows):
    data = made_up(3)
    docs = rows(data, "doc_id long, text string").selectExpr("*", "doc_id * 2 AS _kept", "'x' AS source")
    got = phrases.clean(docs, width=9, block_bytes=3000)
    assert got.columns == ["doc_id", "text", "_kept", "source"]
    want = [(i, t if not gone else kept.decode()) for (i, t), (_, _, gone, kept) in zip(data, brute(data, 9))]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)


def test_locate_whole_and_partial():
    passage = " ".join(f"w{i}" for i in range(60)).encode()
    text = b"x " + b" ".join(f"w{i}".encode() for i in range(11, 47)) + b" y w1 w2"
    other = " ".join(f"v{i}" for i in range(40)).encode()
    for shard in (1, 1 << 20):  # an automaton for each passage, one for both
        gone = phrases.locate([text, b"", passage, other], [passage, other], 35, shard)
        assert gone[0].tolist() == [False] + [True] * 36 + [False] * 3
        assert [len(g) for g in gone] == [40, 0, 60, 40] and gone[2].all() and gone[3].all()


def test_empty_table(spark, rows):
    docs = rows([], "doc_id long, text string")
    assert phrases.dedup(docs).collect() == [] and phrases.clean(docs).collect() == []


def same_low_bits(spark):
    """Two texts that share 60 words, of equal length, whose 64-bit digests agree in 16 bits."""
    common = " ".join(f"w{k}" for k in range(60))
    texts = spark.range(3000).selectExpr("id", f"concat('{common}', concat_ws(' ', '', md5(id || 'a'), md5(id || 'b'), md5(id || 'c'), md5(id || 'd'), md5(id || 'e'))) AS t")
    pairs = texts.groupBy(F.xxhash64("t").bitwiseAND(0xFFFF).alias("low")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1")
    return pairs.first()["ts"][:2]


def test_texts_that_share_an_id_keep_apart(spark, rows):
    one, two = same_low_bits(spark)
    docs = rows([(1, one), (1, two), (2, "other words " * 3)], "doc_id long, text string")
    got = phrases.dedup(docs, width=35).where("doc_id = 1").collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(65, 60), (65, 60)]
    kept = {" ".join(t.split()[60:]) for t in (one, two)}
    assert {r.text for r in phrases.clean(docs, width=35).where("doc_id = 1").collect()} == kept


def test_a_block_is_sent_what_it_holds_and_not_all_that_shares_a_line(spark, rows, monkeypatch):
    rng = random.Random(4)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    line = words(12)
    texts = [words(30) + line + words(30) for _ in range(60)]  # each twice, as different documents
    data = [(2 * i + k, " ".join([f"x{2 * i + k}", *t])) for i, t in enumerate(texts) for k in (0, 1)]
    sent = []
    stream = phrases._stream

    def spy(touched, routed, width):
        sent.extend(r.passage for r in routed.collect())
        return stream(touched, routed, width)

    monkeypatch.setattr(phrases, "_stream", spy)
    got = phrases.dedup(rows(data, "doc_id long, text string"), width=35, block_bytes=2000)
    assert sorted(tuple(r) for r in got.collect()) == [
        (i, n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in brute(data, 35)
    ]
    assert len(sent) <= 2 * len(data)


def test_passages_longer_than_a_piece(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 16)
    rng = random.Random(5)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    long = words(200)
    texts = [long, words(7) + long[20:180], long[15:24] + words(3) + long[31:40] + words(2) + long[100:141], words(4) + long[5:13]]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = phrases.dedup(rows(data, "doc_id long, text string"), width=9, block_bytes=500)
    assert sorted(tuple(r) for r in got.collect()) == [
        (i, n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in brute(data, 9)
    ]
