"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from chatmill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def plain(convs):
    """Result rows from {conv_id: [(role, text), ...]} by listing every prefix of every conversation."""
    nodes, ends = {}, {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) if kids.get(p) else 1
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = saved.get(p, 0) + own
        if p:
            up = p[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    return sorted(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


def told(rows, by=lambda t, name: (t is not None, t or 0, name)):
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append((by(t, name), (role, text)))
    return {c: [x for _, x in sorted(turns, key=lambda x: x[0])] for c, turns in convs.items()}


def again(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def result(df):
    got = df.collect()
    assert [f.dataType.simpleString() for f in df.schema][:7] == ["bigint"] * 7
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got)


def data(seed=1, count=300):
    draw = random.Random(seed)
    rows = []
    for c in range(count):
        if c % 13 == 4:
            continue  # heads and others that are missing
        hot = c % 3 == 0
        for t in range(draw.randrange(1, 9)):
            text = "the same" if hot and t < 6 else draw.choice(["a", "b", "é", "", None])
            rows.append((c, t, draw.choice(["user", None]) if not hot else "user", text, 0, "k"))
    rows += [(1000, None, "user", "no turn", 0, "k"), (1000, 1, "user", "a", 0, "k"), (1000, 1, "user", "a", 0, "k")]
    rows += [(1001, 5, "x", "tie", 0, "k"), (1001, 5, "y", "tie", 0, "k"), (None, 1, "user", "nobody", 0, "k")]
    rows += [(1004, 1, "us", "er:a", 0, "k"), (1005, 1, "user", ":a", 0, "k"), (1006, 0, "user", "long " * 50_000, 0, "k")]
    rows += [(1010, t, "user", f"turn {t // 3}", 0, "k") for t in range(500)] + [(1011, t, "user", f"turn {t // 3}", 0, "k") for t in range(490)]
    draw.shuffle(rows)
    return rows


def test_rebuilt_conversations(spark, rows):
    got = result(trie.trie(trie.rebuilt(rows(data(), SCHEMA).repartition(5))))
    assert got == plain(again(told(data())))


@pytest.mark.parametrize("together, parts", [(2, 16), (3, 40)])
def test_many_forests_merged_in_rounds(spark, rows, together, parts):
    """Forests of a few sequences each, merged two or three at a time over several rounds."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = result(trie.trie(trie.sequences(rows(data(2, 120), SCHEMA)), together=together))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == plain(told(data(2, 120)))


def test_forests_of_all_cuts():
    """Any cut of a sorted run into forests, merged in any grouping, gives the same nodes."""
    draw = random.Random(5)
    for _ in range(150):
        keys = sorted({tuple(draw.randrange(3) for _ in range(draw.randrange(0, 6))) for _ in range(draw.randrange(1, 14))})
        convs = {draw.randrange(10**6) * 100 + i: k for i, k in enumerate(keys)}
        packed = [bytes(b for t in k for b in [t] * trie.TURN) for k in keys]
        items = [
            {"key": p, "sizes": [t + 1 for t in k], "own_depth": len(k), "n": 1, "least": c, "kids": 0, "leaves": 0, "saved": 0, "own_ends": str(c)}
            for p, (c, k) in zip(packed, convs.items())
        ]
        whole = trie.Forest(items, [trie.common(a, b) for a, b in zip(packed, packed[1:])], True).run()
        want = sorted((n[0], n[1], n[4], n[5], n[6], n[7], n[8] or "") for n in whole.nodes())
        nodes, contracted = [], []
        start = 0
        while start < len(items):
            end = start + draw.randrange(1, 5)
            part = items[start:end]
            forest = trie.Forest(part, [trie.common(a["key"], b["key"]) for a, b in zip(part, part[1:])], False).run()
            nodes += forest.nodes()
            names = [p.split()[0] for p in trie.ITEM.split(", ")]
            contracted.append([dict(zip(names, i)) for i in forest.items(part[0], part[-1])])
            start = end
        flat, edges = [], []
        for run in contracted:
            for item in run:
                if flat:
                    edges.append(trie.common(flat[-1]["key"], item["key"]) if item is run[0] else item["lcp"])
                flat.append(item)
        nodes += trie.Forest(flat, edges, True).run().nodes()
        assert sorted((n[0], n[1], n[4], n[5], n[6], n[7], n[8] or "") for n in nodes) == want
        assert len(want) == len({k[:d] for k in keys for d in range(len(k) + 1)})


def test_pieces_of_a_hot_conversation(spark, rows):
    """Ids of one node cut into many strings over many partitions are hashed in numeric order."""
    hot = rows([(c, 0, "user", "same", 0, "k") for c in range(2000)], SCHEMA).repartition(9)
    got = trie.trie(trie.sequences(hot), piece=20)
    want = hashlib.sha256(",".join(map(str, range(2000))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in got.where("depth = 1").collect()] == [want]
    assert got.where("depth = 1").head()["saved_tokens"] == 1999 * 4


def test_empty(spark, rows):
    assert trie.trie(trie.rebuilt(rows([], SCHEMA))).collect() == []
    assert trie.trie(trie.sequences(rows([(None, 1, "a", "b", 0, "k")], SCHEMA))).collect() == []
