"""Decontamination against a plain search."""

import hashlib
import random
import re

from chatmill.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, width):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names |= {str(x) for x in ids if x is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def made_up():
    rng = random.Random(6)
    some = lambda n: [rng.choice("the of É été naïve x1 q ÀB longword".split()) for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([1, 2, 4, 7, 9])))) for k in range(12)] + [(20, None), (21, "..."), (22, "the"), (None, "q q q")]
    items += [(0, items[3][1]), (100, items[3][1]), (3, items[3][1])]
    docs = []
    for k in range(60):
        text = some(rng.randint(0, 12))
        if rng.random() < 0.5:
            text += words(rng.choice(items)[1])[: rng.randint(1, 9)] + some(rng.randint(0, 4))
        docs.append((k, rng.choice([" ", "-", ", ", "\n"]).join(text).upper() if k % 3 else " ".join(text)))
    docs += [(60, None), (61, ""), (62, "?!"), (5, docs[5][1]), (5, "other text the"), (None, docs[7][1]), (63, "the longword " * 2000)]
    return docs, items


def test_report_equals_brute_force(spark, rows):
    docs, items = made_up()
    given = rows(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'' AS words", "2 AS n_words").repartition(4)
    bench = rows(items, "item_id long, text string").selectExpr("*", "0 AS doc_id")
    want = brute(docs, items, 4)
    for limits in ((20_000,), (2, 100), (20_000, 6), (20_000, 100, 0)):  # one block, few keys, few windows, no broadcast
        rows_, found = dc.hits(given, bench, 4, *limits)
        assert rows_.count() == len(docs)
        hit = {(r["doc_id"], r["start"], r["length"]) for r in found.collect()}
        assert len({d for d, *_ in hit if d is not None}) == len({w[0] for w in want if w[5] and w[0] is not None})
    got = [tuple(r)[:6] for r in dc.report(given, bench, 4).collect()]
    assert sorted(got, key=str) == want


def test_a_common_long_word_is_no_key(spark, rows):
    """400 items share their longest word: their windows get other keys, and blocks stay within their bound."""
    items = rows([(k, f"a{k} commonlongword b{k}") for k in range(400)], "item_id long, text string")
    wins = dc.keyed(dc.windows(items, 3))
    assert wins.agg({"n": "max"}).first()[0] == 1 and wins.where("key = 'commonlongword'").count() == 0
    same = rows([(k, "x y x x y y x y y y x x".replace("x", "p" * (1 + k % 9)).replace("y", "q")) for k in range(300)], "item_id long, text string")
    dealt, blocks = dc.blocked(dc.windows(same, 5), 20_000, 8)
    loads = [r["count"] for r in dealt.groupBy("number").count().collect()]
    assert blocks > 4 and sum(loads) == dc.windows(same, 5).count() and max(loads) <= 3 * 8


def test_clean_drops_hit_rows_only(spark, rows):
    docs, items = made_up()
    given = rows(docs, "doc_id long, text string").selectExpr("*", "doc_id AS _id", "'x' AS _digest")
    got = dc.clean(given, rows(items, "item_id long, text string"), 4)
    want = brute(docs, items, 4)
    assert got.columns == given.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_empty_tables(spark, rows):
    docs, items = rows([(1, "a b")], "doc_id long, text string"), rows([], "item_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[:6] for r in dc.report(docs, items).collect()] == [(1, 2, 0, 0, empty, False)]
    assert dc.clean(docs, items).count() == 1
    assert dc.report(docs.where("false"), docs.selectExpr("doc_id AS item_id", "text")).collect() == []


def test_no_python_in_the_plan(spark, rows):
    docs, items = made_up()
    plan = dc.report(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string"), 4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
