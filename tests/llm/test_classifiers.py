"""Held-out quality of the trained operators, and their odd cases."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatmill.llm import language, quality, toxicity
from chatmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n", None), (4, "12 34", "en"), (5, "word " * 50_000, "en"), (6, "same", "de"), (6, "same", "de"),
       (None, "no id", None)]
SCHEMA = "doc_id long, text string, lang string"


@needs_tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language"](spark, SF).join(docs, "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1 and got.count() == 10_000


@needs_tables
def test_quality_held_out(spark):
    got = QUERIES["op9_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right = got.groupBy("quality").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right")).collect()
    assert all(r["right"] > 0.95 for r in right) and len(right) == 2


@needs_tables
def test_toxicity_held_out(spark):
    got = QUERIES["op10_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right = {r["toxic"]: r["right"] for r in got.groupBy("toxic").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("right")).collect()}
    assert right[0] > 0.98 and right[1] > 0.8


def test_language_letters_ties_and_plain_scores(spark, rows):
    """Texts without a letter are ``und``; batch scores equal a loop over n-grams; equal languages give the first name."""
    learn = rows([(i, t, lang) for i, (t, lang) in enumerate([("abc abd", "x"), ("abc abd", "y"), ("zzz zyz", "z")] * 5)], SCHEMA)
    docs = rows([(1, "½ ²", "x"), (2, "abc", "x"), (3, "١٢", "x"), (4, "zz z!", "x"), (5, "é", "x"), (6, "Ⅷ ①", "x"), (7, "abd " * 3, "x")], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, learn).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[6] == ("und", 0.0) and got[2][0] == "x" and got[4][0] == "z"
    model = language.train(learn)
    for i, text in ((2, "abc"), (4, "zz z!"), (5, "é"), (7, "abd " * 3)):
        ids, _ = language.ngrams([text])
        total = [sum(float(model.log_probability[n][k][c]) for n, own in enumerate(ids) for k in own.tolist()) for c in range(3)]
        best = int(np.argmax(total))
        posterior = 1 / sum(np.exp(t - total[best]) for t in total)
        assert got[i][0] == model.names[best] and got[i][1] == pytest.approx(posterior, rel=1e-4)


def test_language_sample_is_cut_by_histogram(spark):
    hashed = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id < 9 THEN 'rare' ELSE 'b' END AS lang", "xxhash64(id) AS hash")
    cut = language.below(hashed, 500)
    kept = hashed.join(cut, "lang").where("shiftright(hash, 44) <= upto")
    counts = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    assert counts["rare"] == 6 and 500 <= counts["hot"] <= 502 and 500 <= counts["b"] <= 502
    least = hashed.where("lang = 'hot'").orderBy("hash").limit(500)
    assert least.join(kept, "doc_id", "left_anti").count() == 0


def training(n=200):
    good, bad = "the cat sat on a mat and", "you utter villain and"
    return [(1000 + k, (good if k % 4 else bad) + f" w{k} word", "en", int(k % 4 == 0)) for k in range(n)]


def test_toxicity_odd_rows(spark, rows):
    known = training()
    docs = rows(ODD + [k[:3] for k in known], SCHEMA).selectExpr("*", "1 AS score", "2 AS label", "3 AS _id")
    labels = rows([(k[0], k[3]) for k in known], "doc_id long, label int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(ODD) + len(known) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert np.mean([by_id[k[0]] == k[3] for k in known]) > 0.95 and not any(by_id[k] for k in (1, 2, 3, 4, 5, 6))
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)
    one_class = toxicity.score(docs, labels.where("label = 0")).collect()
    assert {r["score"] for r in one_class} == {0.0}
    assert toxicity.score(docs.where("false"), labels).collect() == []
    assert {r["score"] for r in toxicity.score(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_thresholds_from_all_labelled_rows(spark, rows):
    """The histogram's threshold equals a plain search over all rows not fitted, weighted to the real share, by language."""
    rng = np.random.default_rng(4)
    data = []
    for k in range(3000):
        label, guess = int(rng.random() < 0.1), int(rng.integers(0, 3))
        data.append((k, float(rng.normal(3 * label + guess, 1.0)), guess, bool(rng.random() < (0.5 if label else 0.05))))
        data[-1] += (label,)
    logits = rows([d[:4] for d in data], "doc_id long, logit double, guess long, fitted boolean")
    labels = rows([(d[0], d[4]) for d in data] * 2 + [(None, 1), (5, None), (99_999, 1)], "doc_id long, label int")
    bins = toxicity.histogram(logits, labels).toArrow()
    assert sum(bins.column("n").to_pylist()) == len(data)
    got = 0.5 - toxicity.shifts(bins, 3, 1 / (1 + np.exp(-0.5)))
    total, left = [[sum(d[4] == c and not (d[3] and part) for d in data) for c in (0, 1)] for part in (False, True)]
    for k in range(3):
        own = [(d[1], d[4], total[d[4]] / left[d[4]]) for d in data if d[2] == k and not d[3]]

        def f1(t):
            hit = sum(w for x, y, w in own if y and x > t)
            return 2 * hit / (sum(w for x, y, w in own if x > t) + sum(w for x, y, w in own if y))

        assert f1(got[k]) >= max(f1(x - 1e-9) for x, _, _ in own) - 0.01
    few = toxicity.shifts(bins, 3, 0.5, min_positive=10**6)
    assert len(set(few.tolist())) == 1
    assert toxicity.shifts(bins.slice(0, 0), 2, 0.5).tolist() == [0.0, 0.0]


def test_toxicity_scores_equal_a_plain_loop(spark, rows):
    """Batch logits equal a loop over words, widths and filters; repeated ids and labels do not multiply the sample."""
    known = training()
    docs = rows(ODD + [k[:3] for k in known] * 3, SCHEMA)
    labels = rows([(k[0], k[3]) for k in known] * 2, "doc_id long, label int")
    assert toxicity.sample(docs, labels, 2000, 65_536).count() == len(known)
    model, logits = toxicity.calibrated(docs, labels, 0.7, 2000, 65_536, 3)
    texts = {k: t for k, t, _ in ODD if k in (1, 2, 4)} | {k[0]: k[1] for k in known[:8]}
    found = {r["doc_id"]: r["logit"] for r in logits.collect()}
    for k, text in texts.items():
        ids, _ = toxicity.features(pa.array([text], pa.string()))
        vectors = [sum(model.embedding[j] for j in word) for word in ids.tolist()]
        vectors += [np.zeros(toxicity.DIM, dtype=np.float32)] * max(toxicity.WIDTHS)
        total, layer = model.bias, 0
        for i, width in enumerate(toxicity.WIDTHS):
            best = np.full(toxicity.FILTERS, -np.inf)
            for at in range(max(1, len(ids))):
                best = np.maximum(best, sum(vectors[at + j] @ model.filters[layer + j] for j in range(width)))
            own = model.output[i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS]
            total += float(np.maximum(best + model.filter_bias[i], 0) @ own)
            layer += width
        assert found[k] == pytest.approx(total, abs=1e-3)


def test_quality_odd_rows(spark, rows):
    known = [(2000 + k, "good plain text of words" if k % 3 else "BAD!! BAD!! BAD!!", "en", int(k % 3 > 0)) for k in range(150)]
    docs = rows(ODD + [k[:3] for k in known], SCHEMA).selectExpr("*", "1 AS score", "2 AS upper", "3 AS n_words")
    labels = rows([(k[0], k[3]) for k in known] + [(1, None)], "doc_id long, label int")
    got = quality.score(docs, labels).collect()
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert len(got) == len(ODD) + len(known) and all(by_id[k[0]] == k[3] for k in known)
    assert {r["score"] for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert all(r["score"] > 0.99 for r in quality.score(docs, labels.where("label = 1")).collect())
    assert quality.score(docs.where("false"), labels).collect() == []


def test_compiled_column_is_the_ensemble(spark, rows):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.5)).astype(int)
    rules, intercept = quality.fit(x, y)
    want = 1 / (1 + np.exp(-(intercept + sum(w * quality.applies(r, x) for r, w in rules))))
    table = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in quality.STATISTICS))
    got = [r[0] for r in table.select(quality.compiled(rules, intercept)).collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.97 and 0 < len(rules) < 60


def test_statistics():
    got = quality.statistics(pa.array([None, "", "Ab b b 1!", "x\nx\ny"]))
    by = dict(zip(quality.STATISTICS, got.T))
    assert by["n_words"].tolist() == [0, 0, 4, 3] and by["longest_repeat"].tolist() == [0, 0, 2, 2]
    assert by["repeat_next"].tolist() == [0, 0, 0.25, 1 / 3] and by["distinct_lines"].tolist() == [0, 0, 1, 2 / 3]
    assert by["upper"][2] == 1 / 9 and by["digit"][2] == 1 / 9 and by["exclaim"][2] == 1 / 9


def test_language_odd_rows(spark, rows):
    known = [(k, t, la) for k in range(100, 160) for t, la in [("the cat and the dog of that", "en")]]
    known += [(k, "der hund und die katze nicht", "de") for k in range(200, 260)]
    docs = rows(ODD + known, SCHEMA).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS n")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, docs).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 4)) and got[100][0] == "en" and got[200][0] == "de"
    nothing = language.identify(docs, docs.where("false")).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)} and len(nothing) == len(ODD) + len(known)
    assert language.identify(docs.where("false"), docs).collect() == []


def test_ngrams_stay_in_their_row():
    ids, offsets = language.ngrams(["ab", "", "ab"])
    assert offsets.tolist() == [0, 2, 2, 4]
    assert all(x[:2].tolist() == x[2:].tolist() for x in ids)
