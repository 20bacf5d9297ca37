"""The pipeline on a small folder of tables, stage by stage against brute force."""

import random

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_phrases, test_similar


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(14), text(60)
    docs, labels = [], []
    for k in range(160):
        body = text(rng.randint(30, 90))
        if k % 5 == 0:
            w = body.split()
            for at in (3, 11, 20):
                w[at] = "villain"
            body = " ".join(w)
        if k % 7 == 3:
            body += " " + passage
        if k % 11 == 4:
            body += " " + item
        docs.append((k, body, "en", f"src{k % 4}", len(body)))
        if k < 140:
            labels.append((k, 1, int(k % 5 == 0)))
    docs += [(200 + k, docs[k + 1][1] + " tail", "en", "src0", 0) for k in range(0, 40, 8)] + [(300, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def test_stages(spark, folder):
    path, rows, item = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "mixing_sources"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], path).toArrow(), docs.schema if len(seen) < 5 else None))
    texts = [sorted(((r["doc_id"], r["text"]) for r in s.collect()), key=str) for s in seen[:-1]]
    assert all(s.columns == columns for s in seen[:-1])
    kept = {i for i, _ in texts[1]}
    toxic = {i for i, t, *_ in rows if t and "villain" in t}
    assert len(toxic & kept) <= 0.1 * len(toxic) and {i for i, *_ in rows} - toxic <= kept
    same = {i for i, _, c in test_similar.brute(texts[1], 5, 75) if i == c}
    assert {i for i, _ in texts[2]} == same
    cut = [(i, t if not gone else left.decode()) for (i, t), (_, _, gone, left) in zip(texts[2], test_phrases.brute(texts[2], 35))]
    assert texts[3] == cut
    clean = {w[0] for w in test_decontaminate.brute(texts[3], [(1, item)], 10) if not w[5]}
    assert {i for i, _ in texts[4]} == clean
    mixed = seen[-1].collect()
    assert {r["doc_id"] for r in mixed} <= clean and {r["copy"] for r in mixed} <= {1, 2}


def test_run_returns_the_mix(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() > 0
