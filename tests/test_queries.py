"""Registered queries against their SQL, and properties of their plans."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from chatmill.operators import ranking
from chatmill.plans import augment, clean, evaluate, focus, ocr, synth
from workload.check import oracle_rows, spark_rows
from workload.fixtures import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(spark, SF, name) == oracle_rows(SF, entry_point.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_rows_only_queries_are_repeatable(spark, name):
    first = spark_rows(spark, SF, name)
    assert first[1] and first == spark_rows(spark, SF, name)


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["path", "correct", "total", "pct"]


def test_corrected_answers_pass_again(spark):
    cases = table(spark, SF, "backtest")
    fixed = entry_point.queries()["focus_corrected"](spark, SF)
    rescored = focus.scoring.score_asserts(
        cases.drop("output").join(fixed.select("case_pos", F.col("corrected").alias("output")), "case_pos")
    )
    assert rescored.count() > 0 and rescored.where("NOT passed").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_do_not_gather_or_cross(spark):
    raw, sft, variants = (table(spark, SF, n) for n in ("sft_raw", "sft", "variants"))
    cases, pages = table(spark, SF, "backtest"), table(spark, SF, "ocr_pages")
    plans = {
        "clean": clean.clean(raw, "s", "PROMPT>>").data,
        "augment": augment.augment(sft).data,
        "gate": synth.gate(variants, sft),
        "scores": evaluate.narrow_scores(cases),
        "ocr": ocr.corpus(pages),
        "anchors": focus.anchors(cases),
    }
    for name, df in plans.items():
        plan = plan_of(df)
        for gathering in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert gathering not in plan, name
    assert "WindowGroupLimit" in plan_of(plans["anchors"]) and "WindowGroupLimit" in plan_of(plans["ocr"])
    assert "Window " not in plan_of(plans["scores"])


def test_scans_read_only_what_is_used(spark):
    raw = table(spark, SF, "sft_raw")
    labels_only = plan_of(clean.clean(raw, "s").rejects)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in labels_only
    ids = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "rec_id")
    split = plan_of(ranking.digest_cuts(ids.withColumn("k", F.md5(F.col("rec_id").cast("string"))), "k", [F.lit(0.5)]))
    assert "text" not in split


def test_a_hot_seed_is_split(spark, rows):
    """One seed with a third of all variants: the adaptive planner splits its partition."""
    answer = '{"extracted_data": {"document_classification": "A"}}'
    seeds = rows([(i, "s", "u", answer) for i in range(200)], "rec_id long, system string, user_text string, answer string")
    variants = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 200 END AS seed_id", "CAST(id AS INT) AS variant",
        "'t' AS variant_text", f"'{answer}' AS label_text",
    )
    tuned = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in tuned}
    for k, v in tuned.items():
        spark.conf.set(k, v)
    try:
        gated = synth.gate(variants.repartition(16), seeds)
        assert len(gated.where("outcome = 'kept'").collect()) == 60_000
        gated.collect()
        assert "SortMergeJoin(skew=true)" in plan_of(gated)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
