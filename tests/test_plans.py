"""Shape of the physical plans."""

import pytest

import __spark_entry__ as entry_module
from bizcontacts.operators.campaign import running_total
from bizcontacts.operators.contacts import explode_found, pin, spread
from pyspark.sql import functions as F

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
QUERIES = entry_module.queries()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_by_row(spark, sf_dir, name):
    plan = executed(QUERIES[name](spark, sf_dir))
    assert not [w for w in UNWANTED if w in plan]


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = executed(QUERIES["q_lead_stats"](spark, sf_dir))
    assert "o_totalprice" not in plan and "c_acctbal" not in plan
    plan = executed(QUERIES["q_doc_emails"](spark, sf_dir))
    assert "StringContains(text,@)" in plan and "n_chars" not in plan


def test_page_extraction_is_done_once(spark, sf_dir):
    plan = executed(QUERIES["q_enrich_email"](spark, sf_dir))
    assert plan.count("!doctype") == 1
    plan = executed(QUERIES["q_site_emails"](spark, sf_dir))
    assert plan.count("!doctype") == 1


def test_pinned_column_is_not_repeated_by_a_filter(spark):
    base = spark.range(10).select(F.col("id").cast("string").alias("t"))
    costly = F.regexp_replace("t", "1+", "x")
    assert executed(pin(base, "c", costly).where("c = 'x'")).count("regexp_replace") == 1
    assert pin(base, "c", costly).where("c = 'x'").count() == 1
    found = explode_found(base.withColumn("a", F.regexp_extract_all("t", F.lit("[0-9]"), F.lit(0))), "a", "d")
    assert executed(found).count("regexp_extract_all") == 1 and found.count() == 10


def test_numbering_has_no_single_task(spark, sf_dir):
    for name in ("q_campaign_plan", "q_campaign_group"):
        plan = executed(QUERIES[name](spark, sf_dir))
        assert "SinglePartition" not in plan and "Window" in plan
    rows = [(k ** 5, k) for k in range(60)]
    df = spark.createDataFrame(rows, "p long, w long").repartition(5)
    got = {r.p: r.t for r in running_total(df, "p", "w", "t", block=1024).collect()}
    assert got == {p: sum(w for _, w in rows[:k]) for k, (p, _) in enumerate(rows)}


def test_latest_and_last_outcomes_do_not_sort_texts(spark, sf_dir):
    for name in ("q_crawl_outcomes", "q_existing_latest"):
        assert "SortAggregate" not in executed(QUERIES[name](spark, sf_dir))


def test_spread_only_small_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "REPARTITION" in executed(spread(docs, "doc_id"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert "REPARTITION" not in executed(spread(docs, "doc_id"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
