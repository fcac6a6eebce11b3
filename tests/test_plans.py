"""Properties of physical plans: what reaches the scan, and what must not appear."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from checks import flow, mapping, reports, state
from millrace.operators.upsert import upsert
from millrace.schemas import ITEM_IMMUTABLE, ITEM_KEYS, ITEM_MUTABLE

SF_DIR = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")
# Their queries run streams or runs before they return, or are the one operator in Python.
OTHERS = {
    "stream_upsert", "stream_late", "stream_dedup", "stream_circuit", "ingest_items", "ingest_runs", "paged_source",
    "circuit_state", "csv_scan", "feed_scan", "feed_reject", "csv_mixed_headers", "feed_mixed", "ingest_resume",
    "ingest_isolated", "stream_late_watermark",
}
LIBRARY = {"flagship", *mapping.QUERIES, *state.QUERIES, *reports.QUERIES, *flow.QUERIES}


def plan_of(spark, name):
    return spark_entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(LIBRARY - OTHERS))
def test_no_product_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not [node for node in PYTHON_NODES if node in plan]


def test_marks_and_filters_are_pushed(spark):
    assert "GreaterThan(ts" in plan_of(spark, "hwm_time")
    assert "EqualTo(p_type,ECONOMY)" in plan_of(spark, "item_filter")


def test_scans_read_only_the_columns_they_need(spark):
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan_of(spark, "hwm_id_text")
    assert "ReadSchema: struct<p_size:int>" in plan_of(spark, "page_meta")


def test_pages_are_taken_without_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "item_page")
    assert "TakeOrderedAndProject" in plan_of(spark, "stats_recent")


def test_dedup_shuffles_once(spark):
    assert plan_of(spark, "content_dedup").count("Exchange hashpartitioning") == 1


def test_upsert_shuffles_each_side_once(spark):
    def side(n):
        rows = spark.range(n).withColumns(
            {c: F.lit("x") for c in (*ITEM_KEYS, *ITEM_MUTABLE, *ITEM_IMMUTABLE, "ingested_at", "ordinal")}
        )
        return rows.withColumn("external_id", F.col("id").cast("string"))

    result = upsert(side(30), side(20))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "SinglePartition" not in plan
