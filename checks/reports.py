"""Item pages, statistics and health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import ledger_from_orders, naive, part_items, table
from checks.state import CHECKPOINTS_SQL, RUNS_SQL
from millrace.operators.ledger import current_runs, fold_checkpoints
from millrace.plans.items import item_page, item_query, keyset_page, page_metadata, public_items
from millrace.plans.stats import (
    checkpoint_listing,
    health,
    recent_runs,
    stats_by_source,
    stats_groups,
    stats_summary,
)
from millrace.session import durable

UTC = dt.timezone.utc
FILTERS = {
    "source_type": "csv",
    "category": "ECONOMY",
    "status": "active",
    "min_amount": 905.0,
    "max_amount": 1500.0,
    "published_after": dt.datetime(2024, 1, 15, tzinfo=UTC),
    "published_before": dt.datetime(2024, 2, 5, tzinfo=UTC),
}


def _shown(items: DataFrame) -> DataFrame:
    shown = public_items(items)
    times = ("published_at", "created_at", "updated_at")
    return shown.select(*[naive(c) if c in times else F.col(c) for c in shown.columns])


def item_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(item_query(part_items(spark, sf_dir), **FILTERS))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws("_", "source", "lang").alias("title"),
        F.col("text").alias("description"),
    )


def item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``%`` in the term is a wildcard; the search reads the whole texts."""
    return item_query(_documents(spark, sf_dir), search="SHa%wither").select("id", "title")


def item_search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_query(
        _documents(spark, sf_dir), search="C0_EN", literal_search=True
    ).select("id", "title")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(item_page(part_items(spark, sf_dir), page=3, size=25))


def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(
        item_page(part_items(spark, sf_dir), page=2, size=40, sort_by="published_at")
    )


def sorted_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(
        item_page(part_items(spark, sf_dir), size=60, sort_by="title", sort_order="asc")
    )


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = (dt.datetime(2024, 1, 1, 2, 30, tzinfo=UTC), "150")
    return _shown(keyset_page(part_items(spark, sf_dir), after, 30))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = item_query(part_items(spark, sf_dir), status="active")
    return page_metadata(items, page=4, size=30)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, runs and checkpoints; the runs are kept, as statistics read them more than once."""
    runs_and_marks = ledger_from_orders(spark, sf_dir)
    items = part_items(spark, sf_dir).withColumn("source_type", F.lit("csv"))
    return items, current_runs(runs_and_marks), durable(fold_checkpoints(runs_and_marks))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = stats_summary(*_tables(spark, sf_dir))
    return shown.select(
        "total_records", "total_sources", "active_sources", "total_runs",
        "avg_run_duration_seconds", naive("last_success"), naive("last_failure"),
    )


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = stats_by_source(*_tables(spark, sf_dir))
    return shown.select(
        "source_type", "source_name", "total_records", "active_records", naive("last_run_at"),
        naive("last_success_at"), naive("last_failure_at"), "total_runs", "success_rate",
        "avg_records_per_run", F.round("avg_duration_seconds", 4).alias("avg_duration_seconds"),
    )


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = current_runs(ledger_from_orders(spark, sf_dir))
    return recent_runs(runs, 40).select(
        "run_id", "source_type", naive("started_at"),
        F.coalesce(F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias(
            "completed_at"
        ),
        "records_extracted", "records_loaded", "records_failed",
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = stats_groups(part_items(spark, sf_dir))
    return shown.withColumn("value", F.coalesce("value", F.lit("-")))


def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(fold_checkpoints(ledger_from_orders(spark, sf_dir)))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = checkpoint_listing(fold_checkpoints(ledger_from_orders(spark, sf_dir)))
    return shown.select(
        "source_type", "source_name", "status", naive("last_run_at"),
        "total_records_processed", "last_records_processed", "checkpoint_value",
        F.coalesce("error_message", F.lit("-")).alias("error_message"),
    )


_ITEMS = """
    SELECT CAST(p_partkey AS VARCHAR) AS id,
           CASE WHEN p_size % 2 = 0 THEN 'csv' ELSE 'api' END AS source_type,
           'src' || (p_partkey % 5) AS source_name, CAST(p_partkey AS VARCHAR) AS external_id,
           p_name AS title, p_brand || ' ' || p_type AS description, p_type AS category,
           p_retailprice AS amount, p_size / 10 AS rating,
           CASE WHEN p_size > 10 THEN 'active' ELSE 'inactive' END AS status,
           CASE WHEN p_size <= 40 THEN TIMESTAMP '2024-01-01' + to_days(p_size) END AS published_at,
           TIMESTAMP '2024-01-01' + to_minutes(p_partkey % 1000) AS created_at,
           TIMESTAMP '2024-01-01' + to_minutes(p_partkey % 1000) AS updated_at
    FROM part
"""

QUERIES = {
    "item_filter": (item_filter, f"""
        SELECT * FROM ({_ITEMS})
        WHERE source_type = 'csv' AND category = 'ECONOMY' AND status = 'active'
          AND amount BETWEEN 905 AND 1500
          AND published_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-02-05'"""),
    "item_search": (item_search, """
        SELECT doc_id AS id, source || '_' || lang AS title FROM documents
        WHERE text ILIKE '%SHa%wither%' OR source || '_' || lang ILIKE '%SHa%wither%'"""),
    "item_search_literal": (item_search_literal, """
        SELECT doc_id AS id, source || '_' || lang AS title FROM documents
        WHERE contains(lower(text), 'c0_en') OR contains(lower(source || '_' || lang), 'c0_en')"""),
    "item_page": (paged, f"""
        SELECT * FROM ({_ITEMS}) ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"""),
    "item_sort": (sorted_page, f"""
        SELECT * FROM ({_ITEMS}) ORDER BY published_at DESC NULLS FIRST, id LIMIT 40 OFFSET 40"""),
    "item_sort_title": (sorted_title, f"""
        SELECT * FROM ({_ITEMS}) ORDER BY title ASC NULLS LAST, id LIMIT 60"""),
    "keyset_page": (next_page, f"""
        SELECT * FROM ({_ITEMS})
        WHERE created_at < TIMESTAMP '2024-01-01 02:30:00'
           OR created_at = TIMESTAMP '2024-01-01 02:30:00' AND id > '150'
        ORDER BY created_at DESC, id LIMIT 30"""),
    "page_meta": (page_meta, """
        SELECT count(*) AS total_items, CAST(ceil(count(*) / 30) AS BIGINT) AS total_pages,
               4 AS current_page, 30 AS page_size, 4 < ceil(count(*) / 30) AS has_next,
               true AS has_previous
        FROM part WHERE p_size > 10"""),
    "stats_summary": (summary, f"""
        SELECT (SELECT count(*) FROM part) AS total_records, count(*) AS total_sources,
               count(*) AS active_sources, (SELECT count(*) FROM orders) AS total_runs,
               (SELECT round(avg(duration_seconds), 2) FROM ({RUNS_SQL}) WHERE status = 'success')
                   AS avg_run_duration_seconds,
               max(last_success_at) AS last_success, max(last_failure_at) AS last_failure
        FROM ({CHECKPOINTS_SQL})"""),
    "stats_by_source": (by_source, f"""
        SELECT source_type, source_name, total_records, active_records, last_run_at,
               last_success_at, last_failure_at, total_runs,
               round(100.0 * successes / total_runs, 1) AS success_rate,
               round(total_records_processed / total_runs, 1) AS avg_records_per_run,
               round(mean_duration, 4) AS avg_duration_seconds
        FROM ({CHECKPOINTS_SQL})
        JOIN (SELECT 'src' || (p_partkey % 5) AS source_name, count(*) AS total_records,
                     count(*) FILTER (WHERE p_size > 10) AS active_records
              FROM part GROUP BY 1) USING (source_name)
        JOIN (SELECT source_name, count(*) FILTER (WHERE status = 'success') AS successes,
                     avg(duration_seconds) FILTER (WHERE status = 'success') AS mean_duration
              FROM ({RUNS_SQL}) GROUP BY 1) USING (source_name)"""),
    "stats_recent": (recent, f"""
        SELECT run_id, source_type, started_at,
               coalesce(strftime(completed_at, '%Y-%m-%d %H:%M:%S'), '-') AS completed_at,
               coalesce(records_extracted, 0) AS records_extracted,
               coalesce(records_loaded, 0) AS records_loaded,
               CAST(coalesce(records_failed, 0) AS BIGINT) AS records_failed
        FROM ({RUNS_SQL}) ORDER BY started_at DESC, run_id LIMIT 40"""),
    "stats_groups": (groups, f"""
        SELECT 'source_type' AS "grouping", source_type AS value, count(*) AS records
        FROM ({_ITEMS}) GROUP BY 2
        UNION ALL SELECT 'category', category, count(*) FROM ({_ITEMS}) GROUP BY 2
        UNION ALL SELECT 'total', '-', count(*) FROM ({_ITEMS})"""),
    "health": (health_status, f"""
        SELECT count(*) AS total_sources,
               count(*) FILTER (WHERE status = 'success') AS successful_sources,
               count(*) FILTER (WHERE status = 'failed') AS failed_sources,
               CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'healthy'
                    WHEN count(*) FILTER (WHERE status = 'failed') < count(*) THEN 'degraded'
                    ELSE 'unhealthy' END AS status
        FROM ({CHECKPOINTS_SQL})"""),
    "health_checkpoints": (checkpoints, f"""
        SELECT c.source_type, c.source_name, c.status, last_run_at, total_records_processed,
               last_records_processed, checkpoint_value, coalesce(e.error_message, '-')
                   AS error_message
        FROM ({CHECKPOINTS_SQL}) c
        JOIN (SELECT source_name, arg_max(struct_pack(error_message := error_message),
                                          (started_at, run_id)).error_message AS error_message
              FROM ({RUNS_SQL}) WHERE event_seq = 2 GROUP BY 1) e USING (source_name)"""),
}
