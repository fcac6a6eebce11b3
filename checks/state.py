"""Upserts, marks, the run ledger and lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import AS_OF, ledger_from_orders, naive, table
from millrace.operators.incremental import incremental, next_marks
from millrace.operators.landing import backlog, dedup_content, unprocessed
from millrace.operators.ledger import current_runs, fold_checkpoints, phase_means, run_anomalies
from millrace.operators.lineage import item_to_run, lineage
from millrace.operators.upsert import duplicate_keys, mark_deleted, upsert
from millrace.operators.validate import reject_attempts

CUT = dt.datetime(2024, 1, 16)
KEYS, MUTABLE, IMMUTABLE = (
    ("event_type", "user_id"),
    ("amount", "props", "updated_at"),
    ("first_event_id", "created_at"),
)


def _change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_type", "user_id", "ts", "event_id", "props",
        F.when(F.col("value") >= 50, F.col("value")).alias("amount"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("first_event_id"),
        F.col("ts").alias("created_at"),
    )


def _apply(target: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(target, updates, KEYS, MUTABLE, IMMUTABLE, seq=("ts", "event_id"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of the month's first half as target, the second half as updates."""
    log = _change_log(spark, sf_dir)
    empty = spark.createDataFrame([], log.schema)
    target = _apply(empty, log.filter(F.col("ts") < F.lit(CUT)))
    return _apply(target, log.filter(F.col("ts") >= F.lit(CUT)))


def upsert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All updates applied twice; the audit of duplicate keys stays empty."""
    log = _change_log(spark, sf_dir)
    once = _apply(spark.createDataFrame([], log.schema), log)
    twice = _apply(once, log)
    copies = duplicate_keys(twice, KEYS)
    return twice.join(copies, list(KEYS), "left").withColumn(
        "copies", F.coalesce("copies", F.lit(1).cast("bigint"))
    )


def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a source holds more than once."""
    documents = table(spark, sf_dir, "documents")
    return duplicate_keys(documents.select("source", F.md5("text").alias("text_md5")),
                          ["source", "text_md5"])


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return dedup_content(documents, ["source"], "text", ["doc_id"]).select(
        "source", "doc_id", "content_hash", "copies"
    )


def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, after a full snapshot that holds only those with a balance of at least zero."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.lit("active").alias("status"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    snapshot = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
    return mark_deleted(customers, snapshot, ["c_custkey"], AS_OF).select(
        "c_custkey", "c_name", "status", naive("deleted_at")
    )


def _time_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type, the last time in the month's first half."""
    early = table(spark, sf_dir, "events").filter(F.col("ts") < F.lit(CUT))
    iso = F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return early.groupBy("event_type").agg(iso.alias("checkpoint_value"))


def hwm_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return incremental(events, _time_marks(spark, sf_dir), ["event_type"], "ts")


def hwm_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``hwm_time`` by way of a join, as with very many sources."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return incremental(
        events, _time_marks(spark, sf_dir), ["event_type"], "ts", max_literal_marks=0
    )


def hwm_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of a source without a name, by literals and by the join: ``both`` counts the ways that keep a row."""
    name = F.when(F.col("event_type") != "click", F.col("event_type")).alias("name")
    events = table(spark, sf_dir, "events").select("event_id", name, "ts")
    marks = _time_marks(spark, sf_dir).select(name, "checkpoint_value")
    ways = [incremental(events, marks, ["name"], "ts", max_literal_marks=n) for n in (64, 0)]
    return ways[0].unionByName(ways[1]).groupBy("event_id").agg(F.count("*").alias("both"))


def hwm_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources have no mark and load in full."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    marks = _time_marks(spark, sf_dir).filter(~F.col("event_type").isin("click", "view"))
    return incremental(events, marks, ["event_type"], "ts")


def _id_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority, the least order key of its failed orders from 1996 on."""
    orders = table(spark, sf_dir, "orders").filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit(dt.datetime(1996, 1, 1)))
    )
    return orders.groupBy("o_orderpriority").agg(
        F.min("o_orderkey").cast("string").alias("checkpoint_value")
    )


def _hwm_id(spark: SparkSession, sf_dir: str, id_order: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return incremental(
        orders, _id_marks(spark, sf_dir), ["o_orderpriority"], "o_orderkey", "id", id_order
    )


def hwm_id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hwm_id(spark, sf_dir, "string")


def hwm_id_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hwm_id(spark, sf_dir, "numeric")


def rss_undated_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated entries are never older than the mark."""
    undated = F.when(F.col("event_type") != "error", F.col("ts"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", undated.alias("ts"))
    return incremental(events, _time_marks(spark, sf_dir), ["event_type"], "ts", keep_null=True)


def hwm_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next marks: by time, by id as text, by id as number; errors are undated, refunds are silent."""
    events = table(spark, sf_dir, "events").select(
        "event_type",
        F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").cast("string").alias("event_id"),
    )
    silent = spark.createDataFrame(
        [("refund", "2023-12-31T00:00:00"), ("click", "7")],
        "event_type string, checkpoint_value string",
    )
    by_time = next_marks(events, silent, ["event_type"], "ts", "timestamp", AS_OF)
    as_text = next_marks(events, silent, ["event_type"], "event_id", "id", AS_OF)
    as_number = next_marks(events, silent, ["event_type"], "event_id", "id", AS_OF, "numeric")
    return by_time.join(
        as_text.select("event_type", F.col("checkpoint_value").alias("text_mark")), "event_type"
    ).join(
        as_number.select("event_type", F.col("checkpoint_value").alias("number_mark")), "event_type"
    )


def run_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_runs(ledger_from_orders(spark, sf_dir)).select(
        "run_id", "source_name", "event_seq", "status", naive("started_at"), naive("completed_at"),
        "duration_seconds", "records_extracted", "records_loaded", "records_failed",
        "checkpoint_after", "error_message",
    )


def checkpoint_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_checkpoints(ledger_from_orders(spark, sf_dir)).select(
        "source_type", "source_name", "checkpoint_value", naive("last_run_at"),
        naive("last_success_at"), naive("last_failure_at"), "total_runs",
        "total_records_processed", "last_records_processed", "status",
    )


def run_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = current_runs(ledger_from_orders(spark, sf_dir)).filter(F.col("event_seq") == 2)
    found = run_anomalies(runs, k=5, z=2.37, block_rows=500)
    return found.select(
        "source_name", "run_id", "run_no", "value", "previous",
        F.round("window_mean", 6).alias("window_mean"),
        F.round("window_stddev", 6).alias("window_stddev"), "is_anomaly",
    )


def phase_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = (
        F.when(F.col("event_type") == "click", "extraction")
        .when(F.col("event_type") == "view", "transformation")
        .when(F.col("event_type") == "purchase", "loading")
    )
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), phase.alias("phase"), F.col("value").alias("elapsed_ms")
    )
    means = phase_means(events)
    return means.select("run_id", *[F.round(c, 6).alias(c) for c in means.columns[1:]])


def lineage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items, orders as their raw rows, customers as runs."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("id"),
        F.lit("csv").alias("source_type"), F.lit("lines").alias("source_name"),
        F.col("l_partkey").cast("string").alias("external_id"),
        F.col("l_orderkey").alias("raw_data_id"), F.col("l_suppkey").alias("etl_run_id"),
    )
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("raw_id"), F.col("o_orderpriority").alias("source_id"),
        F.col("o_orderdate").alias("ingested_at"), F.col("o_orderstatus").alias("file_path"),
        F.col("o_custkey").alias("etl_run_id"),
    )
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("status"),
        F.col("c_name").alias("started_at"),
    )
    return lineage(items, raw, runs)


def item_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, customers as the runs that wrote them."""
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("etl_run_id"), "o_orderpriority"
    )
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("status")
    )
    return item_to_run(items, runs)


def reject_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as rejects of a user's record, one run per event."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    rejects = events.select(
        F.lit("api").alias("source_type"), F.lit("events").alias("source_name"),
        F.col("user_id").cast("string").alias("raw_data_id"), F.col("ts").alias("at"),
        F.col("event_id").cast("string").alias("etl_run_id"), F.col("props").alias("message"),
    )
    return reject_attempts(rejects)


def _raw_and_processed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("raw_id"), F.lit("csv").alias("source_type"),
        F.col("o_orderpriority").alias("source_name"),
        F.col("o_orderdate").cast("timestamp").alias("ingested_at"),
    )
    processed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raw_id"))
    return raw, processed


def unprocessed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, processed = _raw_and_processed(spark, sf_dir)
    return unprocessed(raw, processed).select("raw_id", "source_name", naive("ingested_at"))


def backlog_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, processed = _raw_and_processed(spark, sf_dir)
    return backlog(raw, processed, AS_OF).select(
        "source_type", "source_name", "pending", naive("oldest_ingested_at"), "oldest_age_seconds"
    )


_LOG = "SELECT *, CASE WHEN value >= 50 THEN value END AS amount FROM events"
_UPSERTED = f"""
    SELECT event_type, user_id,
           arg_max(struct_pack(amount := amount, props := props, ts := ts), ts) AS l,
           arg_min(event_id, ts) AS first_event_id, min(ts) AS created_at
    FROM ({_LOG}) GROUP BY event_type, user_id
"""
_MARKS = """
    SELECT event_type, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1
"""
_ID_MARKS = """
    SELECT o_orderpriority, min(o_orderkey) AS mark FROM orders
    WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1
"""
RUNS_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'csv' AS source_type,
           'src' || (o_custkey % 5) AS source_name,
           CASE WHEN records IS NULL THEN 0 ELSE 2 END AS event_seq,
           CASE WHEN records IS NULL THEN 'running' WHEN o_orderstatus = 'F' THEN 'failed'
                WHEN o_orderstatus = 'O' THEN 'success' ELSE 'partial' END AS status,
           o_orderdate AS started_at,
           CASE WHEN records IS NOT NULL THEN o_orderdate
                + to_microseconds(CAST(round(o_totalprice * 100) AS BIGINT) * 10000) END
               AS completed_at,
           CASE WHEN records IS NOT NULL
                THEN CAST(round(o_totalprice * 100) AS BIGINT) * 10000 / 1000000.0 END
               AS duration_seconds,
           records AS records_extracted,
           records - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS records_loaded,
           CAST(CASE WHEN records IS NULL THEN NULL WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END
               AS BIGINT) AS records_failed,
           CASE WHEN records IS NOT NULL AND o_orderstatus <> 'F'
                THEN CAST(o_orderkey AS VARCHAR) END AS checkpoint_after,
           CASE WHEN records IS NOT NULL AND o_orderstatus = 'F' THEN o_orderpriority END
               AS error_message
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS records FROM lineitem GROUP BY 1)
         ON l_orderkey = o_orderkey
"""
CHECKPOINTS_SQL = f"""
    SELECT source_type, source_name,
           arg_max(checkpoint_after, (started_at, run_id))
               FILTER (WHERE checkpoint_after IS NOT NULL) AS checkpoint_value,
           max(completed_at) AS last_run_at,
           max(completed_at) FILTER (WHERE status = 'success') AS last_success_at,
           max(completed_at) FILTER (WHERE status = 'failed') AS last_failure_at,
           count(*) FILTER (WHERE event_seq = 2) AS total_runs,
           CAST(coalesce(sum(records_extracted), 0) AS BIGINT) AS total_records_processed,
           arg_max(records_extracted, (started_at, run_id)) FILTER (WHERE event_seq = 2)
               AS last_records_processed,
           arg_max(status, (started_at, run_id)) FILTER (WHERE event_seq = 2) AS status
    FROM ({RUNS_SQL}) GROUP BY ALL
"""

QUERIES = {
    "upsert_latest": (upsert_latest, f"""
        SELECT event_type, user_id, l.amount AS amount, l.props AS props, l.ts AS updated_at,
               first_event_id, created_at FROM ({_UPSERTED})"""),
    "upsert_replay": (upsert_replay, f"""
        SELECT event_type, user_id, l.amount AS amount, l.props AS props, l.ts AS updated_at,
               first_event_id, created_at, CAST(1 AS BIGINT) AS copies FROM ({_UPSERTED})"""),
    "key_audit": (key_audit, """
        SELECT source, md5(text) AS text_md5, count(*) AS copies FROM documents
        GROUP BY ALL HAVING count(*) > 1"""),
    "content_dedup": (content_dedup, """
        SELECT source, min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies
        FROM documents GROUP BY source, text"""),
    "soft_delete": (soft_delete, """
        SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'deleted' END AS status,
               CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-02-01' END AS deleted_at
        FROM customer"""),
    "hwm_time": (hwm_time, f"""
        SELECT event_id, event_type, ts FROM events JOIN ({_MARKS}) USING (event_type)
        WHERE ts > mark"""),
    "hwm_joined": (hwm_joined, f"""
        SELECT event_id, event_type, ts FROM events JOIN ({_MARKS}) USING (event_type)
        WHERE ts > mark"""),
    "hwm_null_key": (hwm_null_key, """
        WITH marks AS (
            SELECT event_type, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY event_type)
        SELECT event_id, CAST(2 AS BIGINT) AS "both"
        FROM events LEFT JOIN marks USING (event_type) WHERE mark IS NULL OR ts > mark"""),
    "hwm_multi": (hwm_multi, f"""
        SELECT event_id, event_type, ts FROM events JOIN ({_MARKS}) USING (event_type)
        WHERE ts > mark OR event_type IN ('click', 'view')"""),
    "hwm_id_text": (hwm_id_text, f"""
        SELECT o_orderkey, o_orderpriority FROM orders LEFT JOIN ({_ID_MARKS}) USING (o_orderpriority)
        WHERE mark IS NULL OR CAST(o_orderkey AS VARCHAR) > CAST(mark AS VARCHAR)"""),
    "hwm_id_numeric": (hwm_id_numeric, f"""
        SELECT o_orderkey, o_orderpriority FROM orders LEFT JOIN ({_ID_MARKS}) USING (o_orderpriority)
        WHERE mark IS NULL OR o_orderkey > mark"""),
    "rss_undated_pass": (rss_undated_pass, f"""
        SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN ts END AS ts
        FROM events JOIN ({_MARKS}) USING (event_type) WHERE ts > mark OR event_type = 'error'"""),
    "hwm_new": (hwm_new, """
        SELECT event_type,
               CASE WHEN event_type = 'error' THEN '2024-02-01T00:00:00+00:00'
                    WHEN max(ts) = date_trunc('second', max(ts))
                    THEN strftime(max(ts), '%Y-%m-%dT%H:%M:%S')
                    ELSE strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') END AS checkpoint_value,
               count(*) AS records_extracted, max(CAST(event_id AS VARCHAR)) AS text_mark,
               CAST(max(event_id) AS VARCHAR) AS number_mark
        FROM events GROUP BY event_type
        UNION ALL
        SELECT 'refund', '2023-12-31T00:00:00', 0, '2023-12-31T00:00:00', '2023-12-31T00:00:00'"""),
    "run_current": (run_current, f"SELECT * EXCLUDE (source_type) FROM ({RUNS_SQL})"),
    "checkpoint_fold": (checkpoint_fold, CHECKPOINTS_SQL),
    "run_anomaly": (run_anomaly, f"""
        SELECT source_name, run_id, run_no, value, previous, round(m, 6) AS window_mean,
               round(s, 6) AS window_stddev,
               coalesce(s > 0 AND abs(value - m) / nullif(s, 0) > 2.37, false) AS is_anomaly
        FROM (SELECT source_name, run_id, row_number() OVER w AS run_no,
                     CAST(records_extracted AS DOUBLE) AS value,
                     lag(CAST(records_extracted AS DOUBLE)) OVER w AS previous,
                     avg(CAST(records_extracted AS DOUBLE)) OVER f AS m,
                     stddev_samp(CAST(records_extracted AS DOUBLE)) OVER f AS s
              FROM ({RUNS_SQL}) WHERE event_seq = 2
              WINDOW w AS (PARTITION BY source_name ORDER BY started_at, run_id),
                     f AS (PARTITION BY source_name ORDER BY started_at, run_id
                           ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""),
    "phase_means": (phase_time, """
        SELECT user_id AS run_id,
               round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS avg_extraction_time_ms,
               round(avg(value) FILTER (WHERE event_type = 'view'), 6)
                   AS avg_transformation_time_ms,
               round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS avg_loading_time_ms
        FROM events GROUP BY user_id"""),
    "lineage": (lineage_trace, """
        SELECT l_orderkey || '-' || l_linenumber AS id, 'csv' AS source_type,
               'lines' AS source_name, CAST(l_partkey AS VARCHAR) AS external_id,
               l_orderkey AS raw_data_id, l_suppkey AS item_run_id, o_custkey AS etl_run_id,
               o_orderpriority AS source_id, o_orderdate AS ingested_at,
               o_orderstatus AS file_path, c_mktsegment AS run_status, c_name AS run_started_at
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
             LEFT JOIN customer ON c_custkey = o_custkey"""),
    "lineage_item_run": (item_runs, """
        SELECT o_custkey AS etl_run_id, o_orderkey AS id, o_orderpriority, c_mktsegment AS status
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""),
    "reject_attempts": (reject_history, """
        SELECT 'api' AS source_type, 'events' AS source_name,
               CAST(user_id AS VARCHAR) AS raw_data_id, count(*) AS attempts,
               arg_min(CAST(event_id AS VARCHAR), ts) AS first_run_id,
               arg_max(CAST(event_id AS VARCHAR), ts) AS last_run_id, arg_max(props, ts) AS message
        FROM events WHERE event_type = 'error' GROUP BY user_id"""),
    "unprocessed": (unprocessed_rows, """
        SELECT o_orderkey AS raw_id, o_orderpriority AS source_name, o_orderdate AS ingested_at
        FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""),
    "backlog": (backlog_by_source, """
        SELECT 'csv' AS source_type, o_orderpriority AS source_name, count(*) AS pending,
               min(o_orderdate) AS oldest_ingested_at,
               date_diff('second', min(o_orderdate), TIMESTAMP '2024-02-01') AS oldest_age_seconds
        FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2"""),
}
