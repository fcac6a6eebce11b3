"""Request outcomes, circuit state, streams and whole ingest runs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import AS_OF, customer_payload, event_payload, json_of, naive, ordinal, part_payload, table
from millrace.operators.ledger import FINISHED
from millrace.operators.resilience import (
    backoff,
    circuit_state,
    classify_outcome,
    error_records,
    failure_streaks,
)
from millrace.plans.ingest import run_ingest
from millrace.plans.store import Store
from millrace.session import fresh_path, spread
from millrace.sources.spec import SourceSpec
from millrace.streaming.circuit import stream_circuit
from millrace.streaming.ingest import ALL_THERE_IS, start_ingest
from millrace.streaming.late import drop_repeats, mark_late, start_late_split

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
DAY = 86_400


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request attempts; the last digit of ``k`` chooses the response."""
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*[F.lit(c) for c in (200, 204, 401, 403, 404, 429, 500, 503, 400)])
    errors = F.array(*[F.lit(e) for e in ("timeout", "network", "bad json")])
    transport = F.when(k % 10 == 9, F.get(errors, (F.col("user_id") % 3).cast("int")))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id",
        F.get(codes, k % 10).alias("status_code"),
        transport.alias("transport_error"),
        F.when(k % 20 == 5, 30).alias("retry_after"),
        (F.col("event_id") % 3).cast("int").alias("attempt"),
    )


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify_outcome(_attempts(spark, sf_dir))
    return classified.select(
        "event_id", F.coalesce("error_class", F.lit("success")).alias("error_class"), "retryable"
    )


def retry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = backoff(classify_outcome(_attempts(spark, sf_dir)), base=1.5)
    return timed.filter(F.col("delay_seconds").isNotNull()).select(
        "event_id", "attempt", "delay_seconds", naive("next_eligible_at")
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as response bodies of requests that partly failed."""
    code = F.when(F.col("lang") == "en", 503).when(F.col("lang") == "fr", 404).otherwise(200)
    attempts = table(spark, sf_dir, "documents").select(
        "doc_id", code.alias("status_code"), F.lit(None).cast("string").alias("transport_error"),
        F.lit(AS_OF).alias("ts"), F.col("text").alias("body"),
    )
    records = error_records(classify_outcome(attempts), ["doc_id", "status_code"])
    context = F.col("context")
    return records.select(
        context["doc_id"].cast("bigint").alias("doc_id"), "error_class", "message",
        context["status_code"].alias("status_code"), naive("at"),
        F.md5(context["response_body"]).alias("body_md5"),
    )


def _user_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed")
    )


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = failure_streaks(
        _user_attempts(spark, sf_dir), ["user_id"], "ts", "event_id", "failed"
    )
    return found.select("event_id", "user_id", "streak")


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = circuit_state(
        _user_attempts(spark, sf_dir), ["user_id"], "ts", "event_id", "failed",
        threshold=2, reset_s=DAY,
    )
    return states.select("event_id", "user_id", "allowed", "failures", "circuit")


def stream_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream, kept in the state store."""
    spark.conf.set(STATE_STORE, ROCKS)
    attempts = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("attempt_id"),
        F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed"),
    )
    path = fresh_path(spark, "circuits")
    (
        stream_circuit(attempts, threshold=2, reset_s=DAY)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-position")
        .outputMode("append")
        .trigger(**ALL_THERE_IS)
        .start()
        .awaitTermination()
    )
    states = spark.read.parquet(path)
    return states.select(
        F.col("attempt_id").alias("event_id"), F.col("source").cast("bigint").alias("user_id"),
        "allowed", "failures",
        F.when(F.col("open_until_us").isNotNull(), "open").otherwise("closed").alias("circuit"),
    )


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def _event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in at least four files, one to a micro-batch, in any order."""
    events = table(spark, sf_dir, "events")
    path = fresh_path(spark, "event-files")
    events.repartitionByRange(4, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed through landing, mapping, checking and upsert; a user's last event stays."""
    payload = json_of(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("id"),
        F.col("event_type").alias("name"), F.col("value").alias("price"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
    )
    records = _event_stream(spark, sf_dir).select(
        payload.alias("payload"), ordinal(F.lit("events"), F.col("event_id")).alias("ordinal")
    )
    store = Store(fresh_path(spark, "stream-store"))
    start_ingest(
        records, SourceSpec("api", "events"), store, f"{store.root}/position", ALL_THERE_IS,
        clock=lambda batch: AS_OF + dt.timedelta(minutes=30 * batch),
    ).awaitTermination()
    return store.items(spark).select(
        "source_type", "source_name", "external_id", "title", "amount", naive("published_at")
    )


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows more than a day older than the mark go to the late table."""
    path = fresh_path(spark, "late")
    start_late_split(
        _event_stream(spark, sf_dir), "ts", lambda: "2024-01-16T00:00:00", "1 day",
        f"{path}/on-time", f"{path}/late", f"{path}/position", ALL_THERE_IS,
    ).awaitTermination()
    on_time = spark.read.parquet(f"{path}/on-time").withColumn("is_late", F.lit(False))
    late = spark.read.parquet(f"{path}/late").withColumn("is_late", F.lit(True))
    return on_time.unionByName(late).select("event_id", "ts", "is_late")


def stream_late_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five deliveries of eight days each, every fifth event in the delivery after its own; late by the stream's watermark."""
    spark.conf.set(STATE_STORE, ROCKS)
    events = table(spark, sf_dir, "events")
    delivery = F.floor((F.dayofmonth("ts") - 1) / 8) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    path = fresh_path(spark, "late-marked")
    for k in range(5):
        events.filter(F.coalesce(delivery, F.lit(0)) == k).write.mode("append").parquet(f"{path}/landing")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/landing")
        (
            mark_late(stream, "ts", "1 day")
            .writeStream.format("parquet")
            .option("path", f"{path}/marked")
            .option("checkpointLocation", f"{path}/position")
            .trigger(**ALL_THERE_IS)
            .start()
            .awaitTermination()
        )
    return spark.read.parquet(f"{path}/marked").select("event_id", naive("ts"), "is_late")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice, in the same or another micro-batch, and stays once."""
    once = _event_batches(spark, sf_dir)
    twice = once.union(_event_batches(spark, sf_dir))
    path = fresh_path(spark, "dedup")
    (
        drop_repeats(twice, "ts", ["event_id"], "40 days")
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-position")
        .trigger(**ALL_THERE_IS)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(path).select("event_id", naive("ts"), "event_type")


def _records(df: DataFrame, part: str, payload, key: str) -> DataFrame:
    return df.select(
        payload.alias("payload"), ordinal(F.lit(part), F.col(key)).alias("ordinal")
    )


def _sources(sf_dir: str, until: dt.datetime | None) -> list[SourceSpec]:
    """Parts as CSV, events as REST, customers as CSV with rejects, and a source that is not there."""

    def events(spark: SparkSession, mark: str | None) -> DataFrame:
        rows = table(spark, sf_dir, "events")
        if until is not None:
            rows = rows.filter(F.col("ts") < F.lit(until))
        if mark:
            # The mark is a literal on the table's own column, so it reaches the scan.
            rows = rows.filter(F.col("ts") > F.lit(mark).cast("timestamp_ntz"))
        return _records(rows, "events", event_payload(), "event_id")

    def parts(spark: SparkSession) -> DataFrame:
        return _records(table(spark, sf_dir, "part"), "parts", part_payload(), "p_partkey")

    def customers(spark: SparkSession) -> DataFrame:
        return _records(table(spark, sf_dir, "customer"), "customers", customer_payload(), "c_custkey")

    def absent(spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/absent.parquet")

    return [
        SourceSpec("csv", "parts", parts, mark_kind="id", id_order="numeric"),
        SourceSpec("api", "events", events),
        SourceSpec("csv", "customers", customers, mark_kind="id"),
        SourceSpec("api", "absent", absent),
    ]


def _two_runs(spark: SparkSession, sf_dir: str) -> Store:
    """A first run over half the events, a second over everything."""
    store = Store(fresh_path(spark, "store"))
    tasks = spark.sparkContext.defaultParallelism
    run_ingest(spark, store, _sources(sf_dir, dt.datetime(2024, 1, 16)), "run-1", AS_OF, tasks=tasks)
    run_ingest(spark, store, _sources(sf_dir, None), "run-2", AS_OF + dt.timedelta(hours=1), tasks=tasks)
    return store


class _Lost(BaseException):
    """Ends a run as a killed driver does: nothing catches it."""


@dataclass(frozen=True)
class _DiesBeforeFinish(Store):
    """A store whose driver is lost when the run is about to write its finish row."""

    def append_ledger(self, rows: DataFrame, run_id: str, event: int) -> None:
        if event == FINISHED:
            raise _Lost
        super().append_ledger(rows, run_id, event)


def ingest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run lost before its finish row, another run in its place, and then the first one repeated."""
    store = Store(fresh_path(spark, "store"))
    sources = _sources(sf_dir, dt.datetime(2024, 1, 16))
    try:
        run_ingest(spark, _DiesBeforeFinish(store.root), sources, "run-1", AS_OF)
    except _Lost:
        pass
    run_ingest(spark, store, _sources(sf_dir, None), "run-2", AS_OF + dt.timedelta(hours=1))
    run_ingest(spark, store, sources, "run-1", AS_OF + dt.timedelta(hours=2))
    rows = store.items(spark).groupBy("source_type", "source_name", "etl_run_id").agg(
        F.count("*").alias("items"), F.countDistinct("external_id").alias("ids")
    )
    raw = store.raw(spark).groupBy("source_type", "source_name").agg(F.count("*").alias("raw_rows"))
    return rows.join(raw, ["source_type", "source_name"])


def ingest_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that fails on an executor fails alone."""

    def fails(spark: SparkSession) -> DataFrame:
        rows = _records(table(spark, sf_dir, "nation"), "nations", F.to_json(F.struct("*")), "n_nationkey")
        return rows.withColumn("payload", F.raise_error(F.concat(F.lit("no payload for "), "payload")))

    def parts(spark: SparkSession) -> DataFrame:
        return _records(table(spark, sf_dir, "part"), "parts", part_payload(), "p_partkey")

    store = Store(fresh_path(spark, "store"))
    sources = [SourceSpec("api", "nations", fails), SourceSpec("csv", "parts", parts, mark_kind="id")]
    run_ingest(spark, store, sources, "run-1", AS_OF)
    return store.runs(spark).select(
        "source_type", "source_name", "status", "records_extracted", "records_loaded", "records_failed",
        F.contains("error_message", F.lit("no payload for")).alias("told_why"),
    )


def ingest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_runs(spark, sf_dir).items(spark).select(
        "source_type", "source_name", "external_id", "title", "amount",
        F.col("quantity").cast("bigint").alias("quantity"),
        F.array_join("tags", "|").alias("tags"), "etl_run_id", naive("created_at"),
    )


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_runs(spark, sf_dir).runs(spark).select(
        "run_id", "source_type", "source_name", "status", "records_extracted", "records_loaded",
        "records_failed", F.coalesce("checkpoint_after", F.lit("-")).alias("checkpoint_after"),
        F.col("error_message").isNotNull().alias("has_error"),
    )


def _event_store(spark: SparkSession, sf_dir: str) -> str:
    """The service's own events, in the order of their ids and in row groups of a few thousand pages."""
    path = fresh_path(spark, "service")
    events = table(spark, sf_dir, "events").select("event_id", "event_type").filter(F.col("event_id").isNotNull())
    events.sort("event_id").write.option("parquet.block.size", 4 << 20).parquet(path)
    return path


def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read page by page through the paged source, a hundred to a page, until a page is not full."""
    from millrace.sources.pages import unwrap_pages
    from millrace.sources.paged import PagedSource

    spark.dataSource.register(PagedSource)
    spark.sparkContext.addPyFile(__file__.replace("flow.py", "transport.py"))
    pages = (
        spark.read.format("paged")
        .options(
            transport="transport:event_page", path=_event_store(spark, sf_dir),
            first_page=1, fetch="events",
        )
        .load()
    )
    # One task asks for all pages of a fetch; they are parsed by all.
    landed = spread(pages, spark.sparkContext.defaultParallelism, "page")
    records = unwrap_pages(landed, ["fetch"], stopped=True).select(
        "page", "pos", F.from_json("payload", "id bigint, type string").alias("record")
    )
    return records.select("page", "pos", F.col("record.id").alias("event_id"), F.col("record.type").alias("event_type"))


_ATTEMPTS = """
    SELECT event_id, ts, user_id, event_id % 3 AS attempt,
           CAST(json_extract_string(props, '$.k') AS INT) AS k,
           CASE k % 10 WHEN 2 THEN 'auth' WHEN 3 THEN 'auth' WHEN 4 THEN 'not_found'
                WHEN 5 THEN 'rate_limit' WHEN 6 THEN 'server' WHEN 7 THEN 'server'
                WHEN 8 THEN 'client_error'
                WHEN 9 THEN CASE user_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network'
                                             ELSE 'unexpected' END
                ELSE 'success' END AS error_class,
           k % 10 IN (5, 6, 7, 9) AS retryable
    FROM events
"""
_DELAYS = f"""
    SELECT *, CASE WHEN k % 20 = 5 THEN 30.0 ELSE 1.5 * pow(2, attempt) END AS delay_seconds
    FROM ({_ATTEMPTS}) WHERE retryable AND attempt < 2
"""
_CIRCUIT = """
    WITH RECURSIVE numbered AS (
        SELECT user_id, event_id, ts, event_type = 'error' AS failed,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
        FROM events),
    step AS (
        SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id,
               CAST(0 AS BIGINT) AS failures, CAST(NULL AS TIMESTAMP) AS open_until,
               true AS allowed
        FROM numbered WHERE n = 1
        UNION ALL
        SELECT x.user_id, x.n, x.event_id,
               CASE WHEN x.ts < s.open_until THEN s.failures WHEN NOT x.failed THEN 0
                    WHEN s.open_until IS NOT NULL THEN 1 ELSE s.failures + 1 END,
               CASE WHEN x.ts < s.open_until THEN s.open_until
                    WHEN x.failed AND s.open_until IS NULL AND s.failures + 1 >= 2
                    THEN x.ts + INTERVAL 1 DAY END,
               NOT coalesce(x.ts < s.open_until, false)
        FROM step s JOIN numbered x ON x.user_id = s.user_id AND x.n = s.n + 1)
    SELECT event_id, user_id, allowed, failures,
           CASE WHEN open_until IS NOT NULL THEN 'open' ELSE 'closed' END AS circuit
    FROM step WHERE n > 0
"""
_ISO_MAX = """CASE WHEN max(ts) = date_trunc('second', max(ts))
    THEN strftime(max(ts), '%Y-%m-%dT%H:%M:%S') ELSE strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') END"""

QUERIES = {
    "outcome_class": (outcome, f"SELECT event_id, error_class, retryable FROM ({_ATTEMPTS})"),
    "backoff": (retry_times, f"""
        SELECT event_id, CAST(attempt AS INT) AS attempt, CAST(delay_seconds AS DOUBLE)
                   AS delay_seconds,
               ts + to_microseconds(CAST(delay_seconds * 1000000 AS BIGINT)) AS next_eligible_at
        FROM ({_DELAYS})"""),
    "error_records": (error_log, """
        SELECT doc_id, CASE lang WHEN 'en' THEN 'server' ELSE 'not_found' END AS error_class,
               'request failed: ' || CASE lang WHEN 'en' THEN 'server' ELSE 'not_found' END
                   AS message,
               CASE lang WHEN 'en' THEN '503' ELSE '404' END AS status_code,
               TIMESTAMP '2024-02-01' AS at, md5(left(text, 500)) AS body_md5
        FROM documents WHERE lang IN ('en', 'fr')"""),
    "failure_streak": (streaks, """
        SELECT event_id, user_id,
               CASE WHEN event_type = 'error' THEN row_number() OVER (
                    PARTITION BY user_id, island, event_type = 'error' ORDER BY ts, event_id)
                    ELSE 0 END AS streak
        FROM (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (
                  PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)"""),
    "circuit_state": (circuits, _CIRCUIT),
    "stream_circuit": (stream_circuits, _CIRCUIT),
    "stream_upsert": (stream_upsert, """
        SELECT 'api' AS source_type, 'events' AS source_name,
               event_type || '-' || user_id AS external_id, event_type AS title,
               arg_max(value, event_id) AS amount, arg_max(ts, event_id) AS published_at
        FROM events GROUP BY event_type, user_id"""),
    "stream_late": (stream_late, """
        SELECT event_id, ts, ts <= TIMESTAMP '2024-01-15' AS is_late FROM events"""),
    "stream_late_watermark": (stream_late_watermark, """
        WITH landed AS (
            SELECT event_id, ts, coalesce((day(ts) - 1) // 8 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END, 0) AS delivery
            FROM events),
        marks AS (
            SELECT delivery, max(max(ts)) OVER (
                ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
            FROM landed GROUP BY delivery)
        SELECT event_id, ts,
               coalesce(ts <= date_trunc('milliseconds', latest) - INTERVAL 1 DAY, false) AS is_late
        FROM landed JOIN marks USING (delivery)"""),
    "stream_dedup": (stream_dedup, "SELECT event_id, ts, event_type FROM events"),
    "ingest_items": (ingest_items, """
        SELECT 'csv' AS source_type, 'parts' AS source_name,
               CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, p_retailprice AS amount,
               CAST(p_size AS BIGINT) AS quantity, p_brand || '|' || p_type AS tags,
               'run-1' AS etl_run_id, TIMESTAMP '2024-02-01' AS created_at
        FROM part
        UNION ALL
        SELECT 'api', 'events', CAST(event_id AS VARCHAR), event_type, value, user_id,
               event_type || '|u' || user_id,
               CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'run-1' ELSE 'run-2' END,
               TIMESTAMP '2024-02-01' + CASE WHEN ts < TIMESTAMP '2024-01-16'
                   THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END
        FROM events
        UNION ALL
        SELECT 'csv', 'customers', CAST(c_custkey AS VARCHAR), c_name, c_acctbal, NULL, '',
               'run-1', TIMESTAMP '2024-02-01'
        FROM customer WHERE c_acctbal >= 0"""),
    "ingest_runs": (ingest_runs, f"""
        WITH bad AS (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS n FROM customer)
        SELECT 'run-1' AS run_id, 'csv' AS source_type, 'parts' AS source_name,
               'success' AS status, count(*) AS records_extracted, count(*) AS records_loaded,
               CAST(0 AS BIGINT) AS records_failed,
               CAST(max(p_partkey) AS VARCHAR) AS checkpoint_after, false AS has_error FROM part
        UNION ALL SELECT 'run-2', 'csv', 'parts', 'success', 0, 0, 0,
               CAST(max(p_partkey) AS VARCHAR), false FROM part
        UNION ALL SELECT 'run-1', 'api', 'events', 'success', count(*), count(*), 0, {_ISO_MAX},
               false FROM events WHERE ts < TIMESTAMP '2024-01-16'
        UNION ALL SELECT 'run-2', 'api', 'events', 'success',
               count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'),
               count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), 0, {_ISO_MAX}, false
        FROM events
        UNION ALL SELECT 'run-1', 'csv', 'customers', 'partial', count(*), count(*) - n, n,
               max(CAST(c_custkey AS VARCHAR)), true FROM customer, bad GROUP BY n
        UNION ALL SELECT 'run-2', 'csv', 'customers', 'partial', 0, 0, n,
               (SELECT max(CAST(c_custkey AS VARCHAR)) FROM customer), true FROM bad
        UNION ALL SELECT 'run-' || i, 'api', 'absent', 'failed', 0, 0, 0, '-', true
        FROM range(1, 3) t(i)"""),
    "ingest_resume": (ingest_resume, """
        SELECT 'csv' AS source_type, 'parts' AS source_name, 'run-2' AS etl_run_id, count(*) AS items,
               count(*) AS ids, count(*) AS raw_rows FROM part
        UNION ALL SELECT 'api', 'events', 'run-2', count(*), count(*), count(*) FROM events
        UNION ALL SELECT 'csv', 'customers', 'run-2', count(*) FILTER (WHERE c_acctbal >= 0),
               count(*) FILTER (WHERE c_acctbal >= 0), count(*) FROM customer"""),
    "ingest_isolated": (ingest_isolated, """
        SELECT 'api' AS source_type, 'nations' AS source_name, 'failed' AS status,
               CAST(0 AS BIGINT) AS records_extracted, CAST(0 AS BIGINT) AS records_loaded,
               CAST(0 AS BIGINT) AS records_failed, true AS told_why
        UNION ALL SELECT 'csv', 'parts', 'success', count(*), count(*), 0, NULL FROM part"""),
    "paged_source": (paged_source, """
        SELECT event_id // 100 + 1 AS page, event_id % 100 AS pos, event_id, event_type
        FROM events"""),
}
