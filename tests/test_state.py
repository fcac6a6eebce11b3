import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.incremental import after_mark, incremental, next_marks
from millrace.operators.landing import backlog, dedup_content, unprocessed
from millrace.operators.ledger import current_runs, fold_checkpoints, run_anomalies
from millrace.operators.lookup import join_lookup
from millrace.operators.slots import number_rows
from millrace.operators.upsert import duplicate_keys, mark_deleted, upsert
from millrace.schemas import LEDGER
from millrace.streaming.late import mark_late

UTC = dt.timezone.utc
ARGS = {"keys": ["k"], "mutable": ["v"], "immutable": ["born"], "seq": ["s"]}


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, born int, s int")


def as_dict(df):
    return {r.k: (r.v, r.born) for r in df.collect()}


def test_upsert_last_row_wins_and_first_values_stay(spark):
    target = upsert(rows_of(spark, []), rows_of(spark, [("a", "1", 1, 1), ("b", "1", 1, 1)]), **ARGS)
    updates = rows_of(spark, [("a", "2", 2, 2), ("a", None, 3, 3), ("c", "x", 5, 5), ("c", "y", 4, 6)])
    got = upsert(target, updates, **ARGS)
    assert as_dict(got) == {"a": (None, 1), "b": ("1", 1), "c": ("y", 5)}
    assert as_dict(upsert(got, updates, **ARGS)) == as_dict(got)
    assert duplicate_keys(got, ["k"]).isEmpty()


def test_upsert_hot_key_collapses_before_the_shuffle(spark):
    hot = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").cast("string").alias("v"), F.col("id").cast("int").alias("born"),
        F.col("id").cast("int").alias("s"),
    )
    got = as_dict(upsert(rows_of(spark, []), hot, **ARGS).filter("k = 'hot'"))
    assert got == {"hot": ("49998", 0)}


def test_upsert_against_a_bucketed_target_does_not_shuffle_it(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS bucketed_target")
    rows_of(spark, [(str(i), "1", 1, 1) for i in range(100)]).write.option(
        "path", str(tmp_path / "t")
    ).bucketBy(4, "k").sortBy("k").saveAsTable("bucketed_target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert(spark.table("bucketed_target"), rows_of(spark, [("7", "2", 2, 2)]), **ARGS)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1
        assert as_dict(plan)["7"] == ("2", 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_target")


def test_mark_deleted_only_touches_missing_live_rows(spark, as_of):
    before = dt.datetime(2023, 1, 1)
    target = spark.createDataFrame(
        [("a", "active", None), ("b", "active", None), ("c", "deleted", before)],
        "k string, status string, deleted_at timestamp",
    )
    snapshot = spark.createDataFrame([("a",), ("a",)], "k string")
    got = {r.k: (r.status, r.deleted_at) for r in mark_deleted(target, snapshot, ["k"], as_of).collect()}
    assert got == {
        "a": ("active", None), "b": ("deleted", as_of.replace(tzinfo=None)), "c": ("deleted", before),
    }


def test_dedup_keeps_the_first_copy_per_source(spark):
    rows = spark.createDataFrame(
        [("s", 2, "x"), ("s", 1, "x"), ("t", 3, "x"), ("s", 4, "y")], "src string, i int, p string"
    )
    got = dedup_content(rows, ["src"], "p", ["i"])
    assert sorted((r.src, r.i, r.copies) for r in got.collect()) == [("s", 1, 2), ("s", 4, 1), ("t", 3, 1)]


@pytest.mark.parametrize(
    ("mark", "kind", "order", "keep_null", "kept"),
    [
        ("2024-01-02T00:00:00", "timestamp", "string", False, [3]),
        ("2024-01-02T00:00:00Z", "timestamp", "string", True, [3, None]),
        ("garbage", "timestamp", "string", True, [1, 2, 3, None]),
        ("", "timestamp", "string", False, [1, 2, 3, None]),
        (None, "timestamp", "string", False, [1, 2, 3, None]),
    ],
)
def test_time_marks(spark, mark, kind, order, keep_null, kept):
    days = [1, 2, 3, None]
    rows = spark.createDataFrame(
        [("s", d and dt.datetime(2024, 1, d, tzinfo=UTC)) for d in days], "src string, at timestamp"
    )
    marks = spark.createDataFrame([("s", mark)], "src string, checkpoint_value string")
    for bound in (64, 0):
        got = incremental(rows, marks, ["src"], "at", kind, order, keep_null, max_literal_marks=bound)
        found = [r.at and r.at.day for r in got.collect()]
        assert sorted(found, key=lambda d: d or 99) == kept


@pytest.mark.parametrize(
    ("order", "kind", "kept"),
    [("string", "id", ["91"]), ("numeric", "id", ["10", "91"]), ("string", "page", ["10", "91"])],
)
def test_id_marks_compare_as_text_or_number(spark, order, kind, kept):
    rows = spark.createDataFrame([("s", v) for v in ("8", "9", "10", "91")], "src string, id string")
    marks = spark.createDataFrame([("s", "9")], "src string, checkpoint_value string")
    for bound in (64, 0):
        got = incremental(rows, marks, ["src"], "id", kind, order, max_literal_marks=bound)
        assert sorted(r.id for r in got.collect()) == kept
    single = rows.filter(after_mark(F.col("id"), F.lit("9"), kind, order))
    assert sorted(r.id for r in single.collect()) == kept


def test_literal_marks_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    marks = spark.createDataFrame(
        [("click", "2024-01-20T00:00:00")], "event_type string, checkpoint_value string"
    )
    plan = incremental(events, marks, ["event_type"], "ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "Join" not in plan


def test_next_marks(spark, as_of):
    rows = spark.createDataFrame(
        [("a", "9", dt.datetime(2024, 1, 1, tzinfo=UTC)), ("a", "10", None), ("b", "1", None)],
        "src string, id string, at timestamp",
    )
    old = spark.createDataFrame([("a", "x"), ("c", "kept")], "src string, checkpoint_value string")

    def marks(column, kind, order="string"):
        got = next_marks(rows, old, ["src"], column, kind, as_of, order)
        return {r.src: (r.checkpoint_value, r.records_extracted) for r in got.collect()}

    now = as_of.isoformat()
    assert marks("at", "timestamp") == {"a": ("2024-01-01T00:00:00", 2), "b": (now, 1), "c": ("kept", 0)}
    assert marks("id", "id")["a"] == ("9", 2)
    assert marks("id", "id", "numeric")["a"] == ("10", 2)


def test_backlog_and_retry_of_rejected_rows(spark, as_of):
    raw = spark.createDataFrame(
        [("1", "api", "s", dt.datetime(2024, 1, 31, tzinfo=UTC)), ("2", "api", "s", as_of)],
        "raw_id string, source_type string, source_name string, ingested_at timestamp",
    )
    done = spark.createDataFrame([("2",), ("2",)], "raw_id string")
    assert [r.raw_id for r in unprocessed(raw, done).collect()] == ["1"]
    row = backlog(raw, done, as_of).first()
    assert (row.pending, row.oldest_age_seconds) == (1, 86_400)


def test_lookup_join_treats_null_keys_as_equal(spark):
    facts = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("no", 4)], "k string, id int")
    lookup = spark.createDataFrame([("hot", 1), (None, 2), ("absent", 3)], "k string, v int")
    found = {how: sorted(r.id for r in join_lookup(facts, lookup, ["k"], how).collect())
             for how in ("left", "inner", "left_semi", "left_anti")}
    assert found == {"left": [1, 2, 3, 4], "inner": [1, 2, 3], "left_semi": [1, 2, 3], "left_anti": [4]}
    values = {r.id: r.v for r in join_lookup(facts, lookup, ["k"]).collect()}
    assert values == {1: 1, 2: 1, 3: 2, 4: None}


def test_the_ways_of_comparing_marks_agree(spark):
    rows = spark.createDataFrame(
        [(None, "5", 1), (None, "x", 2), (None, None, 3), ("s", "7", 4), ("s", None, 5), ("t", "1", 6)],
        "src string, id string, n int",
    )
    marks = spark.createDataFrame([(None, "6"), ("s", "6")], "src string, checkpoint_value string")
    for keep_null, kept in ((False, [4, 6]), (True, [3, 4, 5, 6])):
        for bound in (64, 0):
            got = incremental(rows, marks, ["src"], "id", "id", "numeric", keep_null, max_literal_marks=bound)
            assert sorted(r.n for r in got.collect()) == kept
        single = rows.filter(after_mark(F.col("id"), F.lit("6"), "id", "numeric", keep_null))
        assert sorted(r.n for r in single.collect()) == [n for n in kept if n != 6]


def ledger_of(spark, rows):
    """(run, seq, source, status, started hour, completed hour, extracted, mark, error)."""

    def at(hour):
        return None if hour is None else dt.datetime(2024, 1, 1, hour, tzinfo=UTC)

    full = [
        (run, seq, "api", src, status, at(start), at(end), n, n, 0, "timestamp", None, mark, error)
        for run, seq, src, status, start, end, n, mark, error in rows
    ]
    return spark.createDataFrame(full, LEDGER)


def test_checkpoints_follow_landing_and_finish(spark):
    ledger = ledger_of(spark, [
        ("r1", 0, "s", "running", 1, None, None, None, None),
        ("r1", 1, "s", "running", 1, None, 5, "m1", None),
        ("r1", 2, "s", "success", 1, 2, 5, "m1", None),
        ("r1", 2, "s", "success", 1, 2, 5, "m1", None),
        ("r2", 0, "s", "running", 3, None, None, None, None),
        ("r2", 2, "s", "failed", 3, 4, 0, None, "down"),
        ("r3", 1, "s", "running", 5, None, 7, "m3", None),
        ("r4", 0, "t", "running", 6, None, None, None, None),
    ])
    runs = {r.run_id: r for r in current_runs(ledger).collect()}
    assert (runs["r1"].status, runs["r1"].duration_seconds) == ("success", 3600.0)
    assert (runs["r3"].status, runs["r3"].duration_seconds) == ("running", None)
    marks = {r.source_name: r for r in fold_checkpoints(ledger).collect()}
    s = marks["s"]
    assert s.checkpoint_value == "m3"  # landed, so it is not landed again
    assert (s.status, s.error_message, s.total_runs) == ("failed", "down", 2)
    assert (s.total_records_processed, s.last_records_processed) == (5, 0)
    assert (s.last_success_at.hour, s.last_failure_at.hour, s.last_run_at.hour) == (2, 4, 4)
    assert (marks["t"].status, marks["t"].total_runs, marks["t"].checkpoint_value) == ("pending", 0, None)


def test_numbering_by_slots_equals_a_window_per_key(spark):
    draw = random.Random(3)
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [
        (draw.choice(["hot", "hot", "a"]), start + dt.timedelta(seconds=draw.randint(0, 500)), i)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    got = {r.i: r.n for r in number_rows(df, ["k"], ["at", "i"], "n", 7).collect()}
    seen = {}
    for k, _, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]


def test_anomalies_do_not_depend_on_block_size(spark):
    draw = random.Random(5)
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [
        ("api", draw.choice("xxy"), f"r{i:03}", start + dt.timedelta(hours=draw.randint(0, 900)),
         draw.randint(0, 9))
        for i in range(120)
    ]
    runs = spark.createDataFrame(
        rows, "source_type string, source_name string, run_id string, started_at timestamp, records_extracted int"
    )

    def found(**size):
        got = run_anomalies(runs, 4, 2.0, **size)
        return {r.run_id: (r.run_no, r.previous, r.window_mean, r.window_stddev) for r in got.collect()}

    small, large = found(block_rows=4, slots=9), found()
    assert len(small) == 120 and small == large
    history = {}
    for _, name, run, _, value in sorted(rows, key=lambda r: (r[1], r[3], r[2])):
        before = history.setdefault(name, [])
        number, previous, mean, _ = small[run]
        assert number == len(before) + 1
        assert previous == (before[-1] if before else None)
        assert mean == (sum(before[-4:]) / len(before[-4:]) if before else None)
        before.append(value)


def test_late_rows_are_marked_by_the_watermark_and_none_is_lost(spark, tmp_path):
    schema = "id long, ts timestamp, _late_note string"
    deliveries = [
        [(1, "2024-01-10 00:00:00", "x"), (2, "2024-01-01 00:00:00", "x"), (3, None, None)],
        [(4, "2024-01-09 00:00:00", "x"), (5, "2024-01-09 00:00:00.000001", "x"), (6, None, "x"), (2, "2024-01-01 00:00:00", "x")],
        [],
        [(7, "2024-01-20 00:00:00", "x"), (8, "2024-01-09 12:00:00", "x")],
        [(9, "2024-01-18 23:59:59", "x"), (9, "2024-01-18 23:59:59", "x"), (10, "2024-01-19 00:00:01", "x")],
    ]
    for rows in deliveries:
        frame = spark.createDataFrame([(i, at and dt.datetime.fromisoformat(at), note) for i, at, note in rows], schema)
        frame.repartition(2).write.mode("append").parquet(f"{tmp_path}/landing")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/landing")
        (
            mark_late(stream, "ts", "1 day", slots=3)
            .writeStream.format("parquet")
            .option("path", f"{tmp_path}/marked")
            .option("checkpointLocation", f"{tmp_path}/position")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    got = spark.read.parquet(f"{tmp_path}/marked")
    assert got.columns == ["id", "ts", "_late_note", "is_late"]
    late = {2: [False, True], 4: [True], 9: [True, True]}
    marked = {i: late.get(i, [False]) for i in range(1, 11)}
    assert {i: sorted(r["is_late"] for r in got.filter(F.col("id") == i).collect()) for i in marked} == marked
