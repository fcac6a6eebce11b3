import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.operators.upsert import duplicate_keys
from millrace.operators.validate import reject_attempts
from millrace.plans import ingest
from millrace.plans.ingest import run_ingest
from millrace.plans.store import Store
from millrace.sources.csv import csv_records, read_csv_source
from millrace.sources.spec import KIND_MAPPINGS, SourceSpec
from millrace.streaming.ingest import ALL_THERE_IS, start_ingest

HOUR = dt.timedelta(hours=1)


def records_of(rows):
    def read(spark):
        data = [(json.dumps(r), ("mem", 0, i)) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            data, "payload string, ordinal struct<part:string,block:bigint,pos:bigint>"
        )

    return read


def event(i, name, hour, **more):
    return {"id": i, "name": name, "created_at": f"2024-01-01T{hour:02}:00:00Z", **more}


def shown(store, spark):
    rows = store.items(spark).orderBy("source_name", "external_id").collect()
    return [(r.source_name, r.external_id, r.title, r.etl_run_id) for r in rows]


def outcome(runs):
    return {
        r.source_name: (r.status, r.records_extracted, r.records_loaded, r.records_failed)
        for r in runs.collect()
    }


def test_incremental_runs(spark, tmp_path, as_of):
    store = Store(str(tmp_path))
    shop = tmp_path / "shop.csv"
    shop.write_text("id,name,price\n1,Lamp,5\n2,Mug,-1\n", encoding="utf-8")
    shop_source = SourceSpec(
        "csv", "shop", lambda s: csv_records(read_csv_source(s, str(shop))), mark_kind="id", id_order="numeric"
    )

    def sources(events):
        return [SourceSpec("api", "events", records_of(events)), shop_source]

    first = [event(1, "a", 1), event(2, "b", 2), event(1, "a2", 2)]
    runs = run_ingest(spark, store, sources(first), "run-1", as_of)
    assert outcome(runs) == {"events": ("success", 3, 3, 0), "shop": ("partial", 2, 1, 1)}
    assert shown(store, spark) == [
        ("events", "1", "a2", "run-1"), ("events", "2", "b", "run-1"), ("shop", "1", "Lamp", "run-1"),
    ]
    # The same run again changes nothing.
    assert outcome(run_ingest(spark, store, sources(first), "run-1", as_of)) == outcome(runs)
    assert len(shown(store, spark)) == 3 and store.raw(spark).count() == 5

    # Later: one event at the mark is dropped, one after it updates; the rejected row is tried again.
    second = [*first, event(2, "late", 2), event(2, "b2", 3)]
    shop.write_text("id,name,price\n1,Lamp,5\n2,Mug,-1\n10,Pen,2\n", encoding="utf-8")
    runs = run_ingest(spark, store, sources(second), "run-2", as_of + HOUR)
    assert outcome(runs) == {"events": ("success", 1, 1, 0), "shop": ("partial", 1, 1, 1)}
    assert shown(store, spark) == [
        ("events", "1", "a2", "run-1"), ("events", "2", "b2", "run-2"),
        ("shop", "1", "Lamp", "run-1"), ("shop", "10", "Pen", "run-2"),
    ]
    created = {r.external_id: r.created_at for r in store.items(spark).collect()}
    assert created["2"] == as_of.replace(tzinfo=None)

    # Nothing new.
    runs = run_ingest(spark, store, sources(second), "run-3", as_of + 2 * HOUR)
    assert outcome(runs) == {"events": ("success", 0, 0, 0), "shop": ("partial", 0, 0, 1)}
    (tried,) = reject_attempts(store.rejects(spark)).collect()
    assert (tried.attempts, tried.first_run_id, tried.last_run_id) == (3, "run-1", "run-3")
    marks = {r.source_name: r for r in store.checkpoints(spark).collect()}
    assert marks["events"].checkpoint_value == "2024-01-01T03:00:00"
    assert (marks["shop"].checkpoint_value, marks["shop"].total_records_processed) == ("10", 3)


def test_a_run_rewrites_only_the_buckets_it_touches(spark, tmp_path, as_of):
    store = Store(str(tmp_path), buckets=8)
    rows = [event(i, "a", 1) for i in range(40)]
    run_ingest(spark, store, [SourceSpec("api", "s", records_of(rows))], "run-1", as_of)
    run_ingest(
        spark, store, [SourceSpec("api", "s", records_of([event(7, "b", 2)]))], "run-2", as_of + HOUR
    )
    written = spark.read.parquet(f"{tmp_path}/items/version=run-2")
    assert written.select("bucket").distinct().count() == 1
    items = store.items(spark)
    assert items.count() == 40 and duplicate_keys(items).isEmpty()
    assert items.filter("external_id = '7'").first().title == "b"


def test_one_unreadable_source_does_not_stop_the_others(spark, tmp_path, as_of):
    def broken(spark):
        raise ConnectionError("source down")

    store = Store(str(tmp_path))
    sources = [SourceSpec("api", "down", broken), SourceSpec("api", "up", records_of([event(1, "a", 1)]))]
    runs = run_ingest(spark, store, sources, "run-1", as_of)
    assert outcome(runs) == {"down": ("failed", 0, 0, 0), "up": ("success", 1, 1, 0)}
    failed = store.checkpoints(spark).filter("source_name = 'down'").first()
    assert (failed.status, failed.checkpoint_value) == ("failed", None)
    assert failed.error_message == "ConnectionError: source down"


def test_failed_load_is_resumed_without_duplicates(spark, tmp_path, as_of, monkeypatch):
    store = Store(str(tmp_path))
    sources = [SourceSpec("api", "s", records_of([event(1, "a", 1), event(2, "b", 2)]))]

    def no_load(*_, **__):
        raise RuntimeError("load failed")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "upsert", no_load)
        with pytest.raises(RuntimeError):
            run_ingest(spark, store, sources, "run-1", as_of)
    assert shown(store, spark) == []
    failed = store.runs(spark).first()
    assert (failed.status, failed.error_message) == ("failed", "load failed")
    # The records had landed, so the mark stands and the next run loads them from the raw table.
    runs = run_ingest(spark, store, sources, "run-2", as_of + HOUR)
    assert outcome(runs) == {"s": ("success", 0, 2, 0)}
    assert [row[:3] for row in shown(store, spark)] == [("s", "1", "a"), ("s", "2", "b")]


def test_failed_run_can_be_repeated(spark, tmp_path, as_of, monkeypatch):
    store = Store(str(tmp_path))
    sources = [SourceSpec("api", "s", records_of([event(1, "a", 1)]))]

    def no_load(*_, **__):
        raise RuntimeError("load failed")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "upsert", no_load)
        with pytest.raises(RuntimeError):
            run_ingest(spark, store, sources, "run-1", as_of)
    assert outcome(run_ingest(spark, store, sources, "run-1", as_of)) == {"s": ("success", 1, 1, 0)}
    assert store.raw(spark).count() == 1 and len(shown(store, spark)) == 1


class Killed(BaseException):
    """Not caught by anything, as the end of a driver."""


class DyingStore(Store):
    """Dies after its ``left``-th write."""

    def __init__(self, root, left):
        super().__init__(root)
        object.__setattr__(self, "left", [left])

    def _written(self):
        self.left[0] -= 1
        if self.left[0] == 0:
            raise Killed

    def write_run(self, *args, **kwargs):
        path = super().write_run(*args, **kwargs)
        self._written()
        return path

    def append_ledger(self, *args):
        super().append_ledger(*args)
        self._written()


# Started, raw, landed, checked, open, items, finished.
WRITES = 7


@pytest.mark.parametrize("writes", [2, 3, 4, 5, 6, WRITES])
def test_a_run_that_dies_after_any_write_loses_nothing(spark, tmp_path, as_of, writes):
    rows = [event(1, "a", 1), {"id": "", "name": "no id"}, event(2, "b", 2)]
    sources = [SourceSpec("api", "s", records_of(rows))]

    def state(store):
        # The order of the runs may differ, the items and rows may not.
        return (
            [row[:3] for row in shown(store, spark)], store.raw(spark).count(),
            sorted({r.raw_payload for r in store.open_rows(spark, spark.createDataFrame(
                [("api", "s")], "source_type string, source_name string")).collect()}),
        )

    def dead(root):
        store = Store(root)
        if writes < WRITES:
            with pytest.raises(Killed):
                run_ingest(spark, DyingStore(root, writes), sources, "run-1", as_of)
        else:
            run_ingest(spark, store, sources, "run-1", as_of)
        return store

    store = dead(str(tmp_path / "next"))
    run_ingest(spark, store, sources, "run-2", as_of + HOUR)
    expected = ([("s", "1", "a"), ("s", "2", "b")], 3, [json.dumps(rows[1])])
    assert state(store) == expected
    # The first run's id again, after the other: nothing is lost or doubled.
    run_ingest(spark, store, sources, "run-1", as_of)
    assert state(store) == expected and duplicate_keys(store.items(spark)).isEmpty()


def test_open_rows_of_other_sources_wait_for_their_own_mapping(spark, tmp_path, as_of):
    store = Store(str(tmp_path))
    keyed = replace(KIND_MAPPINGS["api"], external_id=("key",))
    row = {"key": "", "id": "WRONG", "name": "n"}
    x = SourceSpec("api", "x", records_of([row]), mapping=keyed)
    y = SourceSpec("api", "y", records_of([event(1, "a", 1)]))
    assert outcome(run_ingest(spark, store, [x], "run-1", as_of))["x"] == ("partial", 1, 0, 1)
    assert outcome(run_ingest(spark, store, [y], "run-2", as_of + HOUR)) == {"y": ("success", 1, 1, 0)}
    assert [r[1] for r in shown(store, spark)] == ["1"]
    # Settled runs are not listed again: what is open lies with the source's last run.
    (open_row,) = store.open_rows(
        spark, spark.createDataFrame([("api", "x")], "source_type string, source_name string")
    ).select("source_name", F.col("_metadata.file_path").alias("file")).collect()
    assert "/open/run_id=run-1/" in open_row.file
    assert store.pending(spark, spark.createDataFrame(
        [("api", "x"), ("api", "y")], "source_type string, source_name string")).isEmpty()
    # Tried again with its own mapping, and refused again.
    assert outcome(run_ingest(spark, store, [x, y], "run-3", as_of + 2 * HOUR))["x"] == ("partial", 0, 0, 1)


def test_a_run_opens_only_the_folders_that_the_ledger_names(spark, tmp_path, as_of, monkeypatch):
    opened = []

    class Watched(Store):
        def _read(self, spark, table, schema, folders=None):
            opened.append((table, None if folders is None else (folders := list(folders))))
            return super()._read(spark, table, schema, folders)

    store, rows = Watched(str(tmp_path)), [{"id": "", "name": "no id"}]
    for run in range(6):
        rows.append(event(run, "a", run))
        opened.clear()
        run_ingest(spark, store, [SourceSpec("api", "s:1", records_of(rows))], f"run {run}", as_of + run * HOUR)
    # The ledger before the run, this run's landed event, and the ledger for what is returned.
    assert [folders for table, folders in opened if table == "ledger"] == [None, ["run_id=run 5/event_seq=1"], None]
    assert [folders for table, folders in opened if table == "raw"] == [["etl_run_id=run 5"]]
    assert [folders for table, folders in opened if table == "open"] == [["run_id=run 4/source_type=api/source_name=s%3A1"]]
    assert [folders for table, folders in opened if table == "items"] == [
        ["version=run 4/source_type=api/source_name=s%3A1/bucket=0"]
    ]
    raw = store.raw_of(spark, [("run 2", "api", "s:1")])
    assert raw.count() == 1 and all("etl_run_id=run" in f and "2/" in f for f in raw.inputFiles())
    assert " IN (" not in raw._jdf.queryExecution().toString() and store.raw(spark).count() == 7


def test_log_of_loads_and_refusals(spark, tmp_path, as_of):
    store = Store(str(tmp_path))
    rows = [{"id": "", "name": "no id"}, event(1, "a", 1), event(2, "b", 2)]
    run_ingest(spark, store, [SourceSpec("api", "s", records_of(rows))], "run-1", as_of)
    run_ingest(spark, store, [SourceSpec("api", "s", records_of(rows))], "run-2", as_of + HOUR)
    done = [(r.run_id, r.processed_at) for r in store.processed(spark).collect()]
    assert done == [("run-1", as_of.replace(tzinfo=None))] * 2
    refused = sorted((r.etl_run_id, r.at, r.source_name) for r in store.rejects(spark).collect())
    assert refused == [(f"run-{k + 1}", (as_of + k * HOUR).replace(tzinfo=None), "s") for k in range(2)]
    assert store.raw(spark).join(store.processed(spark), "raw_id", "left_anti").count() == 1


def test_a_source_that_fails_in_the_job_fails_alone(spark, tmp_path, as_of):
    def bad(spark):
        return records_of([event(1, "a", 1)])(spark).withColumn("payload", F.raise_error(F.lit("bad file")))

    store = Store(str(tmp_path))
    sources = [SourceSpec("api", "bad", bad), SourceSpec("api", "good", records_of([event(1, "a", 1)]))]
    for run in ("run-1", "run-2"):
        runs = outcome(run_ingest(spark, store, sources, run, as_of))
        assert runs["bad"] == ("failed", 0, 0, 0) and runs["good"][0] == "success"
    assert [r[:2] for r in shown(store, spark)] == [("good", "1")]


def test_the_mark_reaches_the_reader_and_never_goes_back(spark, tmp_path, as_of):
    store, seen = Store(str(tmp_path)), []

    def reader(rows):
        def read(spark, mark):
            seen.append(mark)
            return records_of(rows)(spark)

        return read

    first = SourceSpec("api", "s", reader([event(1, "a", 5)]))
    run_ingest(spark, store, [first], "run-1", as_of)
    run_ingest(spark, store, [first], "run-2", as_of + HOUR)
    assert seen == [None, "2024-01-01T05:00:00"]
    late = SourceSpec("api", "s", records_of([event(2, "b", 1)]))
    run_ingest(spark, store, [late], "run-3", as_of + 2 * HOUR, use_marks=False)
    assert store.checkpoints(spark).first().checkpoint_value == "2024-01-01T05:00:00"
    assert [r[1] for r in shown(store, spark)] == ["1", "2"]


def test_another_number_of_buckets_is_refused(spark, tmp_path, as_of):
    sources = [SourceSpec("api", "s", records_of([event(1, "a", 1)]))]
    run_ingest(spark, Store(str(tmp_path), buckets=4), sources, "run-1", as_of)
    with pytest.raises(ValueError):
        run_ingest(spark, Store(str(tmp_path), buckets=8), sources, "run-2", as_of)


def test_a_slice_is_one_file(spark, tmp_path, as_of):
    store = Store(str(tmp_path), buckets=8)
    rows = [event(i, "a", 1) for i in range(400)]
    run_ingest(spark, store, [SourceSpec("api", "s", records_of(rows))], "run-1", as_of, tasks=4)
    files = spark.read.parquet(f"{tmp_path}/items").inputFiles()
    assert len(files) == 8


def test_untitled_record_with_a_bad_price_loads(spark, tmp_path, as_of):
    store = Store(str(tmp_path))
    rows = [{"id": "1", "name": "ok", "price": 1}, {"id": "2", "price": "not_a_number"}]
    runs = run_ingest(spark, store, [SourceSpec("api", "s", records_of(rows))], "run-1", as_of)
    assert outcome(runs) == {"s": ("success", 2, 2, 0)}
    assert [(t, a) for _, _, t, a in shown(store, spark)] == [("ok", "run-1"), ("Untitled", "run-1")]


def test_stream_of_files_equals_one_batch(spark, tmp_path, as_of):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    schema = "payload string, ordinal struct<part:string,block:bigint,pos:bigint>"
    source = SourceSpec("api", "s")
    store = Store(str(tmp_path / "store"))

    def put(name, rows):
        lines = [
            json.dumps({"payload": json.dumps(r), "ordinal": {"part": name, "block": 0, "pos": i}})
            for i, r in enumerate(rows)
        ]
        (inbox / f"{name}.json").write_text("\n".join(lines), encoding="utf-8")

    def drain():
        records = spark.readStream.schema(schema).json(str(inbox))
        start_ingest(
            records, source, store, str(tmp_path / "position"), ALL_THERE_IS,
            clock=lambda batch: as_of + batch * HOUR,
        ).awaitTermination()

    first, second = [event(1, "a", 1), event(2, "b", 2)], [event(2, "b2", 1), event(3, "c", 3)]
    put("f1", first)
    drain()
    put("f2", second)
    drain()
    drain()  # nothing new to read
    batch_store = Store(str(tmp_path / "batch"))
    run_ingest(spark, batch_store, [SourceSpec("api", "s", records_of(first + second))], "b", as_of)
    streamed = [row[:3] for row in shown(store, spark)]
    assert streamed == [row[:3] for row in shown(batch_store, spark)]
    assert streamed == [("s", "1", "a"), ("s", "2", "b2"), ("s", "3", "c")]
    assert store.checkpoints(spark).first().total_runs == 2
    assert store.raw(spark).agg(F.count("*")).first()[0] == 4
