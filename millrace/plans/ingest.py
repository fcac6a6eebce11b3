"""One ingest run: land what is new, map and check the backlog, upsert, and close the run.

A run reads the ledger once and then only the folders it names. Counts and marks are observed while rows are
written, so no table is read again for them. It writes at most seven times: started, raw, landed, checked, open (only
if rows were refused), items (only if rows were accepted) and finished.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.parse import parse_ts
from millrace.operators.incremental import after_mark, iso_text
from millrace.operators.landing import land
from millrace.operators.ledger import FINISHED, LANDED, SOURCE, STARTED, ledger_events
from millrace.operators.normalize import normalize
from millrace.operators.upsert import upsert
from millrace.operators.validate import accepted, keep_where, validate
from millrace.plans.store import SLICE, UNKNOWN, SourceState, Store
from millrace.schemas import RAW
from millrace.session import local_rows
from millrace.sources.spec import SourceSpec


def _by_source(specs: Sequence[SourceSpec], build) -> Column:
    """CASE over the sources."""
    chosen = F
    for spec in specs:
        same = (F.col("source_type") == spec.kind) & (F.col("source_name") == spec.name)
        chosen = chosen.when(same, build(spec))
    return chosen


def new_rows(landed: DataFrame, spec: SourceSpec, mark: str | None) -> DataFrame:
    """Landed rows of a source that are newer than its mark."""
    value = F.col("event_time") if spec.mark_kind == "timestamp" else F.col("source_id")
    if not mark:
        return landed
    return keep_where(
        landed, after_mark(value, F.lit(mark), spec.mark_kind, spec.id_order, spec.keep_undated)
    )


#: What is observed of a source while it lands, and what that is of one that failed.
_LANDED = "records_extracted bigint, _micros bigint, _text string, _number string"
_NOTHING = {"records_extracted": 0, "_micros": None, "_text": None, "_number": None}
#: What a run knows of a source when it starts, and when its rows have landed.
_OPENED = ", checkpoint_type string, checkpoint_before string"
_CARRIED = (*SOURCE, "checkpoint_type", "checkpoint_before", "records_extracted", "checkpoint_after", "error_message")
_LANDED_ROW = f"{_OPENED}, records_extracted bigint, checkpoint_after string, error_message string"
#: What a load leaves in a source's finish row besides the counts.
PUBLISHED = ("seq", "versions", "open_run", "taken")


def _observed(rows: DataFrame, seen: Observation) -> DataFrame:
    return rows.observe(
        seen,
        F.count(F.lit(1)).alias("records_extracted"),
        F.unix_micros(F.max("event_time")).alias("_micros"),
        F.max("source_id").alias("_text"),
        F.max(F.col("source_id").try_cast("decimal(38,0)")).cast("string").alias("_number"),
    )


def _with_marks(seen: DataFrame, specs: Sequence[SourceSpec], as_of: dt.datetime) -> DataFrame:
    """``checkpoint_after`` of the sources, from what was observed of them; a mark never goes back."""
    now, before = F.lit(as_of.isoformat()), F.col("checkpoint_before")
    reached = F.coalesce(F.timestamp_micros("_micros"), F.lit(as_of).cast("timestamp"))
    in_time = iso_text(F.greatest(reached, parse_ts(before).cast("timestamp")))

    def mark(spec: SourceSpec) -> Column:
        if spec.mark_kind == "timestamp":
            return in_time
        if spec.mark_kind != "id" or spec.id_order == "numeric":
            number = F.greatest(F.col("_number").cast("decimal(38,0)"), before.try_cast("decimal(38,0)"))
            return F.coalesce(number.cast("string"), now)
        return F.coalesce(F.greatest(F.col("_text"), F.nullif(before, F.lit(""))), now)

    after = F.when(F.col("records_extracted") > 0, _by_source(specs, mark))
    return seen.withColumn("checkpoint_after", F.coalesce(after, before))


def _source_rows(spark: SparkSession, rows: Sequence[tuple], more: str = "") -> DataFrame:
    return local_rows(spark, rows, f"source_type string, source_name string{more}")


_LOADED = ", records_loaded bigint, records_failed bigint, seq bigint, versions map<int,string>, open_run string, taken array<string>"


def load_backlog(
    spark: SparkSession,
    store: Store,
    run_id: str,
    as_of: dt.datetime,
    specs: Sequence[SourceSpec],
    states: dict[tuple[str, str], SourceState],
    tasks: int | None = None,
) -> DataFrame:
    """Map, check and upsert what these sources have open; returns what to put into their finish rows.

    Open are the rows that their last load could not accept, and rows that runs have landed but not
    loaded. The validated rows are written once; everything published reads that copy.
    """
    overrides = {(s.kind, s.name): s.mapping for s in specs if s.mapping}
    before = {(s.kind, s.name): states.get((s.kind, s.name), UNKNOWN) for s in specs}
    landed = store.raw_of(spark, [(run, *source) for source, state in before.items() for run in state.pending])
    earlier = store.open_of(spark, [(*source, state.open_run) for source, state in before.items() if state.open_run])
    open_rows = landed.unionByName(earlier)
    spread_rows = open_rows.repartition(tasks, "raw_id") if tasks else open_rows
    checked = store.with_bucket(validate(normalize(spread_rows, overrides=overrides)))
    refused = F.size("errors") > 0
    checked = checked.withColumns({"refused": refused, "checked_at": F.lit(as_of).cast("timestamp")})
    seen = Observation()
    watched = []
    for k, (kind, name) in enumerate(before):
        same = (F.col("source_type") == kind) & (F.col("source_name") == name)
        ok = same & ~F.col("refused")
        buckets = F.sort_array(F.collect_set(F.when(ok, F.col("bucket"))))
        watched += [
            F.count_if(ok).alias(f"loaded{k}"),
            F.count_if(same & F.col("refused")).alias(f"failed{k}"),
            F.array_join(buckets.cast("array<string>"), ",").alias(f"buckets{k}"),
        ]
    if watched:
        checked = checked.observe(seen, *watched)
    path = store.write_run(checked.drop("bucket"), "checked", run_id)
    counts = seen.get if watched else {}
    staged = spark.read.schema(checked.drop("bucket").schema).parquet(path)

    seq = max((state.seq for state in states.values()), default=0) + 1
    outcome, touched = [], []
    for k, (source, state) in enumerate(before.items()):
        buckets = [int(b) for b in counts[f"buckets{k}"].split(",") if b]
        touched += [(*source, b, state.versions[b]) for b in buckets if b in state.versions]
        versions = {**state.versions, **dict.fromkeys(buckets, run_id)}
        failed = counts[f"failed{k}"]
        outcome.append((*source, counts[f"loaded{k}"], failed, seq, versions, run_id if failed else None, list(state.pending)))
    if any(failed for _, _, _, failed, *_ in outcome):
        left = staged.filter("refused").select(F.col("raw_data_id").alias("raw_id"))
        store.write_run(open_rows.join(left, "raw_id", "left_semi"), "open", run_id, partition_by=SOURCE)
    if any(loaded for _, _, loaded, *_ in outcome):
        updates = accepted(staged).withColumns(
            {"etl_run_id": F.lit(run_id), "updated_at": F.lit(as_of).cast("timestamp")}
        )
        upserted = store.with_bucket(upsert(store.slices(spark, touched), updates))
        # One file per slice, more where a slice is large.
        store.write_run(upserted.hint("rebalance", *map(F.col, SLICE)), "items", run_id, partition_by=SLICE)
    return _source_rows(spark, outcome, _LOADED)


def _land(
    spark: SparkSession, store: Store, specs: Sequence[SourceSpec], run_id: str, as_of: dt.datetime, marks: dict
) -> tuple[dict, dict]:
    """Land what is new in the sources; returns what was observed of each, and the errors of those that failed.

    All sources land in one job. If that fails, they land one by one, so that a source which fails
    on an executor fails alone.
    """
    landed, seen, failed = [], {}, {}

    def fails(spec: SourceSpec, error: Exception) -> None:
        failed[spec.kind, spec.name] = f"{type(error).__name__}: {error}"

    for spec in specs:
        mark = marks.get((spec.kind, spec.name))
        try:
            rows = land(spec.read(spark, mark), spec, run_id, as_of)
            landed.append((spec, new_rows(rows, spec, mark)))
        except Exception as error:
            fails(spec, error)
    watches = [Observation() for _ in landed]
    together = reduce(
        DataFrame.unionByName,
        [_observed(rows, watch) for (_, rows), watch in zip(landed, watches, strict=True)],
        local_rows(spark, [], RAW),
    )
    try:
        store.write_run(together, "raw", run_id, partition_by=["source_type"])
        seen = {(spec.kind, spec.name): watch.get for (spec, _), watch in zip(landed, watches, strict=True)}
    except Exception:
        store.write_run(local_rows(spark, [], RAW), "raw", run_id, partition_by=["source_type"])
        for spec, rows in landed:
            watch = Observation()
            try:
                store.write_run(_observed(rows, watch), "raw", run_id, partition_by=["source_type"], mode="append")
                seen[spec.kind, spec.name] = watch.get
            except Exception as error:
                fails(spec, error)
    return seen, failed


def run_ingest(
    spark: SparkSession,
    store: Store,
    specs: Sequence[SourceSpec],
    run_id: str,
    as_of: dt.datetime,
    use_marks: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Ingest all sources in one run and return the run's final ledger rows.

    A source that cannot be read fails alone, while its plan is built or while it lands. A failure
    while loading fails the run and is raised; what had landed by then is retried by the next run.
    ``use_marks=False`` takes all records of the sources as new. ``tasks`` spreads the open rows over
    so many tasks before they are mapped, for input that comes in few splits.

    Repeating a run that did not complete goes on at the load if it had landed; repeating a completed
    one changes nothing.
    """
    store.check_layout(spark)
    states = store.states(spark, run_id)
    if any(state.done for state in states.values()):
        return store.runs(spark).filter(F.col("run_id") == run_id)
    sources = [(s.kind, s.name) for s in specs]
    carried = {c: F.col(c) for c in ("checkpoint_type", "checkpoint_before")}

    def record(rows: DataFrame, event: int, status: Column, more: Sequence[str] = (), **values) -> None:
        events = ledger_events(rows, event, run_id, status, as_of, more, **carried, **values)
        store.append_ledger(events, run_id, event)

    # From the landed event on what has landed counts, also when an earlier attempt landed it.
    landed = store.landed(spark, run_id).select(*_CARRIED).collect()
    if not landed:
        marks = {source: states.get(source, UNKNOWN).mark for source in sources}
        opened = [(s.kind, s.name, s.mark_kind, marks[s.kind, s.name]) for s in specs]
        record(_source_rows(spark, opened, _OPENED), STARTED, F.lit("running"))
        seen, failed = _land(spark, store, specs, run_id, as_of, marks if use_marks else {})
        rows = [
            (*one, failed.get(one[:2]), *({**_NOTHING, **seen.get(one[:2], {})}[name] for name in _NOTHING))
            for one in opened
        ]
        known = _source_rows(spark, rows, f"{_OPENED}, error_message string, {_LANDED}")
        marked = _with_marks(known, specs, as_of)
        landed = marked.select(*_CARRIED).collect()
        record(marked, LANDED, F.lit("running"), **{name: F.col(name) for name in _CARRIED[4:]})
        for kind, name, *_, extracted, _, _ in landed:
            if extracted:
                state = states.get((kind, name), UNKNOWN)
                states[kind, name] = replace(state, pending=tuple(sorted({*state.pending, run_id})))
    of_run = _source_rows(spark, [tuple(row) for row in landed], _LANDED_ROW)
    finish = {"completed_at": F.lit(as_of), **{name: F.col(name) for name in ("records_extracted", "checkpoint_after")}}
    down = {(row.source_type, row.source_name) for row in landed if row.error_message is not None}
    try:
        loaded = load_backlog(
            spark, store, run_id, as_of, [s for s in specs if (s.kind, s.name) not in down], states, tasks
        )
    except Exception as error:
        failure = {"error_message": F.lit(str(error)), "completed_at": F.lit(as_of)}
        record(of_run, FINISHED, F.lit("failed"), **failure)
        raise
    configured = _source_rows(spark, sources)
    finished = of_run.join(configured, list(SOURCE), "left_semi").join(loaded, list(SOURCE), "left")
    refused = F.coalesce("records_failed", F.lit(0))
    status = (
        F.when(F.col("error_message").isNotNull(), "failed")
        .when(refused > 0, "partial")
        .otherwise("success")
    )
    record(
        finished,
        FINISHED,
        status,
        PUBLISHED,
        **finish,
        records_loaded=F.coalesce("records_loaded", F.lit(0)),
        records_failed=refused,
        error_message=F.coalesce(
            "error_message",
            F.when(refused > 0, F.concat(refused.cast("string"), F.lit(" records failed"))),
        ),
    )
    return store.runs(spark).filter(F.col("run_id") == run_id)
