"""Request outcomes, retry decisions, failure streaks and circuit state over attempt logs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from millrace.operators.slots import in_slots

# Error classes that a retry may cure, and the length an error body is cut to.
RETRYABLE = ("rate_limit", "server", "timeout", "network", "unexpected")
BODY_CHARS = 500
THRESHOLD = 5
RESET_SECONDS = 60


def outcome_class(status_code: Column, transport_error: Column) -> Column:
    """Class of one request; null means success.

    ``transport_error`` is ``timeout``, ``network``, any other text for an unexpected error, or
    null when a response with ``status_code`` arrived.
    """
    return (
        F.when(transport_error.isin("timeout", "network"), transport_error)
        .when(transport_error.isNotNull(), "unexpected")
        .when(status_code.isin(401, 403), "auth")
        .when(status_code == 404, "not_found")
        .when(status_code == 429, "rate_limit")
        .when(status_code >= 500, "server")
        .when(status_code >= 400, "client_error")
        .when((status_code >= 300) | status_code.isNull(), "unexpected")
    )


def classify_outcome(attempts: DataFrame) -> DataFrame:
    """Attempts with ``error_class`` and ``retryable``."""
    return attempts.withColumn(
        "error_class", outcome_class(F.col("status_code"), F.col("transport_error"))
    ).withColumn("retryable", F.coalesce(F.col("error_class").isin(*RETRYABLE), F.lit(False)))


def backoff(classified: DataFrame, base: float = 1.0, max_retries: int = 3) -> DataFrame:
    """Delay and next eligible time of retryable attempts (``attempt`` counts from 0).

    The delay doubles per attempt; on a rate limit the server's ``retry_after`` overrides it. The
    last attempt has no next time.
    """
    doubled = F.lit(float(base)) * F.pow(F.lit(2.0), F.col("attempt"))
    asked = F.when(F.col("error_class") == "rate_limit", F.col("retry_after").cast("double"))
    may_retry = F.col("retryable") & (F.col("attempt") < max_retries - 1)
    delayed = classified.withColumn("delay_seconds", F.when(may_retry, F.coalesce(asked, doubled)))
    return delayed.withColumn(
        "next_eligible_at",
        F.timestamp_add(
            "MICROSECOND",
            F.round(F.col("delay_seconds") * 1_000_000).cast("bigint"),
            F.col("ts").cast("timestamp"),
        ),
    )


def error_records(
    classified: DataFrame, context: Sequence[str], body_chars: int | None = BODY_CHARS
) -> DataFrame:
    """Failed attempts as structured error records.

    The body is cut to ``body_chars`` characters, by default as in the request log; ``None`` keeps it whole.
    """
    body = F.col("body") if body_chars is None else F.left(F.col("body"), F.lit(body_chars))
    pairs: list[Column] = []
    for name in context:
        pairs += [F.lit(name), F.col(name).cast("string")]
    pairs += [F.lit("response_body"), body]
    return classified.filter(F.col("error_class").isNotNull()).select(
        "error_class",
        F.concat_ws(" ", F.lit("request failed:"), F.col("error_class")).alias("message"),
        F.create_map(*pairs).alias("context"),
        F.col("ts").alias("at"),
        F.col("transport_error").alias("cause"),
    )


def failure_streaks(
    attempts: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    failed: str,
    slots: int | None = None,
) -> DataFrame:
    """Attempts with ``streak``, the number of consecutive failures ending at each (0 on success).

    Streaks are counted inside (key, slot); a summary with one row per slot carries them over slot
    borders, so a source with most of the attempts spreads over its slots. ``tie`` tells attempts
    of one time apart.
    """
    keys = list(keys)
    slotted = in_slots(attempts, keys, [ts, tie], slots)
    in_slot = W.partitionBy(*keys, "_slot").orderBy(ts, tie)
    numbered = slotted.withColumn("_n", F.row_number().over(in_slot)).withColumn(
        "_last_ok",
        F.max(F.when(~F.col(failed), F.col("_n"))).over(
            in_slot.rowsBetween(W.unboundedPreceding, W.currentRow)
        ),
    )
    # One row per slot; the rows already lie together by (keys, slot), so this does not shuffle.
    summary = numbered.groupBy(*keys, "_slot").agg(
        F.max("_n").alias("_rows"), F.max("_last_ok").alias("_ok_row")
    )
    over_slots = W.partitionBy(*keys).orderBy("_slot")
    earlier = over_slots.rowsBetween(W.unboundedPreceding, -1)
    has_ok = F.col("_ok_row").isNotNull()
    failed_so_far = F.sum(F.when(has_ok, 0).otherwise(F.col("_rows"))).over(
        over_slots.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    # Failures up to the previous slot's end that follow the last success before it.
    carry = (
        F.coalesce(F.max("_failed_so_far").over(earlier), F.lit(0))
        - F.coalesce(F.last(F.when(has_ok, F.col("_failed_so_far")), True).over(earlier), F.lit(0))
        + F.coalesce(
            F.last(F.when(has_ok, F.col("_rows") - F.col("_ok_row")), True).over(earlier), F.lit(0)
        )
    )
    carried = summary.withColumn("_failed_so_far", failed_so_far).select(
        *keys, "_slot", carry.alias("_carry")
    )
    streak = F.when(F.col("_last_ok").isNull(), F.col("_n") + F.col("_carry")).otherwise(
        F.col("_n") - F.col("_last_ok")
    )
    return (
        numbered.join(carried, [*keys, "_slot"])
        .withColumn("streak", streak.cast("bigint"))
        .drop("_slot", "_n", "_last_ok", "_carry")
    )


def circuit_step(
    failures: int, open_until: int | None, at: int, failed: bool, threshold: int, reset: int
) -> tuple[int, int | None, bool]:
    """State after one attempt and whether the attempt was let through; times in microseconds."""
    if open_until is not None:
        if at < open_until:
            return failures, open_until, False
        failures, open_until = 0, None
    if not failed:
        return 0, None, True
    failures += 1
    return failures, (at + reset if failures >= threshold else None), True


# Passed on between time slots; ``until`` is in microseconds and null while the circuit is closed.
_STATE = T.StructType(
    [T.StructField("failures", T.LongType()), T.StructField("until", T.LongType())]
)


class _SlotReport:
    """Follows one slot's attempts from every state the slot may be entered in.

    Entered closed, the count is below the threshold. Entered open, nothing happens up to the
    first attempt at or after the end of the open period, which meets a cleared circuit; so every
    attempt that may be that first one starts a track of its own. Tracks that reach the same state
    merge, so few are ever followed; every origin points on to the one it merged into, so the
    report takes time linear in the attempts.
    """

    def __init__(self, threshold: int, reset: int) -> None:
        self.threshold, self.reset = threshold, reset
        self.merged = list(range(threshold))
        self.tracks = {(count, None): count for count in range(threshold)}
        self.open_times: list[int] = []
        self.first: int | None = None
        self.previous = 0

    def _follow(self, tracks: dict, state: tuple, origin: int) -> None:
        self.merged[origin] = tracks.setdefault(state, origin)

    def _leader(self, origin: int) -> int:
        leader = origin
        while self.merged[leader] != leader:
            leader = self.merged[leader]
        while self.merged[origin] != leader:
            self.merged[origin], origin = leader, self.merged[origin]
        return leader

    def add(self, at: int, failed: bool) -> None:
        if self.first is None:
            self.first = self.previous = at
        # An open period from before this slot ends within ``reset`` of its first attempt.
        if self.previous < self.first + self.reset:
            self.merged.append(len(self.merged))
            self._follow(self.tracks, (0, None), len(self.merged) - 1)
            self.open_times.append(at)
        self.previous = at
        moved: dict = {}
        for (failures, until), origin in self.tracks.items():
            failures, until, _ = circuit_step(
                failures, until, at, failed, self.threshold, self.reset
            )
            self._follow(moved, (failures, until), origin)
        self.tracks = moved

    def result(self) -> dict:
        reached = {
            origin: {"failures": failures, "until": until}
            for (failures, until), origin in self.tracks.items()
        }
        ends = [reached[self._leader(origin)] for origin in range(len(self.merged))]
        times: list[int] = []
        open_ends: list[dict] = []
        for at, end in zip(self.open_times, ends[self.threshold :], strict=True):
            if open_ends and open_ends[-1] == end:
                times[-1] = at
            else:
                times.append(at)
                open_ends.append(end)
        return {"closed": ends[: self.threshold], "open_times": times, "open_ends": open_ends}


def circuit_state(
    attempts: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    failed: str,
    threshold: int = THRESHOLD,
    reset_s: int = RESET_SECONDS,
    slots: int | None = None,
) -> DataFrame:
    """Exact circuit state after every attempt of a source.

    ``threshold`` consecutive failures open the circuit for ``reset_s``; attempts meanwhile are
    not let through and count nowhere; a success clears the count. Adds ``allowed``, ``failures``,
    ``open_until`` and ``circuit`` (``open`` or ``closed``).

    Each (key, slot) first reports its end state for every state it may be entered in. Chaining
    those reports in order gives every slot its entry state, and the slots then run independently.
    All three steps stream over sorted rows and hold one state, so neither a source with most of
    the attempts nor a crowded slot has to fit in memory; only reports of a source meet in a task.
    """
    keys = list(keys)
    columns = attempts.columns
    reset = reset_s * 1_000_000
    group = [*keys, "_slot"]
    key_fields = [attempts.schema[k] for k in keys]
    slot_field = T.StructField("_slot", T.LongType())
    slotted = in_slots(attempts, keys, [ts, tie], slots).withColumn(
        "_us", F.unix_micros(F.col(ts).cast("timestamp"))
    )

    report_schema = T.StructType(
        [
            *key_fields,
            slot_field,
            T.StructField("closed", T.ArrayType(_STATE)),
            T.StructField("open_times", T.ArrayType(T.LongType())),
            T.StructField("open_ends", T.ArrayType(_STATE)),
        ]
    )

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(report_schema)
        current, slot_report = None, None
        for batch in batches:
            done = []
            wanted = [batch.column(c).to_pylist() for c in [*group, "_us", failed]]
            for *owner, at, bad in zip(*wanted, strict=True):
                if owner != current:
                    if slot_report is not None:
                        done.append(dict(zip(group, current, strict=True)) | slot_report.result())
                    current = owner
                    slot_report = _SlotReport(threshold, reset)
                slot_report.add(at, bad)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if slot_report is not None:
            last = dict(zip(group, current, strict=True)) | slot_report.result()
            yield pa.RecordBatch.from_pylist([last], schema=arrow)

    reports = (
        slotted.select(*group, "_us", tie, failed)
        .repartition(*group)
        .sortWithinPartitions(*group, "_us", tie)
        .mapInArrow(report, report_schema)
    )

    entry_schema = T.StructType([*key_fields, slot_field, T.StructField("_entry", _STATE)])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(entry_schema)
        current, state = None, None
        for batch in batches:
            entries = []
            for row in batch.to_pylist():
                owner = [row[k] for k in keys]
                if owner != current:
                    current, state = owner, {"failures": 0, "until": None}
                entries.append({c: row[c] for c in group} | {"_entry": state})
                if state["until"] is None:
                    state = row["closed"][state["failures"]]
                else:
                    first = bisect_left(row["open_times"], state["until"])
                    if first < len(row["open_times"]):
                        state = row["open_ends"][first]
            yield pa.RecordBatch.from_pylist(entries, schema=arrow)

    entries = (
        reports.repartition(*keys).sortWithinPartitions(*group).mapInArrow(chain, entry_schema)
    )

    out_schema = T.StructType(
        [
            *attempts.schema.fields,
            T.StructField("allowed", T.BooleanType()),
            T.StructField("failures", T.LongType()),
            T.StructField("_until", T.LongType()),
        ]
    )

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failures, until = 0, None
        for batch in batches:
            allowed, counts, untils = [], [], []
            wanted = [batch.column(c).to_pylist() for c in ("_entry", "_us", failed)]
            for entry, at, bad in zip(*wanted, strict=True):
                if entry is not None:
                    failures, until = entry["failures"], entry["until"]
                    continue
                failures, until, let = circuit_step(failures, until, at, bad, threshold, reset)
                allowed.append(let)
                counts.append(failures)
                untils.append(until)
            rows = batch.filter(pc.is_null(batch.column("_entry"))).select(columns)
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array(allowed, pa.bool_()),
                    pa.array(counts, pa.int64()),
                    pa.array(untils, pa.int64()),
                ],
                names=[*columns, "allowed", "failures", "_until"],
            )

    # A slot's entry state travels as a row of its own that sorts before the slot's attempts.
    played = (
        slotted.unionByName(entries, allowMissingColumns=True)
        .repartition(*group)
        .sortWithinPartitions(*group, "_us", tie)
        .mapInArrow(replay, out_schema)
    )
    return played.select(
        *columns,
        "allowed",
        "failures",
        F.timestamp_micros("_until").alias("open_until"),
        F.when(F.col("_until").isNotNull(), "open").otherwise("closed").alias("circuit"),
    )
