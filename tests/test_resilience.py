import datetime as dt
import random

import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import resilience
from millrace.operators.resilience import (
    backoff,
    circuit_state,
    circuit_step,
    classify_outcome,
    error_records,
    failure_streaks,
)
from millrace.operators.slots import in_slots

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)


def attempts_of(spark, rows):
    """(source, second, id, failed)"""
    return spark.createDataFrame(
        [(s, START + dt.timedelta(seconds=t), i, bad) for s, t, i, bad in rows],
        "source string, at timestamp, id bigint, failed boolean",
    )


def random_attempts(seed, n=600, span=4000, failing=0.7):
    draw = random.Random(seed)
    return [
        (draw.choice(["hot", "hot", "hot", "a", "b"]), draw.randint(0, span), i, draw.random() < failing)
        for i in range(n)
    ]


def fold(rows, threshold, reset_s):
    """The definition, one attempt after the other."""
    out, state = {}, {}
    for source, t, i, failed in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        count, until = state.get(source, (0, None))
        if until is not None and t < until:
            out[i] = (False, count, until)
            continue
        if until is not None:
            count, until = 0, None
        if failed:
            count += 1
            if count >= threshold:
                until = t + reset_s
        else:
            count = 0
        state[source] = (count, until)
        out[i] = (True, count, until)
    return out


@pytest.mark.parametrize(
    ("seed", "threshold", "reset_s", "slots", "failing"),
    [
        (1, 5, 60, None, 0.7), (2, 3, 60, 9, 0.5), (3, 2, 100, 50, 0.6), (4, 1, 10, 150, 0.5),
        (5, 5, 60, 20, 1.0), (6, 4, 700, 60, 0.9), (7, 5, 60, 1, 0.0),
    ],
)
def test_circuit_equals_the_sequential_definition(spark, seed, threshold, reset_s, slots, failing):
    rows = random_attempts(seed, failing=failing)
    got = circuit_state(
        attempts_of(spark, rows), ["source"], "at", "id", "failed", threshold, reset_s, slots
    ).collect()
    want = fold(rows, threshold, reset_s)
    assert len(got) == len(rows)
    for r in got:
        until = r.open_until and (r.open_until - START.replace(tzinfo=None)).total_seconds()
        assert (r.allowed, r.failures, until) == want[r.id]
        assert r.circuit == ("open" if until is not None else "closed")


def test_a_source_with_most_attempts_spreads_over_slots(spark):
    rows = [("hot", t, t, t % 4 > 0) for t in range(900)] + [("a", t, 1000 + t, True) for t in range(90)]
    slotted = in_slots(attempts_of(spark, rows), ["source"], ["at", "id"], 12)
    sizes = [r["count"] for r in slotted.groupBy("_slot").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 250


def test_five_failures_open_for_a_minute(spark):
    rows = [("s", t, t, True) for t in range(5)] + [("s", 30, 30, False), ("s", 64, 64, True)]
    got = circuit_state(attempts_of(spark, rows), ["source"], "at", "id", "failed").orderBy("id").collect()
    assert [r.circuit for r in got] == ["closed"] * 4 + ["open", "open", "closed"]
    assert [r.allowed for r in got] == [True] * 5 + [False, True]
    assert got[-1].failures == 1


def test_success_clears_the_count():
    state = (0, None)
    for failed in (True, True, True, True, False, True):
        *state, allowed = circuit_step(*state, 0, failed, 5, 60)
        assert allowed
    assert tuple(state) == (1, None)


@pytest.mark.parametrize("slots", [1, 7, 90])
def test_streaks_equal_the_sequential_count(spark, slots):
    rows = random_attempts(11, failing=0.8)
    got = failure_streaks(
        attempts_of(spark, rows), ["source"], "at", "id", "failed", slots
    )
    counts, want = {}, {}
    for source, _, i, failed in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        counts[source] = counts.get(source, 0) + 1 if failed else 0
        want[i] = counts[source]
    assert {r.id: r.streak for r in got.collect()} == want


def test_outcome_classes_and_retry(spark):
    cases = [
        (200, None, None, False), (204, None, None, False), (401, None, "auth", False),
        (403, None, "auth", False), (404, None, "not_found", False), (429, None, "rate_limit", True),
        (500, None, "server", True), (503, None, "server", True), (400, None, "client_error", False),
        (None, "timeout", "timeout", True), (None, "network", "network", True),
        (None, "odd", "unexpected", True), (None, None, "unexpected", True), (302, None, "unexpected", True),
    ]
    rows = spark.createDataFrame(
        [(i, c, t) for i, (c, t, _, _) in enumerate(cases)], "i int, status_code int, transport_error string"
    )
    got = classify_outcome(rows).orderBy("i").collect()
    assert [(r.error_class, r.retryable) for r in got] == [(e, y) for _, _, e, y in cases]


def test_backoff_doubles_and_obeys_retry_after(spark):
    rows = spark.createDataFrame(
        [(0, 500, None), (1, 500, None), (2, 500, None), (1, 429, 7), (0, 500, 7), (0, 404, None)],
        "attempt int, status_code int, retry_after int",
    ).select("*", F.lit(None).cast("string").alias("transport_error"), F.lit(START).alias("ts"))
    got = backoff(classify_outcome(rows), base=1.5).collect()
    assert [r.delay_seconds for r in got] == [1.5, 3.0, None, 7.0, 1.5, None]
    assert got[1].next_eligible_at == START.replace(tzinfo=None) + dt.timedelta(seconds=3)


def test_error_records_cut_the_body(spark):
    rows = spark.createDataFrame(
        [(503, "b" * 501, "u"), (200, "ok", "u")], "status_code int, body string, url string"
    ).select("*", F.lit(None).cast("string").alias("transport_error"), F.lit(START).alias("ts"))
    (record,) = error_records(classify_outcome(rows), ["url", "status_code"]).collect()
    assert record.context == {"url": "u", "status_code": "503", "response_body": "b" * 500}
    assert record.error_class == "server"


def test_slot_report_is_linear_in_the_attempts():
    def seconds(n):
        report = resilience._SlotReport(5, 10 * n)
        began = time.perf_counter()
        for at in range(n):
            report.add(at, at % 3 > 0)
        ends = report.result()
        assert len(ends["closed"]) == 5 and ends["open_times"][-1] == n - 1
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(80_000) < 30 * seconds(8_000)
