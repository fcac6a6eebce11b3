import datetime as dt
import re

import pytest

from millrace.plans.items import (
    filters_applied,
    item_page,
    item_query,
    keyset_page,
    page_metadata,
    public_items,
)
from millrace.plans.stats import health, recent_runs, stats_by_source, stats_groups, stats_summary
from millrace.schemas import ITEMS

UTC = dt.timezone.utc


def day(n):
    return dt.datetime(2024, 1, n, tzinfo=UTC)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("1", "api", "One 100%", "first", 5.0, "a", day(1), day(1), "active"),
        ("2", "csv", "Two", "SECOND_x", None, "a", None, day(2), "inactive"),
        ("3", "csv", "three", None, 7.5, "b", day(3), day(2), "active"),
        ("4", "rss", "Four \\ back", "a middle z", 10.0, None, day(4), day(4), "active"),
    ]
    return spark.createDataFrame(
        rows,
        "id string, source_type string, title string, description string, amount double, "
        "category string, published_at timestamp, created_at timestamp, status string",
    )


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    ("filters", "found"),
    [
        ({}, "1234"), ({"source_type": "csv"}, "23"), ({"category": "a"}, "12"), ({"status": "active"}, "134"),
        ({"search": "t"}, "123"), ({"search": ""}, "1234"), ({"search": "SECOND"}, "2"), ({"search": "zzz"}, ""),
        ({"min_amount": 7.5}, "34"), ({"max_amount": 7.5}, "13"), ({"min_amount": 0}, "134"),
        ({"published_after": day(3)}, "34"), ({"published_before": day(3)}, "13"),
        ({"source_type": "csv", "status": "active", "min_amount": 1}, "3"),
    ],
)
def test_filters(items, filters, found):
    assert sorted(ids(item_query(items, **filters))) == list(found)


@pytest.mark.parametrize("term", ["a%z", "o%e", "t_o", "_", "%", "100\\%", "\\\\", "e%e%e", "%%w", "T%O", "x"])
def test_search_wildcards_match_as_in_sql(items, term):
    pattern, chars = "", iter(f"%{term}%")
    for c in chars:
        if c == "\\":
            pattern += re.escape(next(chars, "\\"))
        else:
            pattern += {"%": ".*", "_": "."}.get(c, re.escape(c))
    rule = re.compile(pattern, re.IGNORECASE | re.DOTALL)
    want = [r.id for r in items.collect() if any(t and rule.fullmatch(t) for t in (r.title, r.description))]
    assert ids(item_query(items, search=term)) == want


def test_literal_search(items):
    assert ids(item_query(items, search="0%", literal_search=True)) == ["1"]
    assert ids(item_query(items, search="d_x", literal_search=True)) == ["2"]
    assert ids(item_query(items, search="o%e", literal_search=True)) == []


def test_pages_are_stable_and_sorted(items):
    assert ids(item_page(items, 1, 2)) == ["4", "2"]
    assert ids(item_page(items, 2, 2)) == ["3", "1"]
    assert ids(item_page(items, 3, 2)) == []
    assert ids(item_page(items, sort_by="amount", sort_order="asc")) == ["1", "3", "4", "2"]
    assert ids(item_page(items, sort_by="amount", sort_order="DESC")) == ["2", "4", "3", "1"]


def test_keyset_pages_walk_the_same_order(items):
    seen, after = [], None
    while rows := keyset_page(items, after, 1).collect():
        seen.append(rows[0].id)
        after = (rows[0].created_at.replace(tzinfo=UTC), rows[0].id)
    assert seen == ids(item_page(items))


@pytest.mark.parametrize(
    ("page", "size", "want"),
    [(1, 2, (4, 2, True, False)), (2, 2, (4, 2, False, True)), (9, 2, (4, 2, False, True)), (1, 50, (4, 1, False, False))],
)
def test_page_metadata(items, page, size, want):
    row = page_metadata(items, page, size).first()
    assert (row.total_items, row.total_pages, row.has_next, row.has_previous) == want


def test_page_metadata_of_nothing(items):
    row = page_metadata(items.filter("false"), 1, 50).first()
    assert (row.total_items, row.total_pages, row.has_next) == (0, 0, False)


@pytest.mark.parametrize(
    "call",
    [
        lambda i: item_page(i, 0), lambda i: item_page(i, 1, 0), lambda i: item_page(i, 1, 1001),
        lambda i: item_page(i, sort_by="url"), lambda i: item_page(i, sort_order="up"),
        lambda i: item_query(i, source_type="ftp"), lambda i: item_query(i, status="gone"),
        lambda i: item_query(i, min_amount=-1), lambda i: keyset_page(i, None, 0), lambda i: recent_runs(i, 101),
    ],
)
def test_bad_parameters_are_refused_before_any_job(items, call):
    with pytest.raises(ValueError):
        call(items)


def test_public_shape_hides_internal_columns(spark):
    assert len(public_items(spark.createDataFrame([], ITEMS)).columns) == 20
    assert filters_applied(a=None, b=0, c="x") == {"b": 0, "c": "x"}


def checkpoint_rows(spark, rows):
    return spark.createDataFrame(
        [("api", name, status, day(1), ok, bad, runs, n) for name, status, ok, bad, runs, n in rows],
        "source_type string, source_name string, status string, last_run_at timestamp, "
        "last_success_at timestamp, last_failure_at timestamp, total_runs bigint, total_records_processed bigint",
    )


@pytest.mark.parametrize(
    ("statuses", "want"),
    [
        ([], "healthy"), (["success", "running"], "healthy"), (["failed", "success"], "degraded"),
        (["failed", "failed"], "unhealthy"), (["partial", "failed"], "degraded"),
    ],
)
def test_health(spark, statuses, want):
    rows = [(f"s{i}", s, None, None, 1, 1) for i, s in enumerate(statuses)]
    assert health(checkpoint_rows(spark, rows)).first().status == want


def test_statistics_of_silent_sources(spark, items):
    marks = checkpoint_rows(spark, [("s", "success", day(2), None, 3, 10), ("new", "pending", None, None, 0, 0)])
    runs = spark.createDataFrame(
        [("r1", "api", "s", "success", 2.5), ("r2", "api", "s", "success", 0.004), ("r3", "api", "s", "failed", 9.0),
         ("r4", "api", "s", "success", None)],
        "run_id string, source_type string, source_name string, status string, duration_seconds double",
    )
    known = items.selectExpr("'api' source_type", "'s' source_name", "status", "category")
    rows = {r.source_name: r for r in stats_by_source(known, runs, marks).collect()}
    assert (rows["s"].total_records, rows["s"].active_records, rows["s"].success_rate) == (4, 3, 100.0)
    assert rows["s"].avg_records_per_run == 3.3
    assert (rows["new"].success_rate, rows["new"].avg_records_per_run, rows["new"].total_records) == (0.0, 0.0, 0)
    total = stats_summary(known, runs, marks).first()
    assert (total.total_records, total.total_sources, total.total_runs) == (4, 2, 4)
    assert (total.avg_run_duration_seconds, total.last_failure) == (1.25, None)
    empty = stats_summary(known.filter("false"), runs.filter("false"), marks.filter("false")).first()
    assert (empty.total_records, empty.total_runs, empty.avg_run_duration_seconds) == (0, 0, None)


def test_groups(items):
    got = {(r.grouping, r.value): r.records for r in stats_groups(items).collect()}
    assert got[("total", None)] == 4 and got[("source_type", "csv")] == 2
    assert got[("category", "a")] == 2 and got[("category", None)] == 1
