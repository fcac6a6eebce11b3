import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from checks import flow, mapping, reports, state

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return v.isoformat() if isinstance(v, dt.datetime) else repr(v)

    return sorted(tuple(map(cell, row)) for row in rows)


LIBRARY = ["flagship", *mapping.QUERIES, *state.QUERIES, *reports.QUERIES, *flow.QUERIES]


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_query_equals_its_sql(spark, duck, name):
    result = spark_entry.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    sql = f"SELECT {names} FROM ({spark_entry.oracle_sql()[name]})"
    described = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES[t] for c, t in result.dtypes} == described
    assert canonical(result.select(*columns).collect()) == canonical(duck.execute(sql).fetchall())


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["csv_mixed_headers", "feed_mixed"])
def test_mixed_files_grow_in_number_with_the_table(spark, tmp_path, monkeypatch, name):
    given = spark.range(3_000).selectExpr("id AS page_id", "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand")
    monkeypatch.setattr(mapping, "table", lambda *_: given)
    monkeypatch.setattr(mapping, "fresh_path", lambda *_: str(tmp_path / "w"))
    assert mapping.QUERIES[name][0](spark, "").count() == 3_000
    files = [path.read_text() for path in (tmp_path / "w").rglob("part-*")]
    assert len(files) == 6 and max(text.count("\n") + text.count("<title>") for text in files) <= 502


def test_a_long_conversation_is_spread(spark, tmp_path):
    turns = spark.range(1_000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "'t' AS text")
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = mapping.custom_mapping(spark, str(tmp_path))
    assert rows.selectExpr("spark_partition_id() AS p").distinct().count() > 2


def test_events_are_paged_up_to_a_gap_and_their_pages_parsed_by_several_tasks(spark, tmp_path):
    kept = "id < 950 OR id >= 1000"
    rows = spark.range(2_000).filter(kept).selectExpr("id AS event_id", "concat('t', id % 7) AS event_type")
    odd = spark.sql("SELECT CAST(NULL AS BIGINT) AS event_id, 'x' AS event_type UNION ALL SELECT -5, 'y' UNION ALL SELECT 120, 't1'")
    rows.union(odd).orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    result = flow.paged_source(spark, str(tmp_path))
    ids = sorted([*range(950), 120])
    first = {page: ids.index(100 * page - 100) for page in range(1, 11)}
    expected = [(i // 100 + 1, k - first[i // 100 + 1], i, f"t{i % 7}") for k, i in enumerate(ids)]
    assert sorted(tuple(r) for r in result.select("page", "pos", "event_id", "event_type").collect()) == expected
    assert result.selectExpr("spark_partition_id() AS p").distinct().count() > 2
