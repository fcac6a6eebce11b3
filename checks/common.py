"""Adapters that present the given tables as source records, run ledgers and items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.landing import stable_id
from millrace.schemas import LEDGER
from millrace.session import configure, spread

AS_OF = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *key: str) -> DataFrame:
    """A table as input of costly per-row work, over no fewer tasks than its scan has; ``key`` tells its rows apart."""
    scan = table(spark, sf_dir, name)
    return spread(scan, max(spark.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()), *key)


def json_of(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def ordinal(part: Column, pos: Column) -> Column:
    return F.struct(
        part.alias("part"), F.lit(0).cast("bigint").alias("block"), pos.cast("bigint").alias("pos")
    )


def raw_rows(df: DataFrame, kind: str, name: Column, payload: Column, pos: Column) -> DataFrame:
    """Rows as landed by one run, for the steps that start from the raw table."""
    return df.select(
        stable_id(F.lit(kind), name, pos).alias("raw_id"),
        F.lit(kind).alias("source_type"),
        name.alias("source_name"),
        F.lit(AS_OF).cast("timestamp").alias("ingested_at"),
        F.lit("run-1").alias("etl_run_id"),
        ordinal(name, pos).alias("ordinal"),
        payload.alias("raw_payload"),
    )


def naive(c: str) -> Column:
    """Instant as zone-less UTC timestamp, the type of the given tables."""
    return F.col(c).cast("timestamp_ntz").alias(c)


def part_payload() -> Column:
    return json_of(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("string").alias("cost"),
        F.col("p_size").cast("string").alias("quantity"),
        F.concat_ws(", ", "p_brand", "p_type").alias("keywords"),
    )


def customer_payload() -> Column:
    return json_of(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("category"), F.col("c_acctbal").cast("string").alias("cost"),
    )


def part_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(
        spread_table(spark, sf_dir, "part", "p_partkey"), "csv", F.lit("parts"), part_payload(),
        F.col("p_partkey"),
    )


def event_payload() -> Column:
    return json_of(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("https://example.com/e/"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        F.col("value").alias("price"),
        F.col("user_id").alias("stock"),
        (F.get_json_object("props", "$.k").cast("double") / 20).alias("rating"),
        F.date_format("ts", ISO_MICROS).alias("created_at"),
        F.array(
            F.col("event_type"), F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit(" "))
        ).alias("tags"),
        F.col("props"),
    )


def event_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(
        spread_table(spark, sf_dir, "events", "event_id"), "api", F.lit("events"),
        event_payload(), F.col("event_id"),
    )


def cdata(c: Column) -> Column:
    """XML character data; an end mark inside the text is split over two sections."""
    split = F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), split, F.lit("]]>"))


def page_title() -> Column:
    return F.regexp_extract("html", "<title>(.*?)</title>", 1)


def page_item() -> Column:
    """A page as one RSS item, its whole HTML as content."""
    minute = F.timestamp_add("MINUTE", F.col("page_id"), F.lit("2024-01-01").cast("timestamp"))
    return F.concat(
        F.lit("<item><guid>"), F.col("page_id").cast("string"),
        F.lit("</guid><title>"), cdata(page_title()),
        F.lit("</title><link>"), cdata(F.col("url")),
        F.lit("</link><pubDate>"), F.date_format(minute, "d MMM yyyy HH:mm:ss"),
        F.lit(" +0000</pubDate><content:encoded xmlns:content=\"c\">"), cdata(F.col("html")),
        F.lit("</content:encoded></item>"),
    )


def ledger_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a run of one of five sources; an order without line items never finished."""
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("records"))
    )
    orders = table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left")
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "success")
        .otherwise("partial")
    )
    start = F.col("o_orderdate").cast("timestamp")
    micros = F.round(F.col("o_totalprice") * 100).cast("bigint") * 10_000
    finished = F.col("records").isNotNull()
    base = {
        "run_id": F.col("o_orderkey").cast("string"),
        "source_type": F.lit("csv"),
        "source_name": F.concat(F.lit("src"), (F.col("o_custkey") % 5).cast("string")),
        "status": F.lit("running"),
        "started_at": start,
        "checkpoint_type": F.lit("id"),
    }
    landed = {
        "records_extracted": F.col("records"),
        "checkpoint_after": F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")),
    }
    ended = {
        "status": status,
        "completed_at": F.timestamp_add("MICROSECOND", micros, start),
        "records_loaded": F.col("records") - F.when(F.col("o_orderstatus") == "P", 1).otherwise(0),
        "records_failed": F.when(F.col("o_orderstatus") == "P", 1).otherwise(0),
        "error_message": F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")),
    }

    # One pass over the orders; a run contributes an array of its events.
    def event(seq: int, values: dict) -> Column:
        given = {**base, "event_seq": F.lit(seq), **values}
        return F.struct(
            *[
                given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in LEDGER.fields
            ]
        )

    events = F.array(
        event(0, {}),
        F.when(finished, event(1, landed)),
        F.when(finished, event(2, {**landed, **ended})),
    )
    exploded = orders.select(F.explode(events).alias("_e"))
    return exploded.filter(F.col("_e").isNotNull()).select("_e.*")


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as unified items of five sources."""
    key = F.col("p_partkey")
    created = F.timestamp_add("MINUTE", key % 1000, F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"),
        F.when(F.col("p_size") % 2 == 0, "csv").otherwise("api").alias("source_type"),
        F.concat(F.lit("src"), (key % 5).cast("string")).alias("source_name"),
        key.cast("string").alias("external_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("amount"),
        (F.col("p_size") / 10).alias("rating"),
        F.when(F.col("p_size") > 10, "active").otherwise("inactive").alias("status"),
        F.when(
            F.col("p_size") <= 40,
            F.timestamp_add("DAY", F.col("p_size"), F.lit("2024-01-01").cast("timestamp")),
        ).alias("published_at"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
