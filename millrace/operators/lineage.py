"""Lineage: items to the raw rows they came from, and those to the runs that landed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookup import join_lookup


def raw_to_run(raw: DataFrame, runs: DataFrame, run_key: str = "etl_run_id") -> DataFrame:
    """Raw rows with the run that landed them; one run may own most rows."""
    return join_lookup(raw, runs.withColumnRenamed("run_id", run_key), [run_key])


def item_to_run(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items with the run that last wrote them; one run may own most items."""
    return join_lookup(items, runs.withColumnRenamed("run_id", "etl_run_id"), ["etl_run_id"])


def lineage(items: DataFrame, raw: DataFrame, runs: DataFrame) -> DataFrame:
    """Item, raw row and landing run, one row per item.

    ``item_run_id`` is the run that last wrote the item, ``etl_run_id`` the one that landed its
    first raw row.
    """
    slim_items = items.select(
        "id", "source_type", "source_name", "external_id", "raw_data_id",
        F.col("etl_run_id").alias("item_run_id"),
    )
    slim_raw = raw.select("raw_id", "source_id", "ingested_at", "file_path", "etl_run_id")
    slim_runs = runs.select(
        "run_id", F.col("status").alias("run_status"), F.col("started_at").alias("run_started_at")
    )
    traced = slim_items.join(
        raw_to_run(slim_raw, slim_runs), F.col("raw_data_id") == F.col("raw_id"), "left"
    )
    return traced.drop("raw_id")
