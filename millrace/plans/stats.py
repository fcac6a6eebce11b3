"""Statistics and health over items, runs and checkpoints: one aggregate per table, no per-source jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ledger import SOURCE

MAX_RECENT_RUNS = 100


def _mean_success_seconds(digits: int | None = 2) -> Column:
    """Mean duration of successful runs; null where there is none or it is zero."""
    mean = F.avg(F.when(F.col("status") == "success", F.col("duration_seconds")))
    rounded = mean if digits is None else F.round(mean, digits)
    return F.when(mean != 0, rounded)


def stats_summary(items: DataFrame, runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row of totals. Each table is aggregated to one row; the rows are stacked and folded."""
    parts = [
        items.agg(F.count("*").alias("total_records")),
        checkpoints.agg(
            F.count("*").alias("total_sources"),
            F.max("last_success_at").alias("last_success"),
            F.max("last_failure_at").alias("last_failure"),
        ),
        runs.agg(
            F.count("*").alias("total_runs"),
            _mean_success_seconds().alias("avg_run_duration_seconds"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns]).withColumn(
        "active_sources", F.col("total_sources")
    )


def _zero_if_null(name: str, kind: str = "bigint") -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast(kind)).alias(name)


def stats_by_source(items: DataFrame, runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row per checkpoint. All sides are reduced to one row per source before they meet."""
    per_item = items.groupBy(*SOURCE).agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("status") == "active").alias("active_records"),
    )
    per_run = runs.groupBy(*SOURCE).agg(
        F.count_if(F.col("status") == "success").alias("_successes"),
        _mean_success_seconds(None).alias("avg_duration_seconds"),
    )
    runs_made = F.when(F.col("total_runs") > 0, F.col("total_runs"))
    rate = F.round(F.lit(100.0) * F.col("_successes") / runs_made, 1)
    mean_records = F.round(F.col("total_records_processed") / runs_made, 1)
    none = F.lit(0.0)
    return (
        checkpoints.join(per_item, list(SOURCE), "left")
        .join(per_run, list(SOURCE), "left")
        .select(
            *SOURCE,
            _zero_if_null("total_records"),
            _zero_if_null("active_records"),
            "last_run_at",
            "last_success_at",
            "last_failure_at",
            "total_runs",
            F.when(runs_made.isNull(), none)
            .otherwise(F.coalesce(rate, none))
            .alias("success_rate"),
            F.coalesce(mean_records, none).alias("avg_records_per_run"),
            "avg_duration_seconds",
        )
    )


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` runs started last; missing counters read 0."""
    if not 1 <= n <= MAX_RECENT_RUNS:
        raise ValueError(f"n must be 1 to {MAX_RECENT_RUNS}")
    return (
        runs.orderBy(F.col("started_at").desc(), F.col("run_id").asc())
        .limit(n)
        .select(
            "run_id",
            "source_type",
            "started_at",
            "completed_at",
            _zero_if_null("records_extracted"),
            _zero_if_null("records_loaded"),
            _zero_if_null("records_failed"),
        )
    )


def stats_groups(items: DataFrame) -> DataFrame:
    """Item counts by source kind, by category and in total: (``grouping``, ``value``, ``records``).

    The table is counted once per (kind, category); the three groupings are taken from that result.
    """
    counted = items.groupBy("source_type", "category").agg(F.count("*").alias("_n"))
    sets = counted.groupingSets(
        [[F.col("source_type")], [F.col("category")], []],
        F.col("source_type"),
        F.col("category"),
    ).agg(F.sum("_n").alias("records"), F.grouping_id().alias("_set"))
    # grouping_id has one bit per column, set where the column is aggregated away.
    return sets.select(
        F.when(F.col("_set") == 1, "source_type")
        .when(F.col("_set") == 2, "category")
        .otherwise("total")
        .alias("grouping"),
        F.coalesce("source_type", "category").alias("value"),
        F.coalesce("records", F.lit(0).cast("bigint")).alias("records"),
    )


def health(checkpoints: DataFrame) -> DataFrame:
    """One row: sources by state and the overall status."""
    failed, total = F.col("failed_sources"), F.col("total_sources")
    return checkpoints.agg(
        F.count("*").alias("total_sources"),
        F.count_if(F.col("status") == "success").alias("successful_sources"),
        F.count_if(F.col("status") == "failed").alias("failed_sources"),
    ).withColumn(
        "status",
        F.when(failed == 0, "healthy").when(failed < total, "degraded").otherwise("unhealthy"),
    )


def checkpoint_listing(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select(
        *SOURCE,
        "status",
        "last_run_at",
        "last_success_at",
        "last_failure_at",
        "total_records_processed",
        "last_records_processed",
        "checkpoint_value",
        "error_message",
    )
