"""Run ledger: current runs, checkpoints per source, and comparisons between runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.operators.slots import number_rows, with_halo
from millrace.schemas import LEDGER

SOURCE = ("source_type", "source_name")
STARTED, LANDED, FINISHED = 0, 1, 2


def ledger_events(
    rows: DataFrame,
    event_seq: int,
    run_id: str,
    status: Column,
    started_at: dt.datetime,
    more: Sequence[str] = (),
    **values,
) -> DataFrame:
    """Ledger rows of one event for the sources in ``rows``; ``values`` are further columns, ``more`` are kept."""
    given = {
        "run_id": F.lit(run_id),
        "event_seq": F.lit(event_seq),
        "status": status,
        "started_at": F.lit(started_at),
        "source_type": F.col("source_type"),
        "source_name": F.col("source_name"),
        **values,
    }
    return rows.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LEDGER.fields
        ],
        *more,
    )


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def current_runs(ledger: DataFrame) -> DataFrame:
    """The last known state of every run and source, with its duration.

    Events repeat harmlessly. A mark counts as soon as the records have landed, so
    ``checkpoint_after`` is the latest one any event of the run carries.
    """
    group = ["run_id", *SOURCE]
    rest = [
        f.name for f in LEDGER.fields if f.name not in (*group, "checkpoint_after", "event_seq")
    ]
    seq = F.col("event_seq")
    marked = F.when(F.col("checkpoint_after").isNotNull(), seq)
    folded = ledger.groupBy(*group).agg(
        F.max_by(F.struct(*rest), seq).alias("_state"),
        F.max_by("checkpoint_after", marked).alias("checkpoint_after"),
        F.max(seq).alias("event_seq"),
    )
    return folded.select(
        *group,
        "event_seq",
        "_state.*",
        "checkpoint_after",
        duration_seconds(F.col("_state.started_at"), F.col("_state.completed_at")).alias(
            "duration_seconds"
        ),
    )


def fold_checkpoints(ledger: DataFrame) -> DataFrame:
    """One checkpoint row per source: mark, last run, last success and failure, cumulative counts.

    Runs without a finish count nowhere but in the mark. The mark of a failed run is the one it
    started from, so a failure leaves it where it was.
    """
    runs = current_runs(ledger)
    finished = F.col("event_seq") == FINISHED
    last = F.when(finished, F.struct("started_at", "run_id"))
    marked = F.when(
        F.col("checkpoint_after").isNotNull() & (F.col("checkpoint_after") != ""),
        F.struct("started_at", "run_id"),
    )
    folded = runs.groupBy(*SOURCE).agg(
        F.max_by("checkpoint_after", marked).alias("checkpoint_value"),
        F.max_by(
            F.struct("status", "records_extracted", "error_message", "checkpoint_type"), last
        ).alias("_last"),
        F.max(F.when(finished, F.col("completed_at"))).alias("last_run_at"),
        F.max(F.when(finished & (F.col("status") == "success"), F.col("completed_at"))).alias(
            "last_success_at"
        ),
        F.max(F.when(finished & (F.col("status") == "failed"), F.col("completed_at"))).alias(
            "last_failure_at"
        ),
        F.count_if(finished).alias("total_runs"),
        F.coalesce(
            F.sum(F.when(finished, F.col("records_extracted"))), F.lit(0).cast("bigint")
        ).alias("total_records_processed"),
        F.min("started_at").alias("created_at"),
    )
    return folded.select(
        *SOURCE,
        F.col("_last.checkpoint_type").alias("checkpoint_type"),
        "checkpoint_value",
        "last_run_at",
        "last_success_at",
        "last_failure_at",
        "total_runs",
        "total_records_processed",
        F.coalesce(F.col("_last.records_extracted"), F.lit(0).cast("bigint")).alias(
            "last_records_processed"
        ),
        F.coalesce(F.col("_last.status"), F.lit("pending")).alias("status"),
        F.col("_last.error_message").alias("error_message"),
        "created_at",
        F.col("last_run_at").alias("updated_at"),
    )


def run_anomalies(
    runs: DataFrame,
    k: int,
    z: float,
    metric: str = "records_extracted",
    block_rows: int = 100_000,
    slots: int | None = None,
) -> DataFrame:
    """Each run against its source's ``k`` runs before it.

    Gives the previous value, the mean and sample standard deviation of the window, the score and
    ``is_anomaly`` (absolute score above ``z``). A source's runs are cut into blocks of
    ``block_rows``, so a source with very many runs spreads over tasks.
    """
    numbered = number_rows(runs, SOURCE, ["started_at", "run_id"], "run_no", slots)
    blocks = with_halo(numbered, "run_no", k, max(block_rows, k))
    by_block = W.partitionBy(*SOURCE, "_block").orderBy("run_no")
    before = by_block.rowsBetween(-k, -1)
    value = F.col(metric).cast("double")
    compared = blocks.select(
        *SOURCE,
        "run_id",
        "started_at",
        "run_no",
        value.alias("value"),
        "_halo",
        F.lag(value).over(by_block).alias("previous"),
        F.avg(value).over(before).alias("window_mean"),
        F.stddev_samp(value).over(before).alias("window_stddev"),
    ).filter(~F.col("_halo"))
    spread = F.when(F.col("window_stddev") > 0, F.col("window_stddev"))
    score = F.try_divide(F.col("value") - F.col("window_mean"), spread)
    return compared.drop("_halo").select(
        "*",
        score.alias("score"),
        F.coalesce(F.abs(score) > z, F.lit(False)).alias("is_anomaly"),
    )


def phase_means(events: DataFrame) -> DataFrame:
    """Mean milliseconds per phase of a run, from (run_id, phase, elapsed_ms) rows."""

    def mean_of(phase: str) -> Column:
        return F.avg(F.when(F.col("phase") == phase, F.col("elapsed_ms")))

    return events.groupBy("run_id").agg(
        mean_of("extraction").alias("avg_extraction_time_ms"),
        mean_of("transformation").alias("avg_transformation_time_ms"),
        mean_of("loading").alias("avg_loading_time_ms"),
    )

