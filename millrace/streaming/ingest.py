"""Continuous ingestion: the batch run, once per micro-batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.ingest import run_ingest
from millrace.plans.store import Store
from millrace.sources.spec import SourceSpec

EVERY_THIRTY_MINUTES = {"processingTime": "30 minutes"}
ALL_THERE_IS = {"availableNow": True}


def utc_now(_: int) -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def start_ingest(
    records: DataFrame,
    spec: SourceSpec,
    store: Store,
    checkpoint_dir: str,
    trigger: dict | None = None,
    clock: Callable[[int], dt.datetime] = utc_now,
) -> StreamingQuery:
    """Run :func:`run_ingest` on each micro-batch of a stream of records (``payload``, ``ordinal``).

    The run id is the source and the batch number: a batch that Spark repeats after a failure
    replaces what its first attempt wrote. The stream's own position decides what is new, so the
    mark is recorded but does not filter.
    """
    run_name = f"{spec.kind}-{spec.name}".replace("/", "_")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        source = replace(spec, reader=lambda _: batch)
        run_ingest(
            batch.sparkSession, store, [source], f"{run_name}-{batch_id:012d}", clock(batch_id),
            use_marks=False,
        )

    return (
        records.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or EVERY_THIRTY_MINUTES))
        .start()
    )
