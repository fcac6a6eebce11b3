"""Circuit state per source carried across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.resilience import RESET_SECONDS, THRESHOLD, circuit_step

OUTPUT = "source string, attempt_id bigint, allowed boolean, failures bigint, open_until_us bigint"
STATE = "failures bigint, open_until_us bigint"


class CircuitProcessor(StatefulProcessor):
    """State is the failure count and the end of the open period, two numbers per source."""

    def __init__(self, threshold: int, reset_s: int) -> None:
        self.threshold = threshold
        self.reset = reset_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("circuit", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # One micro-batch of one source; batch size is bounded by the stream's read limits.
        batch = pd.concat(list(rows)).sort_values(["at_us", "attempt_id"], kind="stable")
        failures, until = self.state.get() if self.state.exists() else (0, None)
        allowed, counts, untils = [], [], []
        for at, failed in zip(batch["at_us"], batch["failed"], strict=True):
            failures, until, let = circuit_step(
                failures, until, at, failed, self.threshold, self.reset
            )
            allowed.append(let)
            counts.append(failures)
            untils.append(until)
        self.state.update((int(failures), None if until is None else int(until)))
        yield pd.DataFrame(
            {
                "source": batch["source"],
                "attempt_id": batch["attempt_id"],
                "allowed": allowed,
                "failures": counts,
                "open_until_us": pd.array(untils, dtype="Int64"),
            }
        )

    def close(self) -> None:
        pass


def stream_circuit(
    attempts: DataFrame, threshold: int = THRESHOLD, reset_s: int = RESET_SECONDS
) -> DataFrame:
    """Circuit state after each attempt of a stream of (source, attempt_id, at, failed).

    Needs the RocksDB state store provider.
    """
    timed = attempts.select(
        "source", "attempt_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "failed"
    )
    return timed.groupBy("source").transformWithStateInPandas(
        statefulProcessor=CircuitProcessor(threshold, reset_s),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
    )
