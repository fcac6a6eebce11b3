"""Late rows and repeated rows in a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SLOT, AT = "_late_slot", "_late_at"


def split_late(
    df: DataFrame, ts: str, mark: str | None, delay: str = "0 seconds"
) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late rows are at or before ``mark`` (ISO text) less ``delay``.

    Undated rows are on time, and without a mark all rows are.
    """
    at = F.col(ts).cast("timestamp")
    bound = F.lit(mark).cast("timestamp") - F.expr(f"interval {delay}")
    late = F.coalesce(at <= bound, F.lit(False))
    return df.filter(~late), df.filter(late)


def start_late_split(
    stream: DataFrame,
    ts: str,
    mark: Callable[[], str | None],
    delay: str,
    on_time_path: str,
    late_path: str,
    checkpoint_dir: str,
    trigger: dict,
) -> StreamingQuery:
    """Write each micro-batch to two Parquet tables instead of losing its late rows.

    ``mark`` is asked once per batch, usually for the source's checkpoint. Each batch writes its
    own folder, so a repeated batch replaces itself.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        on_time, late = split_late(batch, ts, mark(), delay)
        on_time.write.mode("overwrite").parquet(f"{on_time_path}/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**trigger)
        .start()
    )


class LateMarker(StatefulProcessor):
    """Compares rows with the watermark of their micro-batch; keeps no state."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            # By place: names that are no Python names arrive changed.
            frame.columns = [*self.names, AT, SLOT]
            # The first micro-batch has no watermark, which reads 0; undated rows compare false.
            late = (frame[AT] <= mark) if mark > 0 else pd.Series(False, index=frame.index)
            yield frame.drop(columns=[SLOT, AT]).assign(is_late=late.fillna(False).astype(bool))

    def close(self) -> None:
        pass


def mark_late(stream: DataFrame, ts: str, delay: str, slots: int | None = None) -> DataFrame:
    """The stream's rows with ``is_late``: whether the event time is at or before the stream's own watermark.

    The watermark is the latest event time of all earlier micro-batches less ``delay``, in milliseconds. Spark logs it with
    the batch, so a repeated batch gives the same rows. Rows in the first micro-batch and undated rows are on time. No
    row is dropped: the watermark's column does not reach the operator. Rows are spread over ``slots`` by their content,
    so no source is hot. Needs the RocksDB state store provider.
    """
    if slots is None:
        slots = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [F.col(f"`{name}`") for name in stream.columns]
    output = T.StructType([*stream.schema.fields, T.StructField("is_late", T.BooleanType())])
    watched = stream.withColumn("_late_ts", F.col(ts).cast("timestamp")).withWatermark("_late_ts", delay)
    spread = watched.select(
        *names,
        F.unix_micros("_late_ts").alias(AT),
        F.pmod(F.xxhash64(*names), F.lit(slots)).alias(SLOT),
    )
    return spread.groupBy(SLOT).transformWithStateInPandas(
        statefulProcessor=LateMarker(stream.columns), outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


def drop_repeats(stream: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Rows without those repeating a key within ``delay`` of event time."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys))
