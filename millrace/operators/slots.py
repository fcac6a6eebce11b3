"""Ordered per-key computations that never put one key's whole history into one task.

Rows are range-partitioned by key and order, which cuts a key with most of the rows into as many
slots as it needs, whatever its distribution in time. Windows run inside (key, slot); what a slot
has to know about earlier ones comes from a summary with one row per slot, which is all that is
ever ordered per key as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.session import durable


def in_slots(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slots: int | None = None
) -> DataFrame:
    """Rows with ``_slot``: slots hold similar numbers of rows and follow one another in order.

    ``order`` must end in a column that tells all rows of a key apart. Slot borders come from a
    sample, so the assignment is written to the shared folder once: summaries and rows, and a
    task that has to be repeated, all see the same one.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(slots, *by) if slots else df.repartitionByRange(*by)
    return durable(ranged.withColumn("_slot", F.spark_partition_id().cast("bigint")))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], to: str, slots: int | None = None
) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``, as ``to``."""
    keys, order = list(keys), list(order)
    slotted = in_slots(df, keys, order, slots)
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*order))
    return (
        slotted.withColumn("_within", within)
        .join(offsets, [*keys, "_slot"])
        .withColumn(to, F.col("_offset") + F.col("_within"))
        .drop("_slot", "_within", "_offset")
    )


def with_halo(
    df: DataFrame, position: str, preceding: int, block_rows: int
) -> DataFrame:
    """Rows cut into blocks of ``block_rows`` consecutive positions, as ``_block``.

    The last ``preceding`` rows of a block appear again in the next one with ``_halo`` true, so a
    frame reaching ``preceding`` rows back is complete inside every block.
    """
    if block_rows < preceding:
        raise ValueError("a block must hold at least the rows a frame reaches back")
    zero_based = F.col(position) - 1
    block = F.floor(zero_based / block_rows).cast("bigint")
    is_tail = zero_based % block_rows >= block_rows - preceding
    copies = F.when(is_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_step", F.explode(copies)).select(
        *df.columns, (block + F.col("_step")).alias("_block"), (F.col("_step") == 1).alias("_halo")
    )
