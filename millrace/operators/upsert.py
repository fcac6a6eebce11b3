"""Insert-or-update by key, soft deletion and the uniqueness audit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.schemas import ITEM_IMMUTABLE, ITEM_KEYS, ITEM_MUTABLE


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str] = ITEM_KEYS,
    mutable: Sequence[str] = ITEM_MUTABLE,
    immutable: Sequence[str] = ITEM_IMMUTABLE,
    seq: Sequence[str] = ("ingested_at", "ordinal"),
) -> DataFrame:
    """``target`` (unique by ``keys``) after applying ``updates``.

    Of several updates of one key the last by ``seq`` sets the mutable columns, also where it is
    null; the immutable columns keep the target's values, or the first update's for a new key.

    Updates fold to one row per key with partial aggregation, so both sides of the join are unique
    and no key is hot there. A target bucketed by ``keys`` is joined where it lies.
    """
    order = F.struct(*seq)
    folded = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*mutable), order).alias("_latest"),
        F.min_by(F.struct(*immutable), order).alias("_first"),
    )
    stored = target.select(
        *keys, F.struct(*mutable).alias("_stored"), F.struct(*immutable).alias("_kept")
    )
    return stored.join(folded, list(keys), "full_outer").select(
        *keys,
        F.coalesce("_latest", "_stored").alias("_mutable"),
        F.coalesce("_kept", "_first").alias("_immutable"),
    ).select(*keys, "_mutable.*", "_immutable.*")


def mark_deleted(
    target: DataFrame, snapshot: DataFrame, keys: Sequence[str], as_of: dt.datetime
) -> DataFrame:
    """Target rows whose key a full snapshot no longer holds become ``deleted``; others stay."""
    present = snapshot.select(*keys).distinct().withColumn("_present", F.lit(True))
    gone = F.col("_present").isNull() & (F.col("status") != "deleted")
    at = F.lit(as_of).cast("timestamp")
    return target.join(present, list(keys), "left").select(
        *[
            F.when(gone, "deleted").otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(gone, at).otherwise(F.col(c)).alias(c)
            if c == "deleted_at"
            else F.col(c)
            for c in target.columns
        ]
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """Keys held by more than one row; empty for a sound table."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
