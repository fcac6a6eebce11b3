"""Acceptance rules, the split into items and rejects, and the outcome of a run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.landing import stable_id
from millrace.schemas import (
    ITEM_KEYS,
    ITEM_STATUSES,
    ITEMS,
    MAX_QUANTITY,
    MAX_RATING,
    REJECTS,
    SOURCE_TYPES,
    TEXT_LIMITS,
)

_UNMAPPED = ("unknown_source_type", "payload_not_object")


def _rules() -> list[tuple[str, Column]]:
    """Error code and the condition that raises it. A null condition does not raise."""
    amount, rating = F.col("amount"), F.col("rating")
    number, title = F.col("quantity_number"), F.col("title_as_given")
    external_id, source_name = F.col("external_id"), F.col("source_name")
    has_type_error = F.array_contains("map_errors", "title_not_text")
    return [
        ("source_type_invalid", ~F.col("source_type").isin(*SOURCE_TYPES)),
        ("status_invalid", ~F.col("status").isin(*ITEM_STATUSES)),
        ("source_name_missing", source_name.isNull() | (source_name == "")),
        ("external_id_missing", external_id.isNull() | (external_id == "")),
        ("title_missing", (title.isNull() & ~has_type_error) | (title == "")),
        ("title_blank", (title != "") & (F.col("title") == "")),
        ("title_too_long", F.length(title) > TEXT_LIMITS["title"]),
        *[
            (f"{name}_too_long", F.length(name) > limit)
            for name, limit in TEXT_LIMITS.items()
            if name != "title"
        ],
        ("amount_out_of_range", F.isnan(amount) | (amount < 0)),
        # The truncated quantity decides, so -0.5 passes as 0; infinity has no truncation.
        (
            "quantity_out_of_range",
            ~F.isnan(number) & ((number <= -1) | (number >= MAX_QUANTITY + 1)),
        ),
        ("rating_out_of_range", F.isnan(rating) | (rating < 0) | (rating > MAX_RATING)),
    ]


def validate(items: DataFrame) -> DataFrame:
    """Normalised rows with ``errors``, the list of every broken rule; empty means accepted."""
    broken = F.array_compact(F.array(*[F.when(condition, code) for code, condition in _rules()]))
    unmapped = F.arrays_overlap("map_errors", F.array(*[F.lit(code) for code in _UNMAPPED]))
    return items.withColumn(
        "errors",
        F.when(unmapped, F.col("map_errors")).otherwise(F.concat("map_errors", broken)),
    )


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)``, evaluated after the columns it reads and not instead of them.

    A plain filter on a computed column is rewritten to compute that column a second time below
    the projection. The row number, which cannot be moved that way, keeps the two in order.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.filter(condition & (F.col("_row") >= 0)).drop("_row")


def accepted(validated: DataFrame) -> DataFrame:
    """Accepted rows in the item schema, with their ``ingested_at`` and ``ordinal``."""
    key = [F.col(k) for k in ITEM_KEYS]
    hex32 = stable_id(*key)
    derived = {
        "id": hex32,
        "uuid": F.concat_ws(
            "-",
            hex32.substr(1, 8), hex32.substr(9, 4), hex32.substr(13, 4), hex32.substr(17, 4),
            hex32.substr(21, 12),
        ),
        "created_at": F.col("ingested_at"),
        "updated_at": F.col("ingested_at"),
        "deleted_at": F.lit(None),
    }
    return keep_where(validated, F.size("errors") == 0).select(
        *[
            derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in ITEMS.fields
        ],
        "ingested_at",
        "ordinal",
    )


def rejected(validated: DataFrame, as_of: dt.datetime | Column) -> DataFrame:
    """Rejected rows as structured error records."""
    values = {
        "phase": F.lit("normalization"),
        "error_class": F.lit("ValidationError"),
        "message": F.array_join("errors", "; "),
        "context": F.create_map(
            F.lit("source_type"), F.col("source_type"),
            F.lit("source_name"), F.col("source_name"),
            F.lit("external_id"), F.col("external_id"),
        ),
        "at": as_of if isinstance(as_of, Column) else F.lit(as_of),
        "cause": F.lit(None),
    }
    return keep_where(validated, F.size("errors") > 0).select(
        *[
            values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in REJECTS.fields
        ]
    )


def split(validated: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of one validated set."""
    return accepted(validated), rejected(validated, as_of)


def run_outcome(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and status per ``keys``: success without rejects, else partial.

    ``records_loaded`` counts every accepted row, also several of one item; the number of
    different items is ``distinct_keys_loaded``.
    """
    ok = F.size("errors") == 0
    # Items first: a hot source then contributes one row per item, not one per record.
    per_item = validated.groupBy(*keys, "external_id").agg(
        F.count("*").alias("_n"), F.count_if(ok).alias("_ok")
    )
    counts = per_item.groupBy(*keys).agg(
        F.sum("_n").alias("records_extracted"),
        F.sum("_ok").alias("records_loaded"),
        F.sum(F.col("_n") - F.col("_ok")).alias("records_failed"),
        F.count_if(F.col("_ok") > 0).alias("distinct_keys_loaded"),
    )
    return counts.withColumn(
        "status", F.when(F.col("records_failed") == 0, "success").otherwise("partial")
    )


def reject_reasons(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each rule was broken, per ``keys``."""
    return (
        keep_where(validated, F.size("errors") > 0)
        .select(*keys, F.explode("errors").alias("error"))
        .groupBy(*keys, "error")
        .agg(F.count("*").alias("records"))
    )


def reject_attempts(rejects: DataFrame) -> DataFrame:
    """How often each raw row was rejected, by which runs first and last, and why the last time."""
    when = F.struct("at", "etl_run_id")
    return rejects.groupBy("source_type", "source_name", "raw_data_id").agg(
        F.count("*").alias("attempts"),
        F.min_by("etl_run_id", when).alias("first_run_id"),
        F.max_by("etl_run_id", when).alias("last_run_id"),
        F.max_by("message", when).alias("message"),
    )
