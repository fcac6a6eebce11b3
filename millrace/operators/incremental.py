"""High-water marks: which records are new, and where the mark moves."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.parse import parse_ts
from millrace.operators.lookup import join_lookup

# Up to this many sources the marks become literals in the filter, which reaches the file scan; with more
# the records are joined to the marks. Both keep the same rows.
MAX_LITERAL_MARKS = 64


def _is_numeric(kind: str, id_order: str) -> bool:
    return kind in ("page", "offset") or (kind == "id" and id_order == "numeric")


def _comparable(c: Column, kind: str, id_order: str) -> Column:
    if kind == "timestamp":
        return c
    return c.try_cast("decimal(38,0)") if _is_numeric(kind, id_order) else c.cast("string")


def _mark_value(mark: Column, kind: str, id_order: str) -> Column:
    return parse_ts(mark) if kind == "timestamp" else _comparable(mark, kind, id_order)


def _newer(value: Column, comparable: Column, bound: Column, keep_null: bool) -> Column:
    """Whether a value is beyond a bound that is not null; never null."""
    return F.coalesce(comparable > bound, F.lit(keep_null) & value.isNull())


def after_mark(
    value: Column, mark: Column, kind: str, id_order: str = "string", keep_null: bool = False
) -> Column:
    """True for values strictly after the mark (text).

    No mark, an empty one or one that does not parse keeps everything. A null value is kept only
    with ``keep_null``, a value that does not parse never. Ids compare as text or, with ``id_order="numeric"`` and for page and offset
    marks, as numbers.
    """
    bound = _mark_value(mark, kind, id_order)
    return bound.isNull() | _newer(value, _comparable(value, kind, id_order), bound, keep_null)


def _literal_filter(
    keys: Sequence[str], marks: list, value: Column, dtype: T.DataType, kind: str, id_order: str,
    keep_null: bool,
) -> Column:
    """One comparison with literals per source; sources without a mark pass whole.

    Where the column already compares the right way it stays bare, so the scan can prune by it.
    """
    bare = isinstance(dtype, (T.LongType, T.IntegerType)) and _is_numeric(kind, id_order)
    left = value if bare else _comparable(value, kind, id_order)
    branches, listed = [], []
    for row in marks:
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys])
        listed.append(same)
        if row["_bound"] is None:
            branches.append(same)
            continue
        bound = F.lit(row["_bound"])
        if isinstance(dtype, T.TimestampNTZType):
            bound = bound.cast(dtype)
        newer = left > bound
        if keep_null:
            newer = newer | value.isNull()
        branches.append(same & newer)
    if not listed:
        return F.lit(True)
    return reduce(Column.__or__, [*branches, ~reduce(Column.__or__, listed)])


def incremental(
    records: DataFrame,
    checkpoints: DataFrame,
    keys: Sequence[str],
    value_col: str,
    kind: str = "timestamp",
    id_order: str = "string",
    keep_null: bool = False,
    max_literal_marks: int = MAX_LITERAL_MARKS,
) -> DataFrame:
    """Records of all sources that are newer than their source's ``checkpoint_value``.

    ``checkpoints`` holds one row per source and is small; a source without a row loads in full.
    With few sources the marks turn into literal predicates that the scan can prune by, without a
    join. With many, the records are joined to the marks.
    """
    keys = list(keys)
    marks = checkpoints.select(
        *keys, _mark_value(F.col("checkpoint_value"), kind, id_order).alias("_bound")
    )
    few = marks.limit(max_literal_marks + 1).collect()
    value = F.col(value_col)
    if len(few) <= max_literal_marks:
        return records.filter(
            _literal_filter(keys, few, value, records.schema[value_col].dataType, kind, id_order, keep_null)
        )
    joined = join_lookup(records, marks, keys)
    newer = _newer(value, _comparable(value, kind, id_order), F.col("_bound"), keep_null)
    return joined.filter(F.col("_bound").isNull() | newer).drop("_bound")


def next_marks(
    records: DataFrame,
    checkpoints: DataFrame,
    keys: Sequence[str],
    value_col: str,
    kind: str,
    as_of: dt.datetime,
    id_order: str = "string",
) -> DataFrame:
    """Mark per source after these records: ``checkpoint_value`` (text) and ``records_extracted``.

    The mark is the greatest value; records without any usable value give ``as_of``. Sources
    without new records keep their mark and appear with 0.
    """
    keys = list(keys)
    greatest = F.max(_comparable(F.col(value_col), kind, id_order))
    new = records.groupBy(*keys).agg(
        greatest.alias("_greatest"), F.count("*").alias("records_extracted")
    )
    now = F.lit(as_of.isoformat())
    text = iso_text(F.col("_greatest")) if kind == "timestamp" else F.col("_greatest").cast("string")
    moved = new.select(*keys, F.coalesce(text, now).alias("_new_mark"), "records_extracted")
    return (
        checkpoints.select(*keys, "checkpoint_value")
        .join(moved, keys, "full_outer")
        .select(
            *keys,
            F.coalesce("_new_mark", "checkpoint_value").alias("checkpoint_value"),
            F.coalesce("records_extracted", F.lit(0).cast("bigint")).alias("records_extracted"),
        )
    )


def iso_text(ts: Column) -> Column:
    """ISO-8601 text with microseconds only where there are any."""
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
