"""Join of many rows to a table holding at most one row per key, where one key may own most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_lookup(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``facts`` to ``lookup``, which is unique by ``keys``; null keys are equal.

    A plain join: Spark broadcasts a lookup below its byte threshold, and beyond that splits the
    partition of a hot key when it sees it. Nothing is computed while the plan is built.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup join: {how}")
    named = lookup.withColumnsRenamed({k: f"_lookup_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_lookup_{k}")) for k in keys])
    return facts.join(named, same, how).drop(*[f"_lookup_{k}" for k in keys])
