"""Landing of source records, content deduplication and the backlog of unprocessed rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.payload import as_record
from millrace.schemas import RAW
from millrace.sources.spec import SourceSpec


def stable_id(*parts: Column) -> Column:
    """32 hex digits that depend only on the parts, so a replay gives the same id."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def land(records: DataFrame, spec: SourceSpec, run_id: str, as_of: dt.datetime) -> DataFrame:
    """Records (``payload``, ``ordinal``) of one source as raw rows of one run."""
    ordinal = F.col("ordinal")
    raw = {
        "raw_id": stable_id(
            F.lit(spec.kind), F.lit(spec.name), F.lit(run_id),
            ordinal["part"], ordinal["block"], ordinal["pos"],
        ),
        "source_type": F.lit(spec.kind),
        "source_name": F.lit(spec.name),
        "source_id": spec.id_of(F.col("_record")),
        "event_time": spec.time_of(F.col("_record")),
        "raw_payload": F.col("payload"),
        "raw_text": F.lit(None).cast("string"),
        "ingested_at": F.lit(as_of).cast("timestamp"),
        "file_path": ordinal["part"],
        "content_hash": F.sha2("payload", 256),
        "etl_run_id": F.lit(run_id),
        "ordinal": ordinal,
    }
    parsed = records.select("payload", "ordinal", as_record(F.col("payload")).alias("_record"))
    return parsed.select(*[raw[f.name].cast(f.dataType).alias(f.name) for f in RAW.fields])


def dedup_content(
    raw: DataFrame, keys: Sequence[str], payload: str, seq: Sequence[str]
) -> DataFrame:
    """The first row, by ``seq``, of every distinct payload within ``keys``.

    Copies collapse before the shuffle, so a payload copied into a third of all rows costs one row
    per map task. Grouping is on the payload's SHA-256, kept as ``content_hash``.
    """
    hashed = raw.withColumn("content_hash", F.sha2(F.col(payload), 256))
    group = [*keys, "content_hash"]
    rest = [c for c in hashed.columns if c not in group]
    first = hashed.groupBy(*group).agg(
        F.min_by(F.struct(*rest), F.struct(*seq)).alias("_first"),
        F.count("*").alias("copies"),
    )
    return first.select(*group, "_first.*", "copies")


def unprocessed(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Raw rows without an entry in the processed log; rejected rows come back until they pass."""
    return raw.join(processed.select("raw_id"), "raw_id", "left_anti")


def backlog(raw: DataFrame, processed: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Unprocessed rows per source: how many, the oldest, and its age in seconds."""
    oldest = F.min("ingested_at")
    return (
        unprocessed(raw, processed)
        .groupBy("source_type", "source_name")
        .agg(F.count("*").alias("pending"), oldest.alias("oldest_ingested_at"))
        .withColumn(
            "oldest_age_seconds",
            F.timestamp_diff("SECOND", F.col("oldest_ingested_at"), F.lit(as_of).cast("timestamp")),
        )
    )
