"""Table schemas and allowed value sets.

The enum members, column limits and default texts are fixed values: they decide which rows are
accepted, so they have to be exactly these.
"""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE_TYPES = ("api", "csv", "rss", "feed")
RUN_STATUSES = ("pending", "running", "success", "failed", "partial")
ITEM_STATUSES = ("active", "inactive", "deleted", "pending")

# Longest accepted text per unified column, in characters.
TEXT_LIMITS = {
    "source_name": 100,
    "external_id": 255,
    "title": 500,
    "category": 200,
    "url": 2048,
    "image_url": 2048,
    "author": 200,
}

MAX_QUANTITY = 2**31 - 1
MAX_RATING = 5.0

# Position of a record inside its source: file or fetch, then block or page, then row.
ORDINAL = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("pos", T.LongType()),
    ]
)

RAW = T.StructType(
    [
        T.StructField("raw_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("etl_run_id", T.StringType()),
        T.StructField("ordinal", ORDINAL),
    ]
)

ITEM_KEYS = ("source_type", "source_name", "external_id")

# Replaced when a key is seen again.
ITEM_MUTABLE = (
    "title",
    "description",
    "category",
    "url",
    "image_url",
    "author",
    "amount",
    "quantity",
    "rating",
    "tags",
    "metadata",
    "status",
    "published_at",
    "updated_at",
    "etl_run_id",
)

# Kept from the first time a key was seen.
ITEM_IMMUTABLE = ("id", "uuid", "raw_data_id", "created_at", "deleted_at")

ITEMS = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("status", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("etl_run_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("raw_data_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
    ]
)

# Columns of the public item shape; raw_data_id, etl_run_id and deleted_at stay internal.
PUBLIC_ITEM = (
    "id",
    "uuid",
    "source_type",
    "source_name",
    "external_id",
    "title",
    "description",
    "category",
    "url",
    "image_url",
    "author",
    "amount",
    "quantity",
    "rating",
    "tags",
    "metadata",
    "status",
    "published_at",
    "created_at",
    "updated_at",
)

# One row per run event. event_seq: 0 started, 1 landed, 2 finished.
LEDGER = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("event_seq", T.IntegerType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("records_extracted", T.LongType()),
        T.StructField("records_loaded", T.LongType()),
        T.StructField("records_failed", T.LongType()),
        T.StructField("checkpoint_type", T.StringType()),
        T.StructField("checkpoint_before", T.StringType()),
        T.StructField("checkpoint_after", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

PROCESSED = T.StructType(
    [
        T.StructField("raw_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

REJECTS = T.StructType(
    [
        T.StructField("phase", T.StringType()),
        T.StructField("raw_data_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("at", T.TimestampType()),
        T.StructField("cause", T.StringType()),
        T.StructField("etl_run_id", T.StringType()),
    ]
)
