"""Mapping of raw records of every source kind to the unified item columns, in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.parse import parse_ts, split_tags, strip, truncate_to_long
from millrace.functions.payload import (
    as_record,
    clean_tags,
    first_present,
    first_truthy,
    float_from,
    kind_of,
    residual,
    text_from,
    text_if_text,
)
from millrace.sources.spec import KIND_MAPPINGS, FieldMapping

_TEXT_TARGETS = ("title", "description", "category", "url", "image_url", "author")
# JSON text used when a record has none of the candidate keys.
_DEFAULTS = {"external_id": '""', "title": '"Untitled"', "description": '""'}


def _choose(routes: list[tuple[Column, FieldMapping]], build) -> Column:
    """CASE over the routes; ``build`` gives the branch of one mapping."""
    (condition, mapping), *rest = routes
    chosen = F.when(condition, build(mapping))
    for condition, mapping in rest:
        chosen = chosen.when(condition, build(mapping))
    return chosen


def _tags(record: Column, mapping: FieldMapping) -> Column:
    if mapping.tags_rule == "keywords":
        chosen = first_truthy(*[record[k] for k in mapping.tags])
        return split_tags(text_if_text(chosen.cast("string"), kind_of(chosen)))
    found = first_present(record, *mapping.tags)
    if mapping.tags_rule == "list":
        found = F.when(found.try_cast("array<variant>").isNotNull(), found)
    return clean_tags(found)


def _metadata(record: Column, mapping: FieldMapping) -> Column:
    rest = residual(record, mapping.excluded)
    for key in mapping.ensured:
        with_default = F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.lit('""'))))
        rest = F.when(F.map_contains_key(record, key), rest).otherwise(with_default)
    return rest


_NUMBERS = ("amount", "quantity", "rating")
_TARGETS = ("external_id", *_TEXT_TARGETS, *_NUMBERS, "published_at")
_CARRIED = ("source_type", "source_name", "ingested_at", "etl_run_id", "ordinal")
_UNCHANGED = (
    "raw_data_id", *_CARRIED, "external_id", *_TEXT_TARGETS[1:], "amount", "quantity_number", "rating",
    "published_at", "map_errors",
)


@lru_cache(maxsize=64)
def _steps(
    application: str,
    mappings: tuple[tuple[str, FieldMapping], ...],
    overrides: tuple[tuple[tuple[str, str], FieldMapping], ...],
) -> list[list]:
    """The select lists of the mapping, one after the other.

    Each step's columns are used several times by the next, so each is worked out only once. The
    lists are kept per application, as a stream maps every micro-batch in the same way.
    """
    kind, name = F.col("source_type"), F.col("source_name")
    routes = [((kind == k) & (name == n), mapping) for (k, n), mapping in overrides]
    routes += [(kind == k, mapping) for k, mapping in mappings]

    def picked(target: str) -> Column:
        return _choose(
            routes,
            lambda m: first_present(
                F.col("_record"), *getattr(m, target), default=_DEFAULTS.get(target)
            ),
        )

    def text_and(part: str, target: str) -> tuple[Column, Column]:
        return F.col(f"_{target}_text"), F.col(f"_{target}{part}")

    parsed = ["raw_id", *_CARRIED, as_record(F.col("raw_payload")).alias("_record")]
    found = ["raw_id", *_CARRIED, "_record", *[picked(t).alias(f"_{t}") for t in _TARGETS]]
    read = [
        "raw_id",
        *_CARRIED,
        "_record",
        *[f"_{t}" for t in ("external_id", *_NUMBERS)],
        *[F.col(f"_{t}").cast("string").alias(f"_{t}_text") for t in _TARGETS],
        *[kind_of(F.col(f"_{t}")).alias(f"_{t}_kind") for t in _TEXT_TARGETS],
    ]
    problems = F.array(
        F.when(~reduce(Column.__or__, [c for c, _ in routes]), "unknown_source_type"),
        F.when(F.col("_record").isNull(), "payload_not_object"),
        *[
            F.when(~F.col(f"_{t}_kind").isin("STRING", "VOID"), f"{t}_not_text")
            for t in _TEXT_TARGETS
        ],
    )
    typed = [
        F.col("raw_id").alias("raw_data_id"),
        *_CARRIED,
        text_from(*text_and("", "external_id")).alias("external_id"),
        *[text_if_text(*text_and("_kind", t)).alias(t) for t in _TEXT_TARGETS],
        float_from(*text_and("", "amount")).alias("amount"),
        float_from(*text_and("", "quantity")).alias("quantity_number"),
        float_from(*text_and("", "rating")).alias("rating"),
        _choose(routes, lambda m: _tags(F.col("_record"), m)).alias("tags"),
        _choose(routes, lambda m: _metadata(F.col("_record"), m)).alias("metadata"),
        parse_ts(F.col("_published_at_text")).alias("published_at"),
        F.array_compact(problems).alias("map_errors"),
    ]
    cleaned = [
        *_UNCHANGED,
        F.col("title").alias("title_as_given"),
        strip(F.col("title")).alias("title"),
        truncate_to_long(F.col("quantity_number")).alias("quantity"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("metadata", F.create_map().cast("map<string,variant>")).alias("metadata"),
        F.lit("active").alias("status"),
    ]
    return [parsed, found, read, typed, cleaned]


def normalize(
    raw: DataFrame,
    mappings: Mapping[str, FieldMapping] = KIND_MAPPINGS,
    overrides: Mapping[tuple[str, str], FieldMapping] | None = None,
) -> DataFrame:
    """Raw rows to unified columns.

    ``overrides`` maps (source_type, source_name) to a mapping that replaces the kind's one.
    ``map_errors`` lists the fields that cannot be mapped and ``quantity_number`` keeps the
    quantity before truncation; :func:`millrace.operators.validate.validate` reads both.
    """
    steps = _steps(
        raw.sparkSession.sparkContext.applicationId,
        tuple(mappings.items()),
        tuple((overrides or {}).items()),
    )
    return reduce(lambda df, columns: df.select(*columns), steps, raw)
