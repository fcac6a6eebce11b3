"""Landed REST response pages as records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.payload import is_truthy
from millrace.operators.lookup import join_lookup
from millrace.session import durable

PAGE_SIZE = 100


def _page_records(body: Column) -> Column:
    """The record list of a response: the body itself, or its ``data`` if present, else ``results``."""
    fields = body.try_cast("map<string,variant>")
    listed = F.coalesce(fields["data"], fields["results"])
    return F.coalesce(
        body.try_cast("array<variant>"),
        listed.try_cast("array<variant>"),
        F.array().cast("array<variant>"),
    )


def unwrap_pages(
    pages: DataFrame,
    fetch_keys: Sequence[str],
    page_col: str = "page",
    body_col: str = "body",
    page_size: int = PAGE_SIZE,
    stopped: bool = False,
) -> DataFrame:
    """One row per record: the fetch keys, the page, the position in it and the JSON ``payload``.

    Pages after the first terminal one of a fetch are not part of it. A page is terminal when it
    has no records, when it is an object without a true ``has_next``, or when it is a list shorter
    than ``page_size``. Text that is not JSON is an empty page. ``stopped`` tells that whoever fetched the pages
    stopped at the terminal one, so each is parsed once and nothing is compared; it works on streams too.
    """
    fetch_keys = list(fetch_keys)
    bodies = pages.select(
        *fetch_keys, F.col(page_col).cast("bigint").alias(page_col),
        F.try_parse_json(F.col(body_col)).alias("_body"),
    )
    if stopped:
        # Exploded as an expression: from a column Spark infers a filter on its size, and parses each body for that too.
        return _records_of(bodies, _page_records(F.col("_body")), fetch_keys, page_col)
    parsed = bodies.select(
        *fetch_keys,
        page_col,
        _page_records(F.col("_body")).alias("_records"),
        F.col("_body").try_cast("array<variant>").isNotNull().alias("_is_list"),
        F.coalesce(
            is_truthy(F.col("_body").try_cast("map<string,variant>")["has_next"]), F.lit(False)
        ).alias("_has_next"),
    )
    size = F.size("_records")
    terminal = (size == 0) | F.when(F.col("_is_list"), size < page_size).otherwise(
        ~F.col("_has_next")
    )
    last_pages = durable(
        parsed.groupBy(*fetch_keys).agg(F.min(F.when(terminal, F.col(page_col))).alias("_last"))
    )
    joined = join_lookup(parsed, last_pages, fetch_keys)
    return _records_of(
        joined.filter(F.col("_last").isNull() | (F.col(page_col) <= F.col("_last"))), F.col("_records"), fetch_keys,
        page_col,
    )


def _records_of(parsed: DataFrame, records: Column, fetch_keys: list[str], page_col: str) -> DataFrame:
    return (
        parsed.select(*fetch_keys, page_col, F.posexplode(records).alias("pos", "_record"))
        .select(
            *fetch_keys,
            page_col,
            F.col("pos").cast("bigint").alias("pos"),
            F.to_json("_record").alias("payload"),
        )
    )


def page_records(unwrapped: DataFrame, fetch_key: str, page_col: str = "page") -> DataFrame:
    """Unwrapped pages in the form the landing step takes."""
    return unwrapped.select(
        "payload",
        F.struct(
            F.col(fetch_key).cast("string").alias("part"),
            F.col(page_col).alias("block"),
            F.col("pos"),
        ).alias("ordinal"),
    )
