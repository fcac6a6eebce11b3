"""Filtered, sorted and paged views of the unified items."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.parse import bind
from millrace.schemas import ITEM_STATUSES, PUBLIC_ITEM, SOURCE_TYPES

# Bounds and sort columns of the item query.
MAX_PAGE_SIZE = 1000
SORT_COLUMNS = ("created_at", "published_at", "title", "amount", "rating", "updated_at")


def _one_of(name: str, value: str | None, allowed: tuple[str, ...]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of: {', '.join(allowed)}")


def _check_page(page: int, size: int) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page size must be 1 to {MAX_PAGE_SIZE}")


def _pattern_parts(term: str) -> tuple[list[str], bool]:
    """Literal stretches of a search term between ``%``, and whether it has another wildcard.

    A backslash takes the character after it literally.
    """
    parts, has_single = [""], False
    chars = iter(term)
    for char in chars:
        if char == "\\":
            parts[-1] += next(chars, "\\")
        elif char == "%":
            parts.append("")
        else:
            has_single |= char == "_"
            parts[-1] += char
    return [p for p in parts if p], has_single


def _end_of(part: str) -> Callable[[Column], Column]:
    """Place after a part found at a 1-based position; null where it was not found."""
    return lambda found: F.when(found > 0, found + len(part))


def _holds_in_order(text: Column, parts: list[str]) -> Column:
    """True if the lower-case parts occur in the text one after the other; linear in the text."""
    position: Column = F.lit(1)
    for part in parts:
        position = bind(F.position(F.lit(part), text, position), _end_of(part))
    return position.isNotNull()


def search_condition(term: str, literal: bool = False) -> Column:
    """Case-insensitive substring of title or description.

    ``%`` and ``_`` in the term are wildcards unless ``literal`` is set.
    """
    parts, has_single = ([term], False) if literal else _pattern_parts(term)

    def matches(name: str) -> Column:
        if has_single:
            return F.col(name).ilike(f"%{term}%")
        return _holds_in_order(F.lower(name), [p.lower() for p in parts])

    return matches("title") | matches("description")


def item_query(
    items: DataFrame,
    *,
    source_type: str | None = None,
    source_name: str | None = None,
    category: str | None = None,
    status: str | None = None,
    search: str | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
    published_after: dt.datetime | None = None,
    published_before: dt.datetime | None = None,
    literal_search: bool = False,
) -> DataFrame:
    """Items that meet all given filters; ranges include their bounds and drop nulls."""
    _one_of("source_type", source_type, SOURCE_TYPES)
    _one_of("status", status, ITEM_STATUSES)
    for bound in (min_amount, max_amount):
        if bound is not None and not bound >= 0:
            raise ValueError("amounts must not be negative")
    equal = {
        "source_type": source_type,
        "source_name": source_name,
        "category": category,
        "status": status,
    }
    conditions = [F.col(c) == F.lit(v) for c, v in equal.items() if v]
    if search:
        conditions.append(search_condition(search, literal_search))
    if min_amount is not None:
        conditions.append(F.col("amount") >= F.lit(float(min_amount)))
    if max_amount is not None:
        conditions.append(F.col("amount") <= F.lit(float(max_amount)))
    if published_after is not None:
        conditions.append(F.col("published_at") >= F.lit(published_after))
    if published_before is not None:
        conditions.append(F.col("published_at") <= F.lit(published_before))
    return items.filter(reduce(Column.__and__, conditions)) if conditions else items


def filters_applied(**filters) -> dict:
    """The filters that were given, as echoed beside a page."""
    return {name: value for name, value in filters.items() if value is not None}


def public_items(items: DataFrame) -> DataFrame:
    return items.select(*[c for c in PUBLIC_ITEM if c in items.columns])


def _ordering(sort_by: str, sort_order: str) -> list[Column]:
    """Nulls sort as the largest value; ``id`` breaks ties so that pages are stable."""
    _one_of("sort_by", sort_by, SORT_COLUMNS)
    _one_of("sort_order", sort_order, ("asc", "desc"))
    column = F.col(sort_by)
    first = column.asc_nulls_last() if sort_order == "asc" else column.desc_nulls_first()
    return [first, F.col("id").asc()]


def item_page(
    items: DataFrame,
    page: int = 1,
    size: int = 50,
    sort_by: str = "created_at",
    sort_order: str = "desc",
) -> DataFrame:
    """One page by number. The scan keeps ``page * size`` rows per task, so go deep by keyset."""
    _check_page(page, size)
    ordered = items.orderBy(*_ordering(sort_by, sort_order.lower()))
    return ordered.offset((page - 1) * size).limit(size)


def keyset_page(
    items: DataFrame, after: tuple[dt.datetime, str] | None = None, size: int = 50
) -> DataFrame:
    """The page following the row with (created_at, id) ``after``, newest first, at any depth.

    ``created_at`` is set on every item, so unlike :func:`item_page` no null has to be placed.
    """
    _check_page(1, size)
    if after is not None:
        created_at, last_id = F.lit(after[0]), F.lit(after[1])
        items = items.filter(
            (F.col("created_at") <= created_at)
            & ((F.col("created_at") < created_at) | (F.col("id") > last_id))
        )
    return items.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(size)


def page_metadata(items: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """One row: counts and neighbours of a page over the filtered items."""
    _check_page(page, size)
    pages = F.ceil(F.col("total_items") / F.lit(size)).cast("bigint")
    return (
        items.agg(F.count("*").alias("total_items"))
        .select(
            "total_items",
            pages.alias("total_pages"),
            F.lit(page).alias("current_page"),
            F.lit(size).alias("page_size"),
        )
        .select(
            "*",
            (F.col("current_page") < F.col("total_pages")).alias("has_next"),
            (F.col("current_page") > 1).alias("has_previous"),
        )
    )


