"""Description of a source: where its records' identity and event time are, and how its mark moves."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.parse import parse_ts
from millrace.functions.payload import first_present, text_of
from millrace.schemas import SOURCE_TYPES

MARK_KINDS = ("timestamp", "id", "page", "offset")
ID_ORDERS = ("string", "numeric")


@dataclass(frozen=True)
class FieldMapping:
    """Candidate keys per unified column, in order of preference.

    ``tags_rule``: ``list`` takes tags only from a JSON list, ``keywords`` takes the first truthy
    candidate if it is comma text, ``any`` accepts either form. ``excluded`` keys are left out of
    the metadata; ``ensured`` keys are put there with empty text when the record lacks them.
    """

    external_id: tuple[str, ...]
    title: tuple[str, ...]
    description: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    url: tuple[str, ...] = ()
    image_url: tuple[str, ...] = ()
    author: tuple[str, ...] = ()
    amount: tuple[str, ...] = ()
    quantity: tuple[str, ...] = ()
    rating: tuple[str, ...] = ()
    published_at: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("tags",)
    tags_rule: str = "any"
    excluded: tuple[str, ...] = ()
    ensured: tuple[str, ...] = ()


# Which record keys feed which unified column, per source kind.
KIND_MAPPINGS = {
    "api": FieldMapping(
        external_id=("id", "item_id"),
        title=("name", "title"),
        description=("description",),
        category=("category",),
        url=("url",),
        image_url=("image_url", "thumbnail"),
        author=("author",),
        amount=("price", "cost"),
        quantity=("quantity", "stock"),
        rating=("rating",),
        published_at=("created_date", "created_at"),
        tags_rule="list",
        excluded=("id", "name", "title", "description", "category"),
    ),
    "csv": FieldMapping(
        external_id=("id", "row_id"),
        title=("product_name", "name", "title"),
        description=("details", "description"),
        category=("category",),
        url=("url", "link"),
        amount=("cost", "price"),
        quantity=("quantity", "qty"),
        published_at=("date", "created_at"),
        tags=("keywords", "tags"),
        tags_rule="keywords",
        excluded=("id", "row_id", "product_name", "name", "details", "category"),
    ),
    "rss": FieldMapping(
        external_id=("id", "guid"),
        title=("title",),
        description=("summary", "description"),
        category=("category",),
        url=("link",),
        author=("author",),
        published_at=("published",),
        excluded=("id", "title", "summary", "link"),
        ensured=("content",),
    ),
}


@dataclass(frozen=True)
class SourceSpec:
    """One configured source.

    ``reader`` returns records with a ``payload`` (JSON text) and an ``ordinal`` column. It is called with
    the session and, if it takes a second argument, with the source's mark (text, or null), so that it
    can ask the service or filter the scan for newer records only. Override
    ``record_id`` or ``event_time`` with a function from the record map to a Column.
    """

    kind: str
    name: str
    reader: Callable[..., DataFrame] | None = None
    id_field: str = "id"
    time_field: str | None = None
    mark_kind: str = "timestamp"
    id_order: str = "string"
    record_id: Callable[[Column], Column] | None = None
    event_time: Callable[[Column], Column] | None = None
    mapping: FieldMapping | None = field(default=None)

    def __post_init__(self) -> None:
        if self.kind not in SOURCE_TYPES:
            raise ValueError(f"unknown source kind: {self.kind}")
        if not 1 <= len(self.name) <= 100:
            raise ValueError("source name must have 1 to 100 characters")
        if self.mark_kind not in MARK_KINDS:
            raise ValueError(f"unknown mark kind: {self.mark_kind}")
        if self.id_order not in ID_ORDERS:
            raise ValueError(f"unknown id order: {self.id_order}")

    def read(self, spark: SparkSession, mark: str | None = None) -> DataFrame:
        takes_mark = len(inspect.signature(self.reader).parameters) > 1
        return self.reader(spark, mark) if takes_mark else self.reader(spark)

    @property
    def keep_undated(self) -> bool:
        """Feed entries without a date are never older than the mark."""
        return self.kind == "rss"

    def id_of(self, record: Column) -> Column:
        """Record id as text, empty when absent; feeds fall back to the link."""
        if self.record_id is not None:
            return self.record_id(record)
        keys = (self.id_field, "link") if self.kind == "rss" else (self.id_field,)
        return F.coalesce(text_of(first_present(record, *keys)), F.lit(""))

    def time_of(self, record: Column) -> Column:
        """Event time of a record; null when the source has none or it cannot be parsed."""
        if self.event_time is not None:
            return self.event_time(record)
        time_field = self.time_field or {"api": "created_at", "rss": "published"}.get(self.kind)
        if time_field is None:
            return F.lit(None).cast("timestamp")
        return parse_ts(record[time_field].cast("string"))
