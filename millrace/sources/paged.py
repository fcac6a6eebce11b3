"""A paged service as a Spark data source, for tables and for streams.

Register with ``spark.dataSource.register(PagedSource)`` and read with::

    spark.read.format("paged").option("transport", "package.module:function").option("fetch", "shop,stock").load()

The transport gets the page number and the options and returns the response body as text. It runs
on the executors; retries and waiting are its own affair. Pages are asked for one after the other until one is
terminal: without records, an object without a true ``has_next``, or a list shorter than ``page_size``. Every
page is fetched once and none after the terminal one. Each name in ``fetch`` is a service of its own, one partition,
and reaches the transport as the option ``fetch``. With ``last_page``, for a service that is known to have so many
pages, all of them are fetched in ranges of ``pages_per_task`` side by side.

The result is a table of landed pages, ``fetch, page, body, since``, for
:func:`millrace.sources.pages.unwrap_pages`, with ``stopped=True`` unless ``last_page`` is given. ``since`` is there to be filtered: a filter
``since > mark`` or ``since >= mark`` reaches the transport as the option ``since`` (ISO text), as one that asks
the service for newer records only. Spark demands that filters are pushed to a reader that takes them, so this is the
source ``paged_since`` (:class:`PagedSinceSource`), for sessions with ``spark.sql.python.filterPushdown.enabled``. With
``paged`` give the option yourself.

As a stream, ``spark.readStream.format("paged")``, the pages of a batch are fetched beside the driver, so the transport
must be installed there or be named by its file, ``/path/file.py:function``. The offset is the next page of every fetch and whether it has
ended. A batch fetches up to ``pages_per_batch`` pages of each; a batch that is repeated asks for the same pages again.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from importlib import import_module
from importlib.util import module_from_spec, spec_from_file_location

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    SimpleDataSourceStreamReader,
)

PAGE_SIZE = 100
PAGES_PER_BATCH = 100


class PageRange(InputPartition):
    """Pages of one fetch; without a last one, up to the terminal page."""

    def __init__(self, first: int, last: int | None, fetch: str = "fetch") -> None:
        self.first = first
        self.last = last
        self.fetch = fetch


def page_ranges(first: int, last: int, pages_per_task: int, fetch: str = "fetch") -> list[PageRange]:
    if pages_per_task < 1:
        raise ValueError("pages_per_task must be at least 1")
    return [
        PageRange(start, min(start + pages_per_task - 1, last), fetch)
        for start in range(first, last + 1, pages_per_task)
    ]


def is_terminal(body: str | None, page_size: int = PAGE_SIZE) -> bool:
    """Whether no page follows this one; text that is not JSON is an empty page."""

    def refuse(constant: str) -> None:
        raise ValueError(constant)

    try:
        parsed = json.loads(body or "", parse_constant=refuse)
    except ValueError:
        return True
    if isinstance(parsed, list):
        return len(parsed) < page_size
    if not isinstance(parsed, dict):
        return True
    listed = parsed.get("data") if parsed.get("data") is not None else parsed.get("results")
    return not (isinstance(listed, list) and listed) or not parsed.get("has_next")


def transport(name: str) -> Callable[[int, dict], str]:
    """The function that ``package.module:function`` or ``/path/file.py:function`` names."""
    module, _, function = name.rpartition(":")
    if not module.endswith(".py"):
        return getattr(import_module(module), function)
    spec = spec_from_file_location("paged_transport", module)
    loaded = module_from_spec(spec)
    spec.loader.exec_module(loaded)
    return getattr(loaded, function)


class _Pages:
    """Pages of a transport, by the options of a source."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.fetches = [name.strip() for name in self.options.get("fetch", "fetch").split(",")]
        self.first = int(self.options.get("first_page", 1))
        self.page_size = int(self.options.get("page_size", PAGE_SIZE))

    def since(self) -> dt.datetime | None:
        text = self.options.get("since")
        return dt.datetime.fromisoformat(text) if text else None

    def walk(self, fetch: str, first: int, last: int | None = None, stop: bool = True) -> Iterator[tuple[tuple, bool]]:
        """(row, terminal) of the pages from ``first`` to ``last`` or, with ``stop``, to the terminal one."""
        fetch_page = transport(self.options["transport"])
        options, page = {**self.options, "fetch": fetch}, first
        while last is None or page <= last:
            body = fetch_page(page, options)
            ends = is_terminal(body, self.page_size)
            yield (fetch, page, body, self.since()), ends
            if ends and stop:
                return
            page += 1


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pages = _Pages(options)

    def partitions(self) -> Sequence[InputPartition]:
        last, per_task = self.pages.options.get("last_page"), int(self.pages.options.get("pages_per_task", 1))
        if last is None:
            return [PageRange(self.pages.first, None, fetch) for fetch in self.pages.fetches]
        return [one for fetch in self.pages.fetches for one in page_ranges(self.pages.first, int(last), per_task, fetch)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        stop = partition.last is None
        for row, _ in self.pages.walk(partition.fetch, partition.first, partition.last, stop):
            yield row


class PagedSinceReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Lower bounds of ``since`` go to the transport, the greatest if there are several."""
        for one in filters:
            bound = isinstance(one, (GreaterThan, GreaterThanOrEqual)) and one.attribute == ("since",)
            if bound and isinstance(one.value, dt.datetime):
                asked = max(filter(None, (self.pages.since(), one.value.replace(tzinfo=None))))
                self.pages.options["since"] = asked.isoformat()
                continue
            if isinstance(one, EqualTo) and one.attribute == ("fetch",):
                self.pages.fetches = [name for name in self.pages.fetches if name == one.value]
            yield one


class PagedStreamReader(SimpleDataSourceStreamReader):
    """Offsets are the next page of every fetch, null behind its terminal page."""

    def __init__(self, options: dict) -> None:
        self.pages = _Pages(options)
        self.per_batch = int(self.pages.options.get("pages_per_batch", PAGES_PER_BATCH))

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.pages.fetches, self.pages.first)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for fetch, first in start.items():
            if first is None:
                continue
            for row, ends in self.pages.walk(fetch, first, first + self.per_batch - 1):
                rows.append(row)
                end[fetch] = None if ends else row[1] + 1
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for fetch, first in start.items():
            if first is not None:
                last = end[fetch] - 1 if end[fetch] is not None else None
                for row, _ in self.pages.walk(fetch, first, last):
                    yield row


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "fetch string, page bigint, body string, since timestamp"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.options)


class PagedSinceSource(PagedSource):
    """The same, with filters on ``since`` and ``fetch`` pushed to the transport."""

    @classmethod
    def name(cls) -> str:
        return "paged_since"

    def reader(self, schema) -> PagedSinceReader:
        return PagedSinceReader(self.options)
