"""WARC archives: writing one record per page, and a salvage reader that goes on after damage.

Writing. Each record is a gzip member of its own. Pages with equal payloads are stored once: the one with the largest
id is a response, the others are revisit records that name it. Spark's text writer puts the members into files,
so any file system that Spark can write to will do: every member ends with a zero byte (the highest byte of a
length below 16 MiB, or an empty member after a larger record), and that byte is the writer's line separator.

Reading. ``read_archives`` walks through each file. A member must decompress with the right checksum and length; a record
must have a version line, a header that ends before the next version line, a block of the length it states, the two line
breaks behind it, and the digests it states. After a failed check the reader searches for the next gzip member that
begins with a record, or the next version line outside a member, that passes. The bytes in between are
reported as a row with ``status`` ``quarantined``, their range and the first reason; nothing is skipped silently. Plain
archives and mixtures of both forms are read in the same way.

An archive is read by one task, as one binary value, so archives should stay well below an executor's memory; the
writer makes files of at most ``RECORDS_PER_FILE`` records from one task's rows. A null payload counts as empty. A null
url leaves the target out, a null id the page id; null ids are smaller than any other, and all rows that hold
the largest id of their payload are responses. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

RECORDS_PER_FILE = 50_000
#: Where the end of a header is looked for first, before the next version line is.
USUAL_HEADER = 1 << 16
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
NEXT_VERSION = re.compile(rb"\r\nWARC/1\.[01]\r\n")
EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()
CHUNK = 1 << 14
#: Fixed: the profile of revisits with an identical payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header fields of this writer, beside those of the standard.
PAGE_ID, REFERS_TO = "X-Page-ID", "X-Refers-To-Page-ID"


def digest(data: bytes) -> str:
    """SHA-1 in base32, as in digest fields."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value without control characters, which would end the line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names the page that holds the payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    payload_digest = digest(payload)
    name = hashlib.md5(f"{page_id}\n{url}\n{payload_digest}".encode("utf-8", "surrogatepass")).hexdigest()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        lines.append(f"{PAGE_ID}: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"{REFERS_TO}: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends with a zero byte."""
    packer = zlib.compressobj(level, wbits=31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-02-01T00:00:00Z",
) -> None:
    """Write every page as a record into gzip archives below ``path``."""
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).alias("_url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("_payload"),
    )
    key = F.sha2("_payload", 256)
    # Payloads that occur once need no partner; only the others are joined.
    shared = written(
        rows.groupBy(key.alias("_key"))
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_copies"))
        .filter(F.col("_copies") > 1)
        .select("_key", "_keep"),
        "payloads",
    )
    refers_to = F.when(~F.col("_id").eqNullSafe(F.col("_keep")), F.col("_keep"))
    records = rows.withColumn("_key", key).join(shared, "_key", "left").select(
        "_id", "_url", "_payload", refers_to.alias("_refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(column.to_pylist() for column in batch.columns), strict=True)
            for start in range(0, batch.num_rows, 1_000):
                out = []
                for _, (page_id, url, payload, keep) in zip(range(start, min(start + 1_000, batch.num_rows)), columns):
                    # The writer's separator restores the last byte.
                    out.append(member(record(page_id, url, payload, keep, date))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    (
        records.mapInArrow(run, "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", "\x00")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


@dataclass
class Found:
    """A record, or with ``reason`` a range of bytes that no record could be read from."""

    offset: int
    length: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    stated_length: int | None = None


class Damaged(Exception):
    """A check failed; ``end`` is where the record ends if that is beyond doubt."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def _check_digest(headers: dict[str, str], name: str, data: bytes, end: int) -> None:
    kind, _, value = headers.get(name, "").partition(":")
    if kind.lower() == "sha1" and value != digest(data):
        raise Damaged(f"{name} differs", end)


def read_record(data: bytes, at: int) -> Found:
    """The record whose version line is at ``at``."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    close = data.find(b"\r\n\r\n", version.end() - 2, version.end() + USUAL_HEADER)
    if close < 0:
        following = NEXT_VERSION.search(data, version.end() - 2)
        close = data.find(b"\r\n\r\n", version.end() - 2, following.start() if following else len(data))
    if close < 0:
        raise Damaged("header without end")
    headers = {}
    for line in data[version.end() : close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damaged("header line without colon")
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", headers.get("Content-Length", "")):
        raise Damaged("no content length")
    start = close + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block without end")
    block, end = data[start:stop], stop + 4
    _check_digest(headers, "WARC-Block-Digest", block, end)
    found = Found(at, end - at, headers=headers, payload=block)
    if headers.get("Content-Type", "").startswith("application/http"):
        http, _, found.payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?i)^content-length:\s*(\d{1,18})\s*$", http, re.M)
        found.stated_length = int(stated[1]) if stated else None
    if headers.get("WARC-Type") != "revisit":
        _check_digest(headers, "WARC-Payload-Digest", found.payload, end)
    return found


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``."""
    unpacker, out, here = zlib.decompressobj(wbits=31), [], at
    try:
        # A chance hit on the magic number shows in the first bytes.
        head = unpacker.decompress(data[here : here + CHUNK], 5)
        if head and not b"WARC/".startswith(head[:5]):
            raise Damaged("member without a record")
        out.append(head)
        here += min(CHUNK, len(data) - here)
        while not unpacker.eof:
            if unpacker.unconsumed_tail:
                out.append(unpacker.decompress(unpacker.unconsumed_tail))
            elif here < len(data):
                out.append(unpacker.decompress(data[here : here + CHUNK]))
                here += CHUNK
            else:
                raise Damaged("member without end")
    except zlib.error as error:
        raise Damaged("member does not decompress") from error
    return b"".join(out), min(here, len(data)) - len(unpacker.unused_data)


def _before_damage(data: bytes, at: int) -> bytes:
    """What the member at ``at`` gives up to the byte at which it breaks off."""
    unpacker, out, size = zlib.decompressobj(wbits=31), [], 1024
    while at < len(data) and not unpacker.eof:
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(data[at : at + size]))
            at += size
        except zlib.error:
            if size == 1:
                break
            unpacker, size = before, 1
    return b"".join(out)


def _from_broken(data: bytes, at: int) -> list[Found]:
    """Records of a broken member that agree with their own block digest and end before the damage."""
    content = _before_damage(data, at)
    if not content.startswith(b"WARC/"):
        return []
    return [
        one
        for one in salvage(content, members=False)
        if not one.reason
        and one.offset + one.length < len(content)
        and one.headers.get("WARC-Block-Digest", "").lower().startswith("sha1:")
    ]


class _Starts:
    """Next possible start of a member or record; every byte is searched once."""

    def __init__(self, data: bytes, members: bool):
        self.data = data
        self.next = {needle: -1 for needle in ((MAGIC, b"WARC/1.") if members else (b"WARC/1.",))}

    def after(self, at: int) -> int:
        for needle, hit in self.next.items():
            if hit < at:
                hit = self.data.find(needle, at)
                self.next[needle] = len(self.data) if hit < 0 else hit
        return min(self.next.values())


def salvage(data: bytes, members: bool = True) -> Iterator[Found]:
    """All records that pass the checks, and the byte ranges between them that do not.

    Records of a member have its range. Those from the sound part of a broken member, taken only by their block digest,
    have its offset and the length 0, as its bytes belong to the gap that is reported.
    """
    starts, at, gap, reason = _Starts(data, members), 0, None, ""
    while at < len(data):
        try:
            if members and data.startswith(MAGIC, at):
                content, end = _inflate(data, at)
                inside = list(salvage(content, members=False))
                if content and all(one.reason for one in inside):
                    raise Damaged(inside[0].reason, end)
            else:
                inside = [read_record(data, at)]
                end = at + inside[0].length
        except Damaged as damage:
            if gap is None:
                gap, reason = at, damage.reason
            if members and damage.end is None and data.startswith(MAGIC, at):
                for one in _from_broken(data, at):
                    one.offset, one.length = at, 0
                    yield one
            at = damage.end if damage.end is not None else starts.after(at + 1)
            continue
        if gap is not None:
            yield Found(gap, at - gap, reason)
            gap = None
        for one in inside:
            one.offset, one.length = at, end - at
            yield one
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, reason)


RECORDS = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _row(archive: str, one: Found, with_payload: bool) -> tuple:
    kind = one.headers.get("WARC-Type")
    revisit = kind == "revisit"
    return (
        archive,
        one.offset,
        one.length,
        "quarantined" if one.reason else "record",
        one.reason,
        kind,
        list(one.headers.items()),
        None if one.reason else one.stated_length if revisit else len(one.payload),
        # A revisit states the digest of the payload that it refers to; others were checked against theirs.
        None if one.reason else one.headers.get("WARC-Payload-Digest", "").rpartition(":")[2] if revisit
        else digest(one.payload),
        one.payload if with_payload and not one.reason else None,
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record and per quarantined range of the archives at ``path``; see ``RECORDS``.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, of revisits too.
    """
    types = [
        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
        pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary(),
    ]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)], RECORDS.names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for one in salvage(batch[1][k].as_py()):
                    rows.append(_row(batch[0][k].as_py(), one, with_payload))
                    size += len(one.payload) if with_payload else 0
                    if len(rows) >= 5_000 or size > 1 << 24:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)
