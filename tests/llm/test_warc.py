import base64
import gzip
import hashlib
import random

import pytest

from millrace.llm import warc
from millrace.llm.queries import op1_warc
from millrace.llm.warc import member, read_archives, record, salvage, write_archives

DATE = "2024-02-01T00:00:00Z"


def records(n, size=200):
    draw = random.Random(n)
    return [record(i, f"http://h/{i}", draw.randbytes(size), None, DATE) for i in range(n)]


def told(data):
    return [(one.headers.get("X-Page-ID"), one.offset, one.length, one.reason is None) for one in salvage(data)]


@pytest.mark.parametrize("pack", [member, gzip.compress, lambda data: data])
def test_intact_archives(pack):
    parts = [pack(r) for r in records(5)]
    assert [t[0] for t in told(b"".join(parts))] == list("01234")
    assert all(t[3] for t in told(b"".join(parts))) and told(b"") == []


@pytest.mark.parametrize("pack", [member, lambda data: data])
@pytest.mark.parametrize("damage", ["flip", "cut", "length", "junk", "tail"])
def test_records_after_damage_are_recovered_and_gaps_are_told(pack, damage):
    parts = [pack(r) for r in records(6)]
    bad = parts[2]
    if damage == "flip":
        bad = bad[:-40] + bytes([bad[-40] ^ 0xFF]) + bad[-39:]
    elif damage == "cut":
        bad = bad[: len(bad) // 2]
    elif damage == "length":
        bad = pack(records(6)[2].replace(b"Content-Length: 2", b"Content-Length: 9"))
    elif damage == "junk":
        bad = b"WARC/1.1\r\nnonsense\x1f\x8b\x08more"
    else:
        parts, bad = parts[:3], parts[2][:-7]
    parts[2] = bad
    found = told(b"".join(parts))
    good = [t for t in found if t[3]]
    assert [t[0] for t in good] == [str(i) for i in range(len(parts)) if i != 2]
    (gap,) = [t for t in found if not t[3]]
    assert gap[1:3] == (len(parts[0]) + len(parts[1]), len(bad))
    # Every byte is in a record or in a gap.
    assert sum(t[2] for t in found) == sum(map(len, parts))


def test_mixed_forms_and_a_record_inside_a_payload():
    inner = record(77, "http://inner/", b"x", None, DATE)
    outer = record(1, "http://outer/", b"before " + inner, None, DATE)
    data = member(outer) + outer + member(record(2, None, b"", None, DATE))
    assert [t[0] for t in told(data)] == ["1", "1", "2"]


def test_members_end_with_a_zero_byte(monkeypatch):
    assert member(b"x" * 1000)[-1] == 0
    big = b"y" * (1 << 24)
    assert gzip.decompress(member(big)) == big and member(big)[-1] == 0


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [
        (1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (None, "n", "same"),
        (5, "v", "only é"), (6, "w", "z" * 2_000_000), (7, "t", "twice"), (7, "t", "twice"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, headers string")
    write_archives(pages.repartition(3), str(tmp_path / "w"))
    got = read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert {r.status for r in got} == {"record"}

    def sha1(text):
        return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()

    seen = sorted(
        (r.headers.get(warc.PAGE_ID), r.record_type, r.headers.get(warc.REFERS_TO), r.payload_bytes, r.payload_digest)
        for r in got if warc.PAGE_ID in r.headers
    )
    keep = {"same": 2, "": 4, "only é": 5, "z" * 2_000_000: 6, "twice": 7}
    want = sorted(
        (str(i), "response" if keep[t or ""] == i else "revisit", None if keep[t or ""] == i else str(keep[t or ""]),
         len((t or "").encode()), sha1(t))
        for i, _, t in rows if i is not None
    )
    assert seen == want
    (nameless,) = [r for r in got if warc.PAGE_ID not in r.headers]
    assert (nameless.record_type, nameless.headers[warc.REFERS_TO]) == ("revisit", "2")
    assert {r.payload.decode() for r in got if r.record_type == "response"} == set(keep)
    write_archives(pages.limit(0), str(tmp_path / "none"))
    assert read_archives(spark, str(tmp_path / "none")).count() == 0


def test_urls_of_any_length_come_back(spark, tmp_path):
    rows = [(1, "data:," + "x" * 100_000, "a"), (2, "http://h/" + "\n" * 50_000, "b"), (3, "v" * 100_000, "b"), (4, "u", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    write_archives(pages, str(tmp_path / "w"))
    got = read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r.status, r.headers.get(warc.PAGE_ID)) for r in got) == [("record", str(i)) for i in (1, 2, 3, 4)]
    assert {r.headers[warc.PAGE_ID]: r.headers["WARC-Target-URI"] for r in got} == {str(i): u.replace("\n", "%0A") for i, u, _ in rows}


def test_a_header_without_end_stops_at_the_next_version_line():
    good = records(2)
    data = b"WARC/1.1\r\nX: " + b"y" * 100_000 + b"\r\n" + good[0] + good[1]
    assert [(t[0], t[3]) for t in told(data)] == [(None, False), ("0", True), ("1", True)]


def test_records_before_the_damage_of_a_member_are_saved():
    whole = records(40)
    one = member(b"".join(whole))
    rest = member(records(41)[40])
    cut = len(one) * 2 // 3
    for broken in (one[:cut], one[:cut] + b"\xff\xff\xff\xff" + one[cut + 4 :], one[:-6] + b"\0\0" + one[-4:]):
        found = list(warc.salvage(broken + rest))
        saved = [f.headers[warc.PAGE_ID] for f in found if not f.reason]
        assert saved[:-1] == [str(k) for k in range(len(saved) - 1)] and saved[-1] == "40" and len(saved) > 10
        assert all(f.length == 0 and f.offset == 0 for f in found if not f.reason and f.headers[warc.PAGE_ID] != "40")
        (gap,) = [f for f in found if f.reason]
        assert (gap.offset, gap.length) == (0, len(broken))


def test_a_broken_member_gives_nothing_that_no_digest_confirms():
    plain = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bool(f.reason) for f in warc.salvage(member(plain * 3)[:-6])] == [True]


def test_query_stops_at_a_lost_page(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert op1_warc(spark, str(tmp_path)).count() == 2
    gaps = spark.createDataFrame([("a", 0, 9, "quarantined", "Block differs")], "archive string, offset long, length long, status string, reason string")
    filled = [f for f in warc.RECORDS.fields if f.name not in gaps.columns]
    gaps = gaps.selectExpr("*", *(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in filled))
    monkeypatch.setattr(warc, "read_archives", lambda *_: gaps)
    with pytest.raises(Exception, match="unreadable: a 0 Block differs"):
        op1_warc(spark, str(tmp_path)).collect()
