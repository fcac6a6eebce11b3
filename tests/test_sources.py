import json
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks import transport
from millrace.sources.csv import csv_records, csv_rejects, read_csv_source
from millrace.sources.feed import entry_record, feed_records, feed_rejects, parse_entries, read_feed
from millrace.sources.paged import PagedSinceSource, PagedSource, page_ranges
from millrace.sources.pages import page_records, unwrap_pages
from millrace.sources.spec import SourceSpec

GOOD = """<?xml version="1.0"?><rss xmlns:dc="d" xmlns:content="c"><channel><title>feed</title>
<item><title>One &amp; only</title><link>http://a/1</link><guid isPermaLink="false">g1</guid>
<pubDate>Mon, 15 Jan 2024 10:00:00 +0000</pubDate><category>a</category><category>b</category>
<dc:creator>me</dc:creator><content:encoded><![CDATA[<p>hi</p>]]></content:encoded>
<description>D</description></item>
<item><title>Two</title><link>http://a/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title type="text">A</title>
<link rel="self" href="http://s"/><link href="http://a/9"/><summary>S</summary>
<author><name>Bob</name></author><updated>2024-01-15T10:00:00Z</updated><category term="x"/>
<content type="html">C</content></entry></feed>"""


def payloads(df):
    return [json.loads(r.payload) for r in df.orderBy("ordinal").collect()]


def test_csv_headers_cells_and_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(' ID ,Product Name,Cost\n1,"say ""hi"",\nthere",N/A\n2,, 3.5 \n', encoding="utf-8")
    rows = read_csv_source(spark, str(path))
    assert rows.columns[:3] == ["id", "product_name", "cost"]
    assert payloads(csv_records(rows)) == [
        {"id": "1", "product_name": 'say "hi",\nthere', "cost": None},
        {"id": "2", "product_name": None, "cost": " 3.5 "},
    ]


def test_csv_later_of_two_equal_headers_wins(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,Price,price \n1,2,3\n", encoding="utf-8")
    assert payloads(csv_records(read_csv_source(spark, str(path)))) == [{"id": "1", "price": "3"}]


def test_missing_csv_gives_no_records(spark, tmp_path):
    assert csv_records(read_csv_source(spark, str(tmp_path / "none.csv"))).isEmpty()


def test_csv_folder_in_another_encoding(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.csv").write_text(f"id,name\n{i},né\n", encoding="latin-1")
    rows = csv_records(read_csv_source(spark, str(tmp_path), encoding="ISO-8859-1"))
    assert sorted((r["id"], r["name"]) for r in payloads(rows)) == [("1", "né"), ("2", "né")]


@pytest.mark.parametrize(
    ("bodies", "ids"),
    [
        (['[{"id":1},{"id":2}]', '[{"id":3}]', '[{"id":4},{"id":5}]'], [1, 2, 3]),
        (['[]', '[{"id":3}]'], []),
        (['{"data":[{"id":1}],"has_next":true}', '{"results":[{"id":2}]}', '[{"id":3}]'], [1, 2]),
        (['{"data":null,"results":[{"id":1}]}'], []),
        (['{"error":"down"}'], []),
        (["5"], []),
        (["not json", '[{"id":1}]'], []),
        (['{"data":[{"id":1}],"has_next":0}', '[{"id":2}]'], [1]),
        (['{"data":[{"id":1}],"has_next":"yes"}', '{"data":[]}', '[{"id":2}]'], [1]),
    ],
)
def test_pages(spark, bodies, ids):
    pages = spark.createDataFrame(
        [("f", i + 1, b) for i, b in enumerate(bodies)], "fetch string, page int, body string"
    )
    records = page_records(unwrap_pages(pages, ["fetch"], page_size=2), "fetch")
    assert [r["id"] for r in payloads(records)] == ids


def test_page_of_99_is_the_last(spark):
    def body(n):
        return json.dumps([{"id": i} for i in range(n)])

    pages = spark.createDataFrame(
        [("a", 1, body(100)), ("a", 2, body(100)), ("b", 1, body(99)), ("b", 2, body(100))],
        "fetch string, page int, body string",
    )
    counts = unwrap_pages(pages, ["fetch"]).groupBy("fetch").count().collect()
    assert dict(map(tuple, counts)) == {"a": 200, "b": 99}


def test_rss_fields(spark, tmp_path):
    (tmp_path / "good.xml").write_text(GOOD, encoding="utf-8")
    first, second = payloads(feed_records(read_feed(spark, str(tmp_path / "good.xml"))))
    assert first == {
        "id": "g1", "title": "One & only", "description": "D", "link": "http://a/1", "author": "me",
        "published": "2024-01-15T10:00:00", "categories": ["a", "b"], "content": "<p>hi</p>",
    }
    assert (second["id"], second["published"], second["categories"]) == ("http://a/2", None, [])


def test_atom_fields(spark, tmp_path):
    (tmp_path / "atom.xml").write_text(ATOM, encoding="utf-8")
    (record,) = payloads(feed_records(read_feed(spark, str(tmp_path / "atom.xml"))))
    assert record == {
        "id": "e1", "title": "A", "description": "S", "link": "http://a/9", "author": "Bob",
        "published": "2024-01-15T10:00:00", "categories": ["x"], "content": "C",
    }


def test_a_folder_may_hold_both_feed_forms(spark, tmp_path):
    (tmp_path / "atom.xml").write_text(ATOM, encoding="utf-8")
    (tmp_path / "rss.xml").write_text(GOOD, encoding="utf-8")
    records = payloads(feed_records(read_feed(spark, str(tmp_path))))
    assert sorted(r["title"] for r in records) == ["A", "One & only", "Two"]
    assert feed_rejects(spark, str(tmp_path)).isEmpty()


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,Lamp\n2,Mug,extra\n3\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("name,id,size\nPen,4,s\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    for multi_line in (True, False):
        rows = read_csv_source(spark, str(tmp_path), multi_line=multi_line).select("id", "name", "size").collect()
        assert sorted(map(tuple, rows), key=str) == [("1", "Lamp", None), ("3", None, None), ("4", "Pen", "s")]
        (bad,) = csv_rejects(spark, str(tmp_path), multi_line=multi_line).collect()
        assert (bad.file_path.rsplit("/", 1)[1], bad.cells) == ("a.csv", ["2", "Mug", "extra"])


def test_malformed_feed_is_rejected_whole_and_alone(spark, tmp_path):
    texts = {
        "good": GOOD,
        "tag": "<rss><channel><item><title>ok</title></item><item><title>x</titel></item></channel></rss>",
        "cut": "<rss><channel><item><title>ok</title><guid>c</guid></item>",
        "cut_inside": "<rss><channel><item><title>ok</title></item><item><title>x",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8")
    rejects = feed_rejects(spark, str(tmp_path)).collect()
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in rejects) == [
        "cut.xml", "cut_inside.xml", "tag.xml",
    ]
    records = payloads(feed_records(read_feed(spark, str(tmp_path))))
    assert [r["title"] for r in records] == ["One & only", "Two"]


def test_entries_from_text(spark):
    rows = spark.createDataFrame(
        [(1, "<item><title>t</title><guid>9</guid></item>"), (2, "<item><title>t</titl></item>")],
        "k int, x string",
    )
    got = parse_entries(rows, "x").select("k", F.col("entry").isNull().alias("bad"),
                                          entry_record(F.col("entry"))["id"].alias("id"))
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, False, "9"), (2, True, "")]


def test_paged_source_reads_every_page_once(spark, tmp_path):
    (tmp_path / "fake_service.py").write_text(
        "import json\n\ndef page(n, options):\n    return json.dumps([{'id': n}] * int(options['size']))\n",
        encoding="utf-8",
    )
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fake_service.py"))
    spark.dataSource.register(PagedSource)
    pages = spark.read.format("paged").options(
        transport="fake_service:page", first_page=1, last_page=7, pages_per_task=3, size=2
    ).load()
    assert pages.rdd.getNumPartitions() == 3
    assert sorted(r.page for r in pages.collect()) == list(range(1, 8))
    assert unwrap_pages(pages, ["fetch"], page_size=2).count() == 14


@pytest.fixture
def counting_service(spark, tmp_path):
    """A service of two fetches, 5 and 3 pages of two records, that notes what it is asked for."""
    (tmp_path / "counting_service.py").write_text(
        "import json\n\ndef page(n, options):\n"
        "    with open(options['log'], 'a') as log:\n"
        "        log.write(f\"{options['fetch']} {n} {options.get('since')}\\n\")\n"
        "    last = {'shop': 5, 'stock': 3}[options['fetch']]\n"
        "    if options['fetch'] == 'shop':\n"
        "        return json.dumps([{'id': n}] * (2 if n < last else 1))\n"
        "    return json.dumps({'data': [{'id': n}] * 2, 'has_next': n < last})\n",
        encoding="utf-8",
    )
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "counting_service.py"))
    spark.dataSource.register(PagedSource)
    log = tmp_path / "asked"
    log.touch()
    options = {"transport": "counting_service:page", "fetch": "shop,stock", "page_size": "2", "log": str(log)}
    yield options, lambda: sorted(log.read_text().splitlines())
    sys.path.remove(str(tmp_path))
    sys.modules.pop("counting_service", None)


EVERY_PAGE = [("shop", n) for n in range(1, 6)] + [("stock", n) for n in range(1, 4)]


def test_paged_source_stops_at_the_terminal_page(spark, counting_service):
    options, asked = counting_service
    pages = spark.read.format("paged").options(**options).load()
    records = unwrap_pages(pages, ["fetch"], page_size=2, stopped=True).collect()
    assert asked() == [f"{fetch} {n} None" for fetch, n in EVERY_PAGE]
    assert len(records) == 9 + 6 and {(r.fetch, r.page) for r in records} == set(EVERY_PAGE)
    compared = unwrap_pages(pages, ["fetch"], page_size=2)
    assert sorted(map(str, compared.collect())) == sorted(map(str, records))


def test_a_filter_on_since_reaches_the_transport(spark, counting_service):
    options, asked = counting_service
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(PagedSinceSource)
        pages = spark.read.format("paged_since").options(**options).load()
        wanted = pages.filter("since >= TIMESTAMP '2024-01-05' AND since > TIMESTAMP '2024-01-06 01:00:00' AND fetch = 'shop'")
        assert sorted(r.page for r in wanted.select("page").collect()) == [1, 2, 3, 4, 5]
        assert asked() == [f"shop {n} 2024-01-06T01:00:00" for n in range(1, 6)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    # Without pushdown the option does the same.
    same = spark.read.format("paged").options(**options, since="2024-01-06T01:00:00").load()
    assert same.filter("fetch = 'shop'").count() == 5
    assert asked().count("shop 1 2024-01-06T01:00:00") == 2


@pytest.mark.parametrize("shuffled", [False, True])
def test_the_service_opens_its_store_once_for_all_pages(tmp_path, monkeypatch, shuffled):
    ids = [None, -1, *range(1_000), 150, 950]
    ids = ids[::7] + [i for k, i in enumerate(ids) if k % 7] if shuffled else ids
    rows = pa.table({"event_id": pa.array(ids, pa.int64()), "event_type": [f"é{i}" if i != 999 else None for i in ids]})
    (tmp_path / "store").mkdir()
    for k in (0, 1):
        pq.write_table(rows.slice(k * 500, 500 if k == 0 else None), tmp_path / f"store/{k}.parquet", row_group_size=130)
    opened, dataset = [], transport.ds.dataset
    monkeypatch.setattr(transport.ds, "dataset", lambda *a, **b: opened.append(a) or dataset(*a, **b))
    options = {"path": str(tmp_path / "store")}
    pages = [json.loads(transport.event_page(n, options)) for n in range(12)]
    assert len(opened) == 1
    assert [[r["id"] for r in page] for page in pages] == [
        sorted(i for i in ids if i is not None and i // 100 == n - 1) for n in range(12)
    ]
    assert pages[10][-1] == {"id": 999, "type": None} and pages[2][50:52] == [{"id": 150, "type": "é150"}] * 2


def test_stopped_pages_are_parsed_once(spark):
    bodies = spark.range(3).selectExpr("'f' AS fetch", "id + 1 AS page", "concat('[', id, ']') AS body").repartition(2)
    records = unwrap_pages(bodies, ["fetch"], page_size=1, stopped=True)
    assert records._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert records.count() == 3


def test_paged_stream_reads_every_page_once_and_goes_on_where_it_stopped(spark, counting_service, tmp_path):
    options, asked = counting_service

    def drain():
        stream = {**options, "transport": f"{tmp_path}/counting_service.py:page", "pages_per_batch": "2"}
        pages = spark.readStream.format("paged").options(**stream).load()
        query = (
            unwrap_pages(pages, ["fetch"], page_size=2, stopped=True)
            .writeStream.format("parquet").option("path", str(tmp_path / "records"))
            .option("checkpointLocation", str(tmp_path / "position")).trigger(processingTime="0 seconds").start()
        )
        query.processAllAvailable()
        query.stop()

    drain()
    drain()
    assert asked() == [f"{fetch} {n} None" for fetch, n in EVERY_PAGE]
    got = spark.read.parquet(str(tmp_path / "records"))
    assert got.count() == 15 and {(r.fetch, r.page) for r in got.collect()} == set(EVERY_PAGE)


def test_page_ranges_cover_without_overlap():
    pages = [p for r in page_ranges(1, 10, 4) for p in range(r.first, r.last + 1)]
    assert pages == list(range(1, 11))
    with pytest.raises(ValueError):
        page_ranges(1, 2, 0)


def test_source_spec_checks_its_values():
    for wrong in ({"kind": "ftp"}, {"name": ""}, {"name": "n" * 101}, {"mark_kind": "x"}, {"id_order": "x"}):
        with pytest.raises(ValueError):
            SourceSpec(**{"kind": "api", "name": "s", **wrong})
