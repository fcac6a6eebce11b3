"""Reading, parsing, mapping and checking of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import (
    AS_OF,
    customer_payload,
    cdata,
    event_payload,
    event_raw,
    json_of,
    naive,
    ordinal,
    page_item,
    part_raw,
    raw_rows,
    spread_table,
    table,
)
from millrace.functions.parse import parse_float, parse_int, parse_ts, split_tags
from millrace.functions.payload import as_record, first_truthy
from millrace.operators.landing import land
from millrace.operators.normalize import normalize
from millrace.operators.validate import reject_reasons, rejected, run_outcome, validate
from millrace.session import fresh_path
from millrace.sources.csv import csv_records, csv_rejects, read_csv_source
from millrace.sources.feed import (
    entry_record,
    feed_records,
    feed_rejects,
    parse_entries,
    read_feed,
)
from millrace.sources.pages import unwrap_pages
from millrace.sources.spec import SourceSpec

def joined_tags() -> Column:
    return F.array_join("tags", "|").alias("tags")


def csv_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(part_raw(spark, sf_dir)).select(
        "external_id", "title", "description", "category", "amount", "quantity", joined_tags(),
        F.array_join(F.array_sort(F.map_keys("metadata")), "|").alias("metadata_keys"), "status",
    )


def api_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(event_raw(spark, sf_dir)).select(
        "external_id", "title", "description", "category", "url", "author", "amount", "quantity",
        "rating", joined_tags(), naive("published_at"), "status",
    )


def page_entry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread_table(spark, sf_dir, "pages", "page_id").select(
        "page_id", page_item().alias("xml")
    )
    record = F.to_json(entry_record(F.col("entry")), {"ignoreNullFields": "false"})
    return raw_rows(
        parse_entries(pages, "xml"), "rss", F.lit("pages"), record, F.col("page_id")
    )


def rss_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(page_entry_raw(spark, sf_dir)).select(
        "external_id", "title", "url", "description", naive("published_at"),
        F.md5(F.col("metadata")["content"].cast("string")).alias("content_md5"),
    )


def normalize_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (
        part_raw(spark, sf_dir)
        .unionByName(event_raw(spark, sf_dir))
        .unionByName(page_entry_raw(spark, sf_dir))
    )
    return normalize(raw).select(
        "source_type", "external_id", "title", "category", "amount", naive("published_at")
    )


def custom_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of kind feed, which has no mapping of its own, given one that routes categories."""
    from millrace.sources.spec import KIND_MAPPINGS, FieldMapping

    conversations = spread_table(spark, sf_dir, "conversations", "conv_id", "turn")
    payload = json_of(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.col("text").alias("body"),
        F.array("role", F.lit("chat")).alias("categories"),
    )
    position = F.col("conv_id") * 1000 + F.col("turn")
    raw = raw_rows(conversations, "feed", F.lit("chat"), payload, position)
    mapping = FieldMapping(
        external_id=("key",), title=("headline",), description=("body",), tags=("categories",)
    )
    mapped = normalize(raw, KIND_MAPPINGS, {("feed", "chat"): mapping})
    plain = normalize(raw)
    both = mapped.withColumn("mapped", F.lit(True)).unionByName(
        plain.withColumn("mapped", F.lit(False))
    )
    return both.select(
        "mapped",
        F.coalesce("external_id", F.lit("")).alias("external_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.md5("description"), F.lit("")).alias("description_md5"),
        joined_tags(),
        F.array_join("map_errors", "|").alias("map_errors"),
    )


def page_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten events in the four response forms, each page a fetch of its own."""
    events = table(spark, sf_dir, "events")
    fetch = F.floor(F.col("event_id") / 10).cast("bigint")
    records = F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))))
    pages = events.groupBy(fetch.alias("fetch")).agg(records.alias("r"))
    form = F.col("fetch") % 4
    body = (
        F.when(form == 0, F.col("r"))
        .when(form == 1, F.concat(F.lit('{"has_next":true,"data":'), F.col("r"), F.lit("}")))
        .when(form == 2, F.concat(F.lit('{"results":'), F.col("r"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"data":null,"results":'), F.col("r"), F.lit("}")))
    )
    unwrapped = unwrap_pages(
        pages.select("fetch", F.lit(1).alias("page"), body.alias("body")), ["fetch"]
    )
    return unwrapped.select(
        "fetch", "pos",
        F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("payload", "$.event_type").alias("event_type"),
    )


def page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches of a hundred pages, as lists without errors or as objects that go on after a click."""
    events = table(spark, sf_dir, "events")
    key = F.col("event_id")
    kind = F.col("event_type")
    record = F.struct("event_id", "event_type")
    pages = events.groupBy(
        F.floor(key / 1000).cast("bigint").alias("fetch"),
        F.floor((key % 1000) / 10 + 1).cast("bigint").alias("page"),
    ).agg(
        F.to_json(F.array_sort(F.collect_list(F.when(kind != "error", record)))).alias("good"),
        F.to_json(F.array_sort(F.collect_list(record))).alias("every"),
        F.max(kind == "click").cast("string").alias("more"),
    )
    body = F.when(F.col("fetch") % 2 == 0, F.col("good")).otherwise(
        F.concat(
            F.lit('{"has_next":'), F.col("more"), F.lit(',"data":'), F.col("every"), F.lit("}")
        )
    )
    unwrapped = unwrap_pages(
        pages.select("fetch", "page", body.alias("body")), ["fetch"], page_size=7
    )
    return unwrapped.select(
        "fetch", "page", F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id")
    )


def presence_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread_table(spark, sf_dir, "events", "event_id")
    case = F.col("event_id") % 4
    value = F.col("value").cast("string")
    head = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"))
    name = F.concat(F.lit(',"name":"'), F.col("event_type"), F.lit('"'))
    rest = (
        F.when(
            case == 0,
            F.concat(name, F.lit(',"title":"t","price":'), value, F.lit(',"cost":0')),
        )
        .when(case == 1, F.concat(F.lit(',"name":null,"title":"t","price":null,"cost":'), value))
        .when(case == 2, F.concat(F.lit(',"title":"t","cost":'), value))
        .otherwise(F.lit(""))
    )
    payload = F.concat(head, rest, F.lit("}"))
    present = normalize(raw_rows(events, "api", F.lit("e"), payload, F.col("event_id")))
    words = json_of(
        F.when(case == 0, F.lit("a, b")).when(case == 1, F.lit("")).alias("keywords"),
        F.when(case != 3, F.col("event_type")).alias("tags"),
    )
    truthy = events.select(
        F.col("event_id").cast("string").alias("external_id"), as_record(words).alias("m")
    ).select(
        "external_id",
        F.coalesce(
            first_truthy(F.col("m")["keywords"], F.col("m")["tags"]).cast("string"), F.lit("none")
        ).alias("first_truthy"),
    )
    return present.select("external_id", "title", "amount").join(truthy, "external_id")


def safe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    case = F.col("o_orderkey") % 12
    price = F.col("o_totalprice").cast("string")
    number_text = F.when(case == 0, price).when(case == 7, F.concat(F.lit(" "), price, F.lit("\t")))
    for residue, text in {
        1: "", 2: "abc", 3: "1_000", 4: "1d", 5: "1e3", 6: "nan", 8: "10.9", 9: "-1.5", 10: "-inf",
    }.items():
        number_text = number_text.when(case == residue, text)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    date_text = (
        F.when(case == 0, F.concat(day, F.lit("T10:20:30Z")))
        .when(case == 1, day)
        .when(case == 2, "2024")
        .when(case == 3, "garbage")
        .when(case == 4, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(case == 5, F.concat(day, F.lit("T10:20:30.5+05:30")))
        .when(case == 6, F.concat(day, F.lit(" 10:20")))
        .when(case == 7, F.concat(day, F.lit(" ")))
        .when(case == 8, F.concat(day, F.lit("T25:00")))
        .when(case == 9, F.concat(day, F.lit("T102030-08")))
    )
    texts = orders.select(
        "o_orderkey", number_text.alias("n"), date_text.alias("d"),
        F.concat_ws(",", "o_orderstatus", F.lit(" "), F.concat(F.lit(" "), "o_orderpriority")).alias("w"),
    )
    number = parse_float(F.col("n"))
    return texts.select(
        "o_orderkey",
        F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number).alias("number"),
        F.coalesce(F.isnan(number), F.lit(False)).alias("is_nan"),
        F.coalesce(number == float("-inf"), F.lit(False)).alias("is_minus_inf"),
        F.coalesce(parse_int(F.col("n")), F.lit(-99).cast("bigint")).alias("whole"),
        parse_ts(F.col("d")).cast("timestamp_ntz").alias("at"),
        F.array_join(split_tags(F.col("w")), "|").alias("tags"),
    )


def metadata_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread_table(spark, sf_dir, "events", "event_id")
    payload = json_of(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("user_id"),
        F.from_json("props", "k bigint").alias("props"), F.lit(None).cast("string").alias("note"),
        F.lit("x").alias("category"),
    )
    mapped = normalize(raw_rows(events, "api", F.lit("e"), payload, F.col("event_id")))
    meta = F.col("metadata")
    return mapped.select(
        "external_id",
        F.array_join(F.array_sort(F.map_keys(meta)), "|").alias("metadata_keys"),
        meta["user_id"].cast("bigint").alias("user_id"),
        F.variant_get(meta["props"], "$.k", "bigint").alias("k"),
        F.is_variant_null(meta["note"]).alias("note_is_null"),
    )


def document_raw(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    payload = json_of(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"),
        F.col("lang").alias("category"), F.col("n_chars").cast("string").alias("cost"),
    )
    name = F.col("source") if by_source else F.lit("documents")
    documents = spread_table(spark, sf_dir, "documents", "doc_id")
    return raw_rows(documents, "csv", name, payload, F.col("doc_id"))


def customer_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(
        spread_table(spark, sf_dir, "customer", "c_custkey"), "csv", F.lit("customers"),
        customer_payload(), F.col("c_custkey"),
    )


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(
        normalize(document_raw(spark, sf_dir).unionByName(customer_raw(spark, sf_dir)))
    )


def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select(
        "source_name", "external_id", (F.size("errors") == 0).alias("is_valid"),
        F.array_join("errors", "|").alias("errors"), F.md5("title_as_given").alias("title_md5"),
    )


def reject_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(_checked(spark, sf_dir), AS_OF).select(
        "phase", "source_name", "error_class", "message",
        F.col("context")["external_id"].alias("external_id"), naive("at"),
    )


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_reasons(_checked(spark, sf_dir), ["source_name"])


def outcome_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate(normalize(document_raw(spark, sf_dir, by_source=True)))
    return run_outcome(checked, ["source_name"])


def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded rows include repeats of an item; distinct items are counted beside them."""
    payload = json_of(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("name"))
    raw = raw_rows(
        spread_table(spark, sf_dir, "events", "event_id"), "csv", F.col("event_type"), payload,
        F.col("event_id"),
    )
    return run_outcome(validate(normalize(raw)), ["source_type", "source_name"])


def land_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread_table(spark, sf_dir, "events", "event_id")
    records = events.select(
        F.concat(
            F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"created_at":"'),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"}'),
        ).alias("payload"),
        ordinal(F.lit("events"), F.col("event_id")).alias("ordinal"),
    )
    return land(records, SourceSpec("api", "events"), "run-1", AS_OF).select(
        "source_type", "source_name", "source_id", naive("event_time"), "content_hash",
        "etl_run_id", "file_path", naive("ingested_at"),
    )


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV with an untidy header, and read back as records."""
    path = fresh_path(spark, "parts-csv")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(" ID"),
        F.col("p_name").alias("Product Name "),
        F.when(F.col("p_size") > 25, F.lit("N/A")).otherwise(F.col("p_type")).alias("Category"),
        F.col("p_retailprice").alias("COST"),
        F.concat(F.lit('say "'), "p_brand", F.lit('",\n'), "p_type").alias("details"),
    )
    parts.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False,
                        ignoreTrailingWhiteSpace=False).csv(path)
    rows = csv_records(read_csv_source(spark, [path, f"{path}-absent"]))
    raw = raw_rows(rows, "csv", F.lit("parts"), F.col("payload"), F.col("ordinal")["pos"])
    return normalize(raw).select(
        "external_id", "title", "description", F.coalesce("category", F.lit("-")).alias("category"),
        "amount", F.array_join(F.array_sort(F.map_keys("metadata")), "|").alias("metadata_keys"),
    )


def csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in files whose columns differ in order and number; every tenth line has a cell too many."""
    path = fresh_path(spark, "mixed-csv")
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").withColumn("form", key % 2)
    surplus = F.when(key % 10 == 0, ",more").otherwise("")
    by_form = F.when(F.col("form") == 0, F.concat_ws(",", key.cast("string"), "p_name", F.concat("p_brand", surplus))
                     ).otherwise(F.concat_ws(",", "p_name", F.concat(key.cast("string"), surplus)))
    header = F.when(F.col("form") == 0, "ID,Product Name,Category").otherwise("Product Name,ID")
    (
        parts.groupBy("form", F.floor(key / 1000).alias("file"))
        .agg(F.first(header).alias("header"), F.concat_ws("\n", F.array_sort(F.collect_list(by_form))).alias("lines"))
        .select("form", F.concat_ws("\n", "header", "lines").alias("value"))
        .write.partitionBy("form").option("maxRecordsPerFile", 1).text(path)
    )
    rows = read_csv_source(spark, path, multi_line=False).select("id", "product_name", "category", F.lit(False).alias("rejected"))
    cells, even = F.col("cells"), F.size("cells") == 4
    rejects = csv_rejects(spark, path, multi_line=False).select(
        F.when(even, cells[0]).otherwise(cells[1]).alias("id"),
        F.when(even, cells[1]).otherwise(cells[0]).alias("product_name"),
        F.when(even, F.get(cells, F.lit(2))).alias("category"), F.lit(True).alias("rejected"),
    )
    return rows.unionByName(rejects)


def feed_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of even number as RSS items and the others as Atom entries, in one folder."""
    path = fresh_path(spark, "mixed-feeds")
    pages = table(spark, sf_dir, "pages").withColumn("form", F.col("page_id") % 2)
    number = F.col("page_id").cast("string")
    entry = F.when(
        F.col("form") == 0, F.concat(F.lit("<item><title>p"), number, F.lit("</title><guid>"), number, F.lit("</guid></item>"))
    ).otherwise(F.concat(F.lit("<entry><title>p"), number, F.lit("</title><id>"), number, F.lit("</id></entry>")))
    feeds = pages.groupBy("form", F.floor(F.col("page_id") / 1000).alias("file")).agg(
        F.concat_ws("", F.array_sort(F.collect_list(entry))).alias("entries")
    )
    document = F.when(
        F.col("form") == 0, F.concat(F.lit("<rss><channel>"), "entries", F.lit("</channel></rss>"))
    ).otherwise(F.concat(F.lit("<feed>"), "entries", F.lit("</feed>")))
    feeds.select("form", document.alias("value")).write.partitionBy("form").option("maxRecordsPerFile", 1).text(path)
    records = feed_records(read_feed(spark, path))
    return records.select(
        F.get_json_object("payload", "$.id").cast("bigint").alias("page_id"),
        F.get_json_object("payload", "$.title").alias("title"),
    )


def _write_feeds(spark: SparkSession, sf_dir: str) -> str:
    """Feeds of up to ten pages, one file each; a feed with a page of host ``m.`` is cut short."""
    path = fresh_path(spark, "page-feeds")
    feeds = (
        table(spark, sf_dir, "pages")
        .groupBy(F.floor(F.col("page_id") / 10).cast("bigint").alias("feed"))
        .agg(
            F.concat_ws("", F.array_sort(F.collect_list(page_item()))).alias("items"),
            F.max(F.col("url").contains("://m.")).alias("is_cut"),
        )
    )
    document = F.concat(
        F.lit("<rss><channel>"), F.regexp_replace("items", "[\\r\\n]", " "),
        F.when(F.col("is_cut"), F.lit("<item><title>")).otherwise(F.lit("</channel></rss>")),
    )
    feeds.select("feed", document.alias("value")).repartition("feed").write.partitionBy(
        "feed"
    ).text(path)
    return path


def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = feed_records(read_feed(spark, _write_feeds(spark, sf_dir)))
    raw = raw_rows(records, "rss", F.lit("pages"), F.col("payload"), F.col("ordinal")["pos"])
    return normalize(raw).select("external_id", "title", "url", naive("published_at"))


def feed_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = feed_rejects(spark, _write_feeds(spark, sf_dir))
    return bad.select(
        F.regexp_extract("file_path", "feed=([0-9]+)", 1).cast("bigint").alias("feed"), "message"
    )


_EVENT_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_PAGE_TITLE = "trim(regexp_extract(html, '<title>(.*?)</title>', 1), ' ' || chr(9) || chr(10) || chr(13))"
_PAGE_HTML = "trim(html, ' ' || chr(9) || chr(10) || chr(13))"
_PAGE_TIME = "TIMESTAMP '2024-01-01' + to_minutes(page_id)"
_CHECKED = """
    SELECT 'documents' AS source_name, CAST(doc_id AS VARCHAR) AS external_id, text AS title,
           CASE WHEN length(text) > 500 THEN 'title_too_long' ELSE '' END AS errors
    FROM documents
    UNION ALL
    SELECT 'customers', CAST(c_custkey AS VARCHAR), c_name,
           CASE WHEN c_acctbal < 0 THEN 'amount_out_of_range' ELSE '' END
    FROM customer
"""
_FEEDS = """
    SELECT page_id // 10 AS feed, max(CASE WHEN url LIKE '%://m.%' THEN 1 ELSE 0 END) AS is_cut
    FROM pages GROUP BY 1
"""

QUERIES = {
    "csv_normalize": (csv_normalize, """
        SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, '' AS description,
               p_type AS category, p_retailprice AS amount, CAST(p_size AS BIGINT) AS quantity,
               p_brand || '|' || p_type AS tags, 'cost|keywords|quantity' AS metadata_keys,
               'active' AS status
        FROM part"""),
    "api_normalize": (api_normalize, f"""
        SELECT CAST(event_id AS VARCHAR) AS external_id, event_type AS title,
               'user ' || user_id AS description, event_type AS category,
               'https://example.com/e/' || event_id AS url, 'u' || user_id AS author,
               value AS amount, user_id AS quantity, {_K} / 20 AS rating,
               event_type || '|u' || user_id AS tags, ts AS published_at, 'active' AS status
        FROM events"""),
    "rss_normalize": (rss_normalize, f"""
        SELECT CAST(page_id AS VARCHAR) AS external_id, {_PAGE_TITLE} AS title, url,
               '' AS description, {_PAGE_TIME} AS published_at, md5({_PAGE_HTML}) AS content_md5
        FROM pages"""),
    "normalize_union": (normalize_union, f"""
        SELECT 'csv' AS source_type, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title,
               p_type AS category, p_retailprice AS amount, CAST(NULL AS TIMESTAMP) AS published_at
        FROM part
        UNION ALL SELECT 'api', CAST(event_id AS VARCHAR), event_type, event_type, value, ts
        FROM events
        UNION ALL SELECT 'rss', CAST(page_id AS VARCHAR), {_PAGE_TITLE}, NULL, NULL, {_PAGE_TIME}
        FROM pages"""),
    "custom_mapping": (custom_mapping, """
        SELECT true AS mapped, conv_id || '-' || turn AS external_id, 'Untitled' AS title,
               md5(text) AS description_md5, role || '|chat' AS tags, '' AS map_errors
        FROM conversations
        UNION ALL
        SELECT false, '', '', '', '', 'unknown_source_type' FROM conversations"""),
    "page_unwrap": (page_unwrap, """
        SELECT event_id // 10 AS fetch,
               row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS pos,
               event_id, event_type
        FROM events WHERE (event_id // 10) % 4 <> 3"""),
    "page_stop": (page_stop, """
        WITH pages_seen AS (
            SELECT event_id // 1000 AS f, (event_id % 1000) // 10 + 1 AS page,
                   count(*) FILTER (WHERE event_type <> 'error') AS good,
                   count(*) FILTER (WHERE event_type = 'click') AS clicks
            FROM events GROUP BY 1, 2),
        ends AS (
            SELECT f, min(CASE WHEN f % 2 = 0 AND good < 7 OR f % 2 = 1 AND clicks = 0
                               THEN page END) AS last_page
            FROM pages_seen GROUP BY 1)
        SELECT f AS fetch, (event_id % 1000) // 10 + 1 AS page, event_id
        FROM events JOIN ends ON f = event_id // 1000
        WHERE (last_page IS NULL OR (event_id % 1000) // 10 + 1 <= last_page)
          AND (f % 2 = 1 OR event_type <> 'error')"""),
    "presence_first_key": (presence_first_key, """
        SELECT CAST(event_id AS VARCHAR) AS external_id,
               CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN 't' WHEN 3 THEN 'Untitled' END
                   AS title,
               CASE event_id % 4 WHEN 0 THEN value WHEN 2 THEN value END AS amount,
               CASE event_id % 4 WHEN 0 THEN 'a, b' WHEN 3 THEN 'none' ELSE event_type END
                   AS first_truthy
        FROM events"""),
    "safe_parse": (safe_parse, """
        SELECT o_orderkey,
               CASE o_orderkey % 12 WHEN 0 THEN o_totalprice WHEN 7 THEN o_totalprice
                    WHEN 3 THEN 1000 WHEN 5 THEN 1000 WHEN 8 THEN 10.9 WHEN 9 THEN -1.5
               END::DOUBLE AS number,
               o_orderkey % 12 = 6 AS is_nan, o_orderkey % 12 = 10 AS is_minus_inf,
               CASE o_orderkey % 12 WHEN 0 THEN trunc(o_totalprice) WHEN 7 THEN trunc(o_totalprice)
                    WHEN 3 THEN 1000 WHEN 5 THEN 1000 WHEN 8 THEN 10 WHEN 9 THEN -1 ELSE -99
               END::BIGINT AS whole,
               CASE o_orderkey % 12
                    WHEN 0 THEN o_orderdate + INTERVAL '10 hours 20 minutes 30 seconds'
                    WHEN 1 THEN o_orderdate WHEN 4 THEN o_orderdate
                    WHEN 5 THEN o_orderdate + INTERVAL '4 hours 50 minutes 30 seconds'
                                + INTERVAL '500 milliseconds'
                    WHEN 6 THEN o_orderdate + INTERVAL '10 hours 20 minutes'
                    WHEN 9 THEN o_orderdate + INTERVAL '18 hours 20 minutes 30 seconds'
               END AS at,
               o_orderstatus || '|' || o_orderpriority AS tags
        FROM orders"""),
    "metadata_residual": (metadata_residual, f"""
        SELECT CAST(event_id AS VARCHAR) AS external_id, 'note|props|user_id' AS metadata_keys,
               user_id, CAST({_K} AS BIGINT) AS k, true AS note_is_null
        FROM events"""),
    "validate_split": (validate_split, f"""
        SELECT source_name, external_id, errors = '' AS is_valid, errors, md5(title) AS title_md5
        FROM ({_CHECKED})"""),
    "reject_records": (reject_records, f"""
        SELECT 'normalization' AS phase, source_name, 'ValidationError' AS error_class,
               errors AS message, external_id, TIMESTAMP '2024-02-01' AS at
        FROM ({_CHECKED}) WHERE errors <> ''"""),
    "reject_reasons": (reject_counts, f"""
        SELECT source_name, errors AS error, count(*) AS records
        FROM ({_CHECKED}) WHERE errors <> '' GROUP BY ALL"""),
    "run_outcome": (outcome_by_source, """
        SELECT source AS source_name, count(*) AS records_extracted,
               count(*) FILTER (WHERE length(text) <= 500) AS records_loaded,
               count(*) FILTER (WHERE length(text) > 500) AS records_failed,
               count(*) FILTER (WHERE length(text) <= 500) AS distinct_keys_loaded,
               CASE WHEN max(length(text)) > 500 THEN 'partial' ELSE 'success' END AS status
        FROM documents GROUP BY source"""),
    "load_counts": (load_counts, """
        SELECT 'csv' AS source_type, event_type AS source_name, count(*) AS records_extracted,
               count(*) AS records_loaded, CAST(0 AS BIGINT) AS records_failed,
               count(DISTINCT user_id) AS distinct_keys_loaded, 'success' AS status
        FROM events GROUP BY event_type"""),
    "land_raw": (land_raw, f"""
        SELECT 'api' AS source_type, 'events' AS source_name,
               CAST(event_id AS VARCHAR) AS source_id, ts AS event_time,
               sha256('{{"id":' || event_id || ',"created_at":"' || {_EVENT_ISO} || '"}}')
                   AS content_hash,
               'run-1' AS etl_run_id, 'events' AS file_path, TIMESTAMP '2024-02-01' AS ingested_at
        FROM events"""),
    "csv_mixed_headers": (csv_mixed_headers, """
        SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS product_name,
               CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS category, p_partkey % 10 = 0 AS rejected
        FROM part"""),
    "feed_mixed": (feed_mixed, "SELECT page_id, 'p' || page_id AS title FROM pages"),
    "csv_scan": (csv_scan, """
        SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title,
               'say "' || p_brand || '",' || chr(10) || p_type AS description,
               CASE WHEN p_size > 25 THEN '-' ELSE p_type END AS category,
               p_retailprice AS amount, 'cost' AS metadata_keys
        FROM part"""),
    "feed_scan": (feed_scan, f"""
        SELECT CAST(page_id AS VARCHAR) AS external_id, {_PAGE_TITLE} AS title, url,
               {_PAGE_TIME} AS published_at
        FROM pages JOIN ({_FEEDS}) ON feed = page_id // 10 WHERE is_cut = 0"""),
    "feed_reject": (feed_reject, f"""
        SELECT feed, '1 entries do not parse' AS message FROM ({_FEEDS}) WHERE is_cut = 1"""),
}
