"""RSS items and Atom entries as records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.parse import parse_rss_date

_TEXT = T.StringType()
_TEXT_NODE = T.StructType(
    [T.StructField("_VALUE", _TEXT), T.StructField("_type", _TEXT)]
)
_CATEGORY = T.StructType([T.StructField("_VALUE", _TEXT), T.StructField("_term", _TEXT)])
_LINK = T.StructType(
    [T.StructField("_VALUE", _TEXT), T.StructField("_href", _TEXT), T.StructField("_rel", _TEXT)]
)
_AUTHOR = T.StructType([T.StructField("_VALUE", _TEXT), T.StructField("name", _TEXT)])
_GUID = T.StructType([T.StructField("_VALUE", _TEXT), T.StructField("_isPermaLink", _TEXT)])

# Elements of an RSS item and of an Atom entry that feed a record; both forms share one schema.
ENTRY = T.StructType(
    [
        T.StructField("guid", _GUID),
        T.StructField("id", _TEXT),
        T.StructField("title", _TEXT_NODE),
        T.StructField("link", T.ArrayType(_LINK)),
        T.StructField("description", _TEXT_NODE),
        T.StructField("summary", _TEXT_NODE),
        T.StructField("author", _AUTHOR),
        T.StructField("dc:creator", _TEXT),
        T.StructField("pubDate", _TEXT),
        T.StructField("published", _TEXT),
        T.StructField("dc:date", _TEXT),
        T.StructField("updated", _TEXT),
        T.StructField("category", T.ArrayType(_CATEGORY)),
        T.StructField("content:encoded", _TEXT),
        T.StructField("content", T.ArrayType(_TEXT_NODE)),
    ]
)

_CORRUPT = "_corrupt_record"
_CLOSING = "</(?:[A-Za-z]+:)?(?:rss|rdf|RDF|feed)>"
_TAGS = ("item", "entry")


def _scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """RSS items and Atom entries of all files, numbered where they are read."""
    schema = T.StructType([*ENTRY.fields, T.StructField(_CORRUPT, _TEXT)])
    scans = [
        spark.read.format("xml")
        .options(rowTag=tag, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
        .schema(schema)
        .load([paths] if isinstance(paths, str) else list(paths))
        .select(
            "*", F.col("_metadata.file_path").alias("_part"), F.monotonically_increasing_id().alias("_pos")
        )
        for tag in _TAGS
    ]
    return scans[0].unionByName(scans[1])


def feed_rejects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files that are not well-formed feeds, one row each: ``file_path`` and a ``message``.

    A file is rejected when one of its entries does not parse or when its root element is not
    closed. Both checks stream over the file; none holds a whole feed in memory.
    """
    load = [paths] if isinstance(paths, str) else list(paths)
    # Spark parses only the columns a query uses, so the check uses all of them.
    whole = F.length(F.to_json(F.struct(*[F.col(f"`{name}`") for name in ENTRY.names]))) > 0
    broken = (
        _scan(spark, paths)
        .filter(F.col(_CORRUPT).isNotNull() & whole)
        .groupBy(F.col("_part").alias("file_path"))
        .agg(F.concat(F.count("*").cast("string"), F.lit(" entries do not parse")).alias("message"))
    )
    unclosed = (
        spark.read.text(load)
        .select(F.col("_metadata.file_path").alias("file_path"), "value")
        .groupBy("file_path")
        .agg(F.max(F.col("value").rlike(_CLOSING)).alias("closed"))
        .filter(~F.col("closed"))
        .select("file_path", F.lit("root element is not closed").alias("message"))
    )
    return (
        broken.unionByName(unclosed).groupBy("file_path").agg(F.min("message").alias("message"))
    )


def read_feed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Entries of the well-formed feeds among ``paths``, RSS and Atom alike; a malformed feed gives none."""
    entries = _scan(spark, paths)
    rejected = feed_rejects(spark, paths).select(F.col("file_path").alias("_part"))
    return entries.join(rejected, "_part", "left_anti").drop(_CORRUPT)


def parse_entries(entries: DataFrame, xml_col: str) -> DataFrame:
    """Entries from a column of XML text, one ``<item>`` or ``<entry>`` each; other columns stay.

    Text that does not parse gives a row whose ``entry`` is null.
    """
    schema = T.StructType([*ENTRY.fields, T.StructField(_CORRUPT, _TEXT)])
    parsed = F.from_xml(
        xml_col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    kept = [c for c in entries.columns if c != xml_col]
    whole = F.when(F.col("_entry")[_CORRUPT].isNull(), F.col("_entry"))
    return entries.select(*kept, parsed.alias("_entry")).select(*kept, whole.alias("entry"))


def entry_record(entry: Column | None = None) -> Column:
    """The record struct of an entry, from the columns of a scan or from one struct column."""

    def at(name: str) -> Column:
        return F.col(f"`{name}`") if entry is None else entry[name]

    def text(name: str) -> Column:
        return at(name)["_VALUE"]

    links = at("link")
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(
        F.get(F.transform(alternate, lambda x: F.coalesce(x["_href"], x["_VALUE"])), F.lit(0)),
        F.get(F.transform(links, lambda x: F.coalesce(x["_href"], x["_VALUE"])), F.lit(0)),
    )
    published = F.coalesce(
        parse_rss_date(F.coalesce(at("pubDate"), at("published"), at("dc:date"))),
        parse_rss_date(at("updated")),
    )
    content = F.coalesce(at("content:encoded"), F.get(at("content"), F.lit(0))["_VALUE"])
    return F.struct(
        F.coalesce(text("guid"), at("id"), link, F.lit("")).alias("id"),
        F.coalesce(text("title"), F.lit("")).alias("title"),
        F.coalesce(text("summary"), text("description"), F.lit("")).alias("description"),
        F.coalesce(link, F.lit("")).alias("link"),
        F.coalesce(text("author"), at("author")["name"], at("dc:creator"), F.lit("")).alias("author"),
        F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss").alias("published"),
        F.transform(
            F.coalesce(at("category"), F.array().cast(T.ArrayType(_CATEGORY))),
            lambda c: F.coalesce(c["_term"], c["_VALUE"], F.lit("")),
        ).alias("categories"),
        F.coalesce(content, F.lit("")).alias("content"),
    )


def feed_records(entries: DataFrame) -> DataFrame:
    """Entries of :func:`read_feed` in the form the landing step takes."""
    return entries.select(
        F.to_json(entry_record(), {"ignoreNullFields": "false"}).alias("payload"),
        F.struct(
            F.col("_part").alias("part"),
            F.lit(0).cast("bigint").alias("block"),
            F.col("_pos").alias("pos"),
        ).alias("ordinal"),
    )
