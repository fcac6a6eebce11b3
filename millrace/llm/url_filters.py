"""URL filters: host-suffix and path-prefix expressions, joined on short hashes, then confirmed.

A rule names a host and a path; it fits every url whose host is that host or below it and whose path starts
with that path. Both sides become *expressions* (host suffix + path prefix) with a SHA-256 digest. They
meet in an equi-join on the digest's first ``PREFIX_HEX`` hex digits; the full digest then confirms, and
the longest rule of those confirmed decides (ties: the longer host, then block before allow).

A url is expanded only into the shapes that occur among the rules: pairs (labels of the host, characters
of the path). Their number is bounded by ``MAX_LABELS * (MAX_PATH + 1)``, usually a handful, whatever the
length of the urls. Distinct rows are judged once, so a page that is repeated costs one judgement.

A null url, or one without ``://``, has an empty host and path and no rule. Nulls in the id column and repeated
rows are kept. A rule without a host, or beyond the bounds, is refused. Without rules every url gets ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
MAX_LABELS = 127
MAX_PATH = 2_048


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def expression_digest(host: Column, path: Column) -> Column:
    """The host's length stands first, so that no two pairs give the same bytes."""
    return F.sha2(F.encode(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), "UTF-8"), 256)


def expanded_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, verdict) with labels, path length, digest and rank; checked."""
    host, path = F.col("host"), F.coalesce(F.col("path"), F.lit(""))
    fits = (
        (F.length(host) > 0) & (labels(host) <= MAX_LABELS) & (F.length(path) <= MAX_PATH)
        & F.col("verdict").isin("allow", "block")
    )
    return rules.select(
        F.col("verdict").alias("_verdict"),
        F.concat(host, path).alias("_rule"),
        labels(host).alias("_labels"),
        F.length(path).alias("_chars"),
        F.length(host).alias("_host_chars"),
        F.when(F.coalesce(fits, F.lit(False)), expression_digest(host, path))
        .otherwise(F.raise_error(F.lit("a rule needs a host within the bounds and allow or block")))
        .alias("_digest"),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    listed = expanded_rules(rules)
    shapes = sorted((row[0], row[1]) for row in listed.select("_labels", "_chars").distinct().collect())
    urls = pages.select(
        F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path")
    )
    distinct = urls.groupBy("_id", "_host", "_path").agg(F.count(F.lit(1)).alias("_copies"))

    n, length = labels(F.col("_host")), F.length("_path")
    digests = F.array_compact(
        F.array(
            *(
                F.when(
                    (n >= parts) & (length >= chars),
                    expression_digest(
                        F.substring_index("_host", ".", -parts), F.substring("_path", 1, chars)
                    ),
                )
                for parts, chars in shapes
            )
        )
    )
    key = ["_id", "_host", "_path", "_copies"]
    probes = distinct.select(*key, F.explode_outer(digests if shapes else F.array().cast("array<string>")).alias("_expression"))
    rank = F.struct(
        F.length("_rule").alias("chars"),
        F.col("_host_chars").alias("host_chars"),
        (F.col("_verdict") == "block").alias("block"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )
    confirmed = F.col("_expression") == F.col("_digest")
    judged = (
        probes.withColumn("_prefix", F.substring("_expression", 1, PREFIX_HEX))
        .join(listed.withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX)), "_prefix", "left")
        .groupBy(*key)
        .agg(F.max(F.when(confirmed, rank)).alias("_best"))
    )
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
