"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import fresh_path

#: A word is a longest run of other characters than space, tab, line feed, \\v, \\f and \\r.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, with no lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often and wherever ``body`` uses it."""
    return F.transform(F.array(value), body)[0]
