import json

from pyspark.sql import functions as F

from checks.common import raw_rows


def raw_of(spark, kind, records, name="source"):
    """Raw rows of JSON-able records, in order."""
    texts = [r if isinstance(r, str) else json.dumps(r) for r in records]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, payload string")
    return raw_rows(rows, kind, F.lit(name), F.col("payload"), F.col("i"))


def in_order(df, *columns):
    return [tuple(r) for r in df.orderBy("ordinal").select(*columns).collect()]
