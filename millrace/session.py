"""Session settings the library relies on, and the shared folder for cut lineage and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods beyond 8000 bytes; wide mappings run faster as smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call on a session that is already in use."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(scan: DataFrame, tasks: int, *by: str) -> DataFrame:
    """The rows of a scan over ``tasks`` tasks, for few or unsplittable files ahead of costly per-row work."""
    return scan.repartition(tasks, *by)


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A handful of rows that the driver has, as a local relation: reading or joining them starts no job.

    Dates and times are not taken.
    """
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    fields = to_arrow_schema(kind)
    cells = zip(*rows, strict=True) if rows else [()] * len(fields)
    columns = [
        pa.array([list(v.items()) if isinstance(v, dict) else v for v in column], field.type)
        for column, field in zip(cells, fields, strict=True)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kind)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` or ``SparkContext.setCheckpointDir`` names.

    Only a ``local`` session, whose executors are this process, may do without: it gets a temporary one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/millrace/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, materialised in the shared folder and cut off from their lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
