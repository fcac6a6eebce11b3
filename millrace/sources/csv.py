"""CSV files with a header line as records."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schemas import ORDINAL

# Cell texts that count as missing.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

RECORDS = T.StructType(
    [T.StructField("payload", T.StringType()), T.StructField("ordinal", ORDINAL)]
)


def header_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def _headers(spark: SparkSession, found: list[str], encoding: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header line, each header as its list of names; a file without a line has none."""
    lines = (
        spark.read.option("encoding", encoding).text(found)
        .select("_metadata.file_path", "value", F.monotonically_increasing_id().alias("pos"))
        .groupBy("file_path")
        .agg(F.min_by("value", "pos").alias("header"))
        .collect()
    )
    files: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(lines):
        names = tuple(next(csv.reader([row.header.removeprefix("\ufeff")]), [""]))
        files.setdefault(names, []).append(row.file_path)
    return files


def _scan(
    spark: SparkSession, paths: str | Sequence[str], encoding: str, multi_line: bool
) -> tuple[DataFrame | None, dict[tuple[str, ...], list[str]]]:
    """Rows by position (``_cell_0`` ...) with their place, and the files of every header."""
    found = [p for p in ([paths] if isinstance(paths, str) else paths) if _exists(spark, p)]
    headers = _headers(spark, found, encoding) if found else {}
    if not headers:
        return None, {}
    # One cell more than the widest header shows which lines are too long for their file.
    width = max(map(len, headers)) + 1
    schema = T.StructType([T.StructField(f"_cell_{i}", T.StringType()) for i in range(width)])
    rows = (
        spark.read.schema(schema)
        .options(header=True, encoding=encoding, multiLine=multi_line, escape='"')
        .csv(found)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_part"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_pos"),
        )
    )
    return rows, headers


def _by_header(headers: dict[tuple[str, ...], list[str]], build) -> Column:
    """``build(names)`` of the header that a row's file has."""
    if len(headers) == 1:
        return build(next(iter(headers)))
    chosen = F
    for names, files in headers.items():
        chosen = chosen.when(F.col("_part").isin(files), build(names))
    return chosen


def _too_long(headers: dict[tuple[str, ...], list[str]]) -> Column:
    return _by_header(headers, lambda names: F.col(f"_cell_{len(names)}").isNotNull())


def read_csv_source(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "UTF-8",
    multi_line: bool = True,
) -> DataFrame:
    """All columns of the files as text, header names normalised, missing cells as null.

    ``paths`` may be files, folders or globs; paths that do not exist give no rows. Every file is read
    by its own header, so their columns may differ in order and number; a column that a file lacks is
    null. A line with more cells than its header is left out, see :func:`csv_rejects`. Quoted cells may
    hold line breaks, so a file is one split; pass ``multi_line=False`` for files known to hold one
    record per line, which splits large files over many tasks.
    """
    rows, headers = _scan(spark, paths, encoding, multi_line)
    if rows is None:
        return spark.createDataFrame([], "_part string, _block bigint, _pos bigint")
    # Of two columns whose names become equal, the later one is kept.
    places = {names: {header_name(name): i for i, name in enumerate(names)} for names in headers}
    wanted = dict.fromkeys(name for names in headers for name in places[names])

    def cell(name: str) -> Column:
        def of(names: tuple[str, ...]) -> Column:
            at = places[names].get(name)
            return F.lit(None).cast("string") if at is None else F.col(f"_cell_{at}")

        return _by_header(headers, of)

    fitting = rows.filter(~_too_long(headers))
    named = fitting.select(*[cell(name).alias(name) for name in wanted], "_part", "_block", "_pos")
    return named.select(
        *[F.when(~F.col(f"`{name}`").isin(*MISSING_CELLS), F.col(f"`{name}`")).alias(name) for name in wanted],
        "_part",
        "_block",
        "_pos",
    )


def csv_rejects(
    spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8", multi_line: bool = True
) -> DataFrame:
    """Lines with more cells than their file's header: ``file_path``, ``block``, ``pos`` and the ``cells``.

    Cells beyond the first surplus one are not kept.
    """
    rows, headers = _scan(spark, paths, encoding, multi_line)
    if rows is None:
        return spark.createDataFrame([], "file_path string, block bigint, pos bigint, cells array<string>")
    cells = [c for c in rows.columns if c.startswith("_cell_")]
    kept = _by_header(headers, lambda names: F.array(*[F.col(c) for c in cells[: len(names) + 1]]))
    return rows.filter(_too_long(headers)).select(
        F.col("_part").alias("file_path"), F.col("_block").alias("block"), F.col("_pos").alias("pos"),
        kept.alias("cells"),
    )


def csv_records(rows: DataFrame) -> DataFrame:
    """Rows of :func:`read_csv_source` as JSON records; a missing cell stays as a present null."""
    data = [c for c in rows.columns if c not in ("_part", "_block", "_pos")]
    if not data:
        return rows.sparkSession.createDataFrame([], RECORDS)
    return rows.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in data]), {"ignoreNullFields": "false"}).alias("payload"),
        F.struct(
            F.col("_part").alias("part"), F.col("_block").alias("block"), F.col("_pos").alias("pos")
        ).alias("ordinal"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
