"""Exact duplicates: frequent digests are settled by a broadcast, the others by one shuffle.

A Misra-Gries summary (``DataFrame.freqItems`` keeps at most ``1 / support`` counters) names every digest
that more than ``support`` of the rows share. One pass counts the named digests exactly and finds their
winners; that table has at most ``1 / support`` rows, whatever the input, and is broadcast. Rows of
frequent digests are settled by it inside their map task. What is left has no group above ``support`` of
the rows and goes through an ordinary shuffle by digest.

Of equal texts the row with the largest id stays. A null text counts as empty, a null id is smaller than
any other. Of rows that share id and text one stays, whichever. An empty table gives an empty one. Other
columns are carried along; names that start with ``_dedup_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Digests that more than this part of all rows share are settled by broadcast: 1,000 at most.
SUPPORT = 0.001

KEY, ID, ROW = "_dedup_digest", "_dedup_id", "_dedup_row"
SIZE, BEST = "_dedup_size", "_dedup_best"


def text_sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes; a null text counts as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, digest and a row number of every document, written once so that the text is read once."""
    return written(
        docs.select(
            F.col(id_col).alias(ID),
            text_sha256(F.col(text_col)).alias(KEY),
            F.monotonically_increasing_id().alias(ROW),
        ),
        "digests",
    )


def frequent_winners(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digest, size and best (id, row) of each digest that more than ``support`` of the rows share."""
    total = keyed.count()
    named = keyed.freqItems([KEY], support).select(F.explode(f"{KEY}_freqItems").alias(KEY))
    return written(
        keyed.join(F.broadcast(named), KEY, "left_semi")
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias(SIZE), F.max(F.struct(ID, ROW)).alias(BEST))
        .filter(F.col(SIZE) > support * total),
        "frequent",
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    keyed = _keyed(docs, id_col, text_col)
    frequent = F.broadcast(frequent_winners(keyed, support))
    group = Window.partitionBy(KEY)
    settled = keyed.join(frequent, KEY)
    rest = (
        keyed.join(frequent, KEY, "left_anti")
        .withColumn(SIZE, F.count(F.lit(1)).over(group))
        .withColumn(BEST, F.max(F.struct(ID, ROW)).over(group))
    )
    return settled.unionByName(rest).select(
        F.col(ID).alias(id_col),
        F.col(f"{BEST}.{ID}").alias("keep_id"),
        F.col(SIZE).alias("group_size"),
        (F.col(ROW) == F.col(f"{BEST}.{ROW}")).alias("kept"),
        F.col(KEY).alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The documents without the rows that lose against an equal text, all columns kept.

    Losers of frequent digests go before the shuffle; the shuffle moves every other row once.
    """
    frequent = frequent_winners(_keyed(docs, id_col, text_col), support).select(
        KEY, SIZE, F.col(f"{BEST}.{ID}").alias(ID)
    )
    ranked = Window.partitionBy(KEY).orderBy(F.col(id_col).desc_nulls_last())
    return (
        docs.withColumn(KEY, text_sha256(F.col(text_col)))
        .join(F.broadcast(frequent), KEY, "left")
        .filter(F.col(SIZE).isNull() | F.col(id_col).eqNullSafe(F.col(ID)))
        .withColumn("_dedup_rank", F.row_number().over(ranked))
        .filter(F.col("_dedup_rank") == 1)
        .select(*docs.columns)
    )

