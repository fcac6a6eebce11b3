"""The corpus pipeline: quality rules, exact and near duplicates, a curriculum of sources, packing.

Every stage reads what its predecessor wrote. All but the last return the columns of ``documents`` as they came,
whatever further columns there are. A document without text fails the quality rules; null ids and sources pass as
values of their own. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, near_dedup, packing, quality
from millrace.llm.common import table, written
from millrace.llm.queries import by_thirds, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    judged = quality.judge(docs.select(F.struct("*").alias("_doc"), "text"))
    return judged.filter("kept").select("_doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id.

    Rows that share an id stay together.
    """
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("kept")
    kept = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per pass over a document, in training order; a text that is taken in part has its first words.

    ``n_chars`` follows a text that is cut. Documents beyond their source's target are not taken.
    """
    # Texts travel once: the other columns in one struct, out of reach of the mixture's own names.
    rest = F.struct(*(F.col(f"`{name}`") for name in docs.columns if name != "text"))
    packed = docs.select(rest.alias("_doc"), F.length("text").alias("_chars"), "doc_id", "text", "source")
    ordered = mixing.training_order(mixing.mix(mixing.sized(packed), by_thirds))
    chars = F.length("text")
    changed = {
        "text": F.col("text"),
        "n_chars": F.when(chars < F.col("_chars"), chars).otherwise(F.col("_doc.n_chars")),
    }
    return ordered.select(
        *(changed.get(f.name, F.col(f"_doc.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields)
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows


#: Token ids can't be had in SQL; the tests compare with a plain version.
ORACLE_SQL = None
