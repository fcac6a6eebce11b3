"""A curriculum: sources mixed to target weights that change over the training run.

A schedule gives every source's weight at knots of training time, 0 to 1, linear in between. Its integral is the
source's share of the words wanted in all; a target stops at ``max_epochs`` times the source's size, and the excess
goes to the others by weight. A source's demand up to a time is its integrated weight up to then, scaled to its target. Its
documents stand in an order drawn by hash; they supply its words in that order, epoch after epoch.
Inverting the cumulative demand at the first word of a document gives the training position of that
pass, and documents are range-sorted by position. The last document of a source is cut where the target is met.

Running sums go over hash slices, about the square root of the rows in number: one window adds up the
slices of a source, another the rows of a slice, so a source with a third of all rows is split evenly. Tables by source
or slice are joined as they come; Spark broadcasts them only below its threshold.

A document's size is its words; null and empty texts have size 0, are never taken and keep their row. A null source
is a source of its own, the last in order. Null or repeated ids are fine; equal rows are interchangeable. A source
of size 0, or one without positive weight, has target 0. An empty table gives an empty plan. Columns that
start with ``_mix_`` are reserved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, words, written

SHARE = 1.5
MAX_EPOCHS = 2
SIZE, ORDER, SOURCE, ID = "_mix_size", "_mix_order", "_mix_source", "_mix_id"


def drawn_order(key: Column, text: Column) -> Column:
    """60 bits of an MD5 over id and text: the order of a source's documents."""
    joined = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(joined, "UTF-8")), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with what mixing needs to know of each."""
    return docs.withColumns(
        {
            ID: F.col(id_col),
            SOURCE: F.col(source_col),
            SIZE: F.size(words(F.col(text_col))).cast("bigint"),
            ORDER: drawn_order(F.col(id_col), F.col(text_col)),
        }
    )


def source_sizes(docs: DataFrame) -> DataFrame:
    """(``source``, ``source_size``, ``rank``) of sized documents; ranks from 0 by code point, null last."""
    totals = docs.groupBy(F.col(SOURCE).alias("source")).agg(
        F.sum(SIZE).alias("source_size"), F.count(F.lit(1)).alias("documents")
    )
    # One row per source.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    return totals.withColumn("rank", F.row_number().over(by_name) - 1)


def integrated(knots: Column) -> Column:
    """Segments of an array of (``at``, ``weight``) knots, sorted by time: start, weights, length, area before."""
    ordered = F.sort_array(knots)
    segments = F.zip_with(
        F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))),
        F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda left, right: F.struct(
            left["at"].alias("at"),
            (right["at"] - left["at"]).alias("length"),
            left["weight"].alias("weight"),
            right["weight"].alias("next"),
            ((left["weight"] + right["weight"]) / 2 * (right["at"] - left["at"])).alias("area"),
        ),
    )
    return segments


def area(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda total, one: total + one["area"])


def inverted(segments: Column, wanted: Column) -> Column:
    """The time at which the integral of the weights reaches ``wanted``."""

    def step(state: Column, one: Column) -> Column:
        """Walk on while the area up to a segment's end stays below; the first beyond gives the time."""
        rest = wanted - state["before"]
        slope = (one["next"] - one["weight"]) / one["length"]
        root = F.sqrt(F.greatest(one["weight"] * one["weight"] + 2 * slope * rest, F.lit(0.0)))
        inside = one["at"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (one["weight"] + root))
        here = state["time"].isNull() & (one["area"] > 0) & (rest < one["area"])
        return F.struct(
            F.when(here, inside).otherwise(state["time"]).alias("time"),
            (state["before"] + one["area"]).alias("before"),
        )

    start = F.struct(F.lit(None).cast("double").alias("time"), F.lit(0.0).alias("before"))
    return F.coalesce(F.aggregate(segments, start, step)["time"], F.lit(1.0))


def targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (``source``, ``source_size``, ``segments``) with ``weight`` and ``target``.

    A source is full when the level, words per weight, reaches its cap. In the order in which they fill up, the level is
    the one that the first source not filled by it gives. One row per source.
    """
    weighted = sizes.withColumn("weight", area(F.col("segments"))).withColumn(
        "_mix_cap",
        F.when(F.col("weight") > 0, F.col("source_size") * F.lit(float(max_epochs))).otherwise(F.lit(0.0)),
    )
    filling = Window.orderBy("_mix_fills", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    before = F.coalesce(F.sum("_mix_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    beyond = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("_mix_total") - F.col("_mix_before")) / F.col("_mix_beyond")
    return (
        weighted.withColumn("_mix_fills", F.when(F.col("weight") > 0, F.col("_mix_cap") / F.col("weight")))
        .withColumns({"_mix_total": total, "_mix_before": before, "_mix_beyond": beyond})
        .withColumn("_mix_level", F.when(F.col("_mix_beyond") > 0, level))
        .withColumn(
            "_mix_level",
            F.max(F.when(F.col("_mix_level") <= F.col("_mix_fills"), F.col("_mix_level"))).over(everything),
        )
        .withColumn(
            "target",
            F.least("_mix_cap", F.coalesce(F.col("_mix_level") * F.col("weight"), F.col("_mix_cap"))),
        )
        .drop("_mix_cap", "_mix_fills", "_mix_total", "_mix_before", "_mix_beyond", "_mix_level")
    )


def assigned(docs: DataFrame, mixture: DataFrame, rows: int) -> DataFrame:
    """Sized documents with ``source_size``, ``target`` and ``passes`` (epoch, words taken, position).

    ``mixture`` has a row per source: ``source``, ``source_size``, ``segments``, ``weight``, ``target``.
    """
    bits = max(0, math.ceil(math.log2(max(rows, 1)) / 2))
    cut = docs.withColumn("_mix_slice", F.shiftright(ORDER, 60 - bits))
    slices = cut.groupBy(SOURCE, "_mix_slice").agg(F.sum(SIZE).alias("_mix_words"))
    earlier = Window.partitionBy(SOURCE).orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_mix_before", F.coalesce(F.sum("_mix_words").over(earlier), F.lit(0)))
    placed = written(
        slices.join(mixture, F.col(SOURCE).eqNullSafe(F.col("source"))).select(
            F.col(SOURCE).alias("_mix_s"), F.col("_mix_slice").alias("_mix_k"), "_mix_before",
            F.struct("source_size", "target", "weight", "segments").alias("_mix_of"),
        ),
        "slices",
    )
    above = (
        Window.partitionBy(SOURCE, "_mix_slice")
        .orderBy(ORDER, F.col(ID).asc_nulls_first(), SIZE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    want = F.floor(F.col("_mix_of.target") + 0.5)
    size, first = F.col("_mix_of.source_size"), F.col("_mix_before") + F.col("_mix_above")
    epochs = F.when(size > 0, F.ceil(want / size)).otherwise(F.lit(0))

    def one_pass(epoch: Column) -> Column:
        start = epoch * size + first
        taken = F.least(F.col(SIZE), F.greatest(want - start, F.lit(0)))
        wanted = start / F.col("_mix_of.target") * F.col("_mix_of.weight")
        return F.struct(
            epoch.alias("epoch"), taken.alias("taken"),
            inverted(F.col("_mix_of.segments"), wanted).alias("position"),
        )

    numbers = F.when(epochs > 0, F.sequence(F.lit(0).cast("bigint"), epochs - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return (
        cut.withColumn("_mix_above", F.coalesce(F.sum(SIZE).over(above), F.lit(0)))
        .join(placed, F.col(SOURCE).eqNullSafe(F.col("_mix_s")) & (F.col("_mix_slice") == F.col("_mix_k")))
        .withColumns(
            {
                "source_size": size,
                "target": F.col("_mix_of.target"),
                "passes": F.filter(F.transform(numbers, one_pass), lambda one: one["taken"] > 0),
            }
        )
        .drop("_mix_slice", "_mix_above", "_mix_s", "_mix_k", "_mix_before", "_mix_of")
    )


def mix(
    docs: DataFrame, schedule, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Sized documents with their passes. ``schedule`` maps the ``source_sizes`` table to one with ``knots``.

    ``docs`` is read three times; hand over a written table where making it is dear.
    """
    sizes = written(source_sizes(docs), "sources")
    rows = sizes.agg(F.sum("documents")).first()[0] or 0
    mixture = targets(schedule(sizes).withColumn("segments", integrated(F.col("knots"))), share, max_epochs)
    return assigned(docs, mixture.select("source", "source_size", "segments", "weight", "target"), rows)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    parts = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return let(parts, lambda found: F.array_join(F.slice(found, F.lit(1), n.cast("int")), ""))


def training_order(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per pass in range-sorted order of ``position``; a pass that takes part of a text has that part."""
    passes = mixed.select("*", F.explode("passes").alias("_mix_pass")).drop("passes")
    taken = F.col("_mix_pass.taken")
    return (
        passes.withColumn(
            text_col,
            F.when(taken < F.col(SIZE), first_words(F.col(text_col), taken)).otherwise(F.col(text_col)),
        )
        .withColumn("position", F.col("_mix_pass.position"))
        .withColumn("epoch", F.col("_mix_pass.epoch"))
        .drop("_mix_pass")
        .orderBy("position", ORDER)
    )
