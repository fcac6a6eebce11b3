"""Multi-party dialogues rendered from every participant's perspective, with loss masks.

For each speaker of a dialogue the dialogue is rendered once with that speaker as ``assistant`` and all others as
named users. The mask lists the spans (in characters, end exclusive) of the assistant's texts with their closing
marker: what a model that plays the speaker learns to write. Narrators (``system``) speak in
every rendering and are nobody's perspective.

A dialogue is rendered whole for everyone who speaks in it. One of more than ``PART_CHARS`` characters is cut into
parts of consecutive turns: a turn belongs to the part in which it starts, each turn counting its text, its role and
``TURN_CHARS``. Every part is rendered for all speakers of the dialogue, so it is whole in the result for each of them.
No task holds more than a part, and the output grows with turns times speakers.

With ``window`` a dialogue is first cut into windows of so many turn numbers, the length of a training example, and
each window is rendered for everyone who speaks in the dialogue, or with ``everyone=False`` for those who speak in the
window. A window in which so many turns share a number that it holds twice ``window`` turns or more is cut into parts
of consecutive turns, each of ``window`` to twice as many; the turns of a dialogue follow one another by (window, part).

Rows equal in dialogue, turn, role and text are one turn. Turns are ordered by number (null first), role, text. A
null role speaks as ``unknown``; a null text is empty; a null dialogue id is a dialogue of its own. Markers that
occur inside a text or a name are broken up, so no text can open a turn. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.operators.slots import in_slots, number_rows

from .common import written

PART_CHARS = 1 << 20
TURN_CHARS = 16
NARRATORS = ("system",)
OPEN, CLOSE = "<|", "|>"
END = f"{OPEN}end{CLOSE}\n"


def unmarked(text: Column) -> Column:
    """The text with every marker opening broken up."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def _header(role: Column, own: Column, narrators: tuple[str, ...]) -> Column:
    """What opens a turn of ``role`` when ``own`` is the assistant."""
    name = unmarked(F.regexp_replace(role, r"[\n\r]", " "))
    return (
        F.when(role == own, F.lit(f"{OPEN}assistant{CLOSE}\n"))
        .when(role.isin(*narrators), F.concat(F.lit(OPEN), name, F.lit(f"{CLOSE}\n")))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit(f"{CLOSE}\n")))
    )


def _turn_chars() -> Column:
    return F.length("text") + F.length("role") + TURN_CHARS


def _by_chars(dense: DataFrame, part_chars: int) -> DataFrame:
    """``part`` of the turns of long dialogues, from what comes before a turn; cut into slots, however long."""
    slotted = in_slots(dense.withColumn("_chars", _turn_chars()), ["_crowd"], ["turn", "role", "text"])
    earlier = W.partitionBy("_crowd").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slotted.groupBy("_crowd", "_slot").agg(F.sum("_chars").alias("_sum"))
    offsets = offsets.select("_crowd", "_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = W.partitionBy("_crowd", "_slot").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("_chars").over(within), F.lit(0))
    return slotted.join(offsets, ["_crowd", "_slot"]).withColumn("part", F.floor(before / part_chars))


def windows(
    turns: DataFrame,
    conv_col: str,
    turn_col: str,
    role_col: str,
    text_col: str,
    size: int | None = None,
    everyone: bool = True,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """(``conv``, ``window``, ``part``, ``turns``, ``speakers``): sorted arrays of (turn, role, text), and of roles."""
    distinct = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).distinct()
    placed = distinct.withColumn("window", F.floor(F.col("turn") / size) if size else F.lit(0).cast("bigint"))
    over = F.count(F.lit(1)) >= 2 * size if size else F.sum(_turn_chars()) > part_chars
    crowded = written(
        placed.groupBy(F.col("conv").alias("_conv"), F.col("window").alias("_window"))
        .agg(F.count(F.lit(1)).alias("_rows"), over.alias("_over"), F.collect_set("role").alias("_present"))
        .filter("_over")
        .drop("_over")
        .withColumn("_crowd", F.monotonically_increasing_id()),
        "crowded",
    )
    same_window = F.col("conv").eqNullSafe(F.col("_conv")) & F.col("window").eqNullSafe(F.col("_window"))
    if crowded.isEmpty():
        parted = placed.withColumn("part", F.lit(0).cast("bigint"))
    else:
        dense = placed.join(crowded.drop("_present"), same_window).drop("_conv", "_window")
        if size:
            numbered = number_rows(dense, ["_crowd"], ["turn", "role", "text"], "_place")
            numbered = numbered.withColumn("part", F.expr(f"(_place - 1) * (_rows div {size}) div _rows"))
        else:
            numbered = _by_chars(dense, part_chars)
        parted = (
            placed.join(crowded, same_window, "left_anti")
            .withColumn("part", F.lit(0).cast("bigint"))
            .unionByName(numbered.select(*placed.columns, "part"))
        )
    cut = parted.groupBy("conv", "window", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    cut = cut.join(crowded.select("_conv", "_window", "_present"), same_window, "left").drop("_conv", "_window")
    here = F.coalesce("_present", F.array_distinct(F.transform("turns", lambda one: one["role"])))
    if not everyone or not size:
        return cut.withColumn("speakers", here).drop("_present")
    # Dialogues of one window need no partner; only the others are joined.
    first, last, unnumbered = F.min("window"), F.max("window"), F.count_if(F.col("window").isNull())
    long = written(
        placed.groupBy(F.col("conv").alias("_conv"))
        .agg(
            ((first < last) | (first.isNotNull() & (unnumbered > 0))).alias("_several"),
            F.collect_set("role").alias("_all"),
        )
        .filter("_several")
        .select("_conv", "_all"),
        "long",
    )
    return (
        cut.join(long, F.col("conv").eqNullSafe(F.col("_conv")), "left")
        .withColumn("speakers", F.coalesce(F.col("_all"), here))
        .drop("_present", "_conv", "_all")
    )


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    window: int | None = None,
    narrators: tuple[str, ...] = NARRATORS,
    everyone: bool = True,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """A row per part and speaker: ids, ``perspective``, ``n_turns``, ``text``, ``mask`` (start, end).

    ``window`` is 0 for whole dialogues; ``everyone`` only matters with windows.
    """
    spoken = windows(turns, conv_col, turn_col, role_col, text_col, window, everyone, part_chars)
    speakers = F.filter("speakers", lambda role: ~role.isin(*narrators))
    seen = spoken.withColumn("perspective", F.explode(speakers))

    def piece(one: Column) -> Column:
        header = _header(one["role"], F.col("perspective"), narrators)
        body = F.concat(unmarked(one["text"]), F.lit(END))
        return F.struct(
            F.concat(header, body).alias("text"),
            F.length(header).alias("skip"),
            F.length(F.concat(header, body)).alias("length"),
            (one["role"] == F.col("perspective")).alias("own"),
        )

    def step(state: Column, one: Column) -> Column:
        span = F.struct((state["at"] + one["skip"]).alias("start"), (state["at"] + one["length"]).alias("end"))
        return F.struct(
            (state["at"] + one["length"]).alias("at"),
            F.when(one["own"], F.concat(state["mask"], F.array(span))).otherwise(state["mask"]).alias("mask"),
        )

    empty = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")
    )
    return seen.withColumn("_pieces", F.transform("turns", piece)).select(
        F.col("conv").alias(conv_col),
        "window",
        "part",
        "perspective",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("_pieces", lambda one: one["text"]), "").alias("text"),
        F.aggregate("_pieces", empty, step)["mask"].alias("mask"),
    )
