"""Merkle manifest of a dataset: a tree of digests per group, a root over all groups, a proof per row.

A row's leaf is the SHA-256 of its columns, each written as its length in bytes, a colon and its value. Within a
group leaves are numbered by id; up to ``ARITY`` consecutive nodes become one node of the next level, until one
is left, the group's subroot. Subroots, by group, become the root in the same way.

Each level is one pass of lag and lead columns at fixed offsets. A node's slot in its run masks the lags and the
run's length masks the leads, so what is left are its siblings; the row of slot 0 hashes itself and its leads into
the parent. Windows lie in blocks of consecutive nodes, which hold whole runs, so no group is a window as a whole,
and every level has an eighth of the rows of the one below. On the way down each node hands its path of siblings
to its children, joined by place.

Null ids come first in their group, a null group is a group of its own and comes first, and null values have their
own mark in the leaf. Rows that are equal in id are ordered by leaf; equal rows are leaves of their own. An empty
table has no rows and no root. Further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.operators.slots import number_rows

from .common import written

ARITY = 8
#: Nodes in a window; whole runs, and few enough for a task.
BLOCK = 8**4

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts joined."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The leaf of a row with these columns, in this order."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(*map(field, columns))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the siblings ``_before`` and ``_after`` them, and the ``_parent`` at the first of each run."""
    near = W.partitionBy("_key", F.floor(F.col("_at") / BLOCK)).orderBy("_at")
    slot = F.col("_at") % arity
    run = F.least(F.lit(arity), F.col("_n") - F.col("_at") + slot)
    none = F.lit(b"")

    def side(columns: list[Column]) -> Column:
        return F.concat(none, *(F.coalesce(column, none) for column in columns))

    earlier = [F.when(slot >= k, F.lag("_digest", k).over(near)) for k in range(arity - 1, 0, -1)]
    later = [F.when(slot + k < run, F.lead("_digest", k).over(near)) for k in range(1, arity)]
    return nodes.withColumns({"_before": side(earlier), "_after": side(later)}).withColumn(
        "_parent", F.when(slot == 0, F.unhex(digest(_hex(F.col("_digest")), _hex(F.col("_after")))))
    )


def _levels(nodes: DataFrame, depth: int, arity: int) -> list[DataFrame]:
    """The written levels of all trees, leaves first. ``_n`` is the number of nodes of the tree at that level."""
    levels = []
    for level in range(depth + 1):
        levels.append(written(_siblings(nodes, arity), f"manifest-{level}"))
        nodes = levels[-1].filter((F.col("_n") > 1) & F.col("_parent").isNotNull()).select(
            "_key",
            F.floor(F.col("_at") / arity).alias("_at"),
            F.ceil(F.col("_n") / arity).alias("_n"),
            F.col("_parent").alias("_digest"),
        )
    return levels


def _depth(most: int, arity: int) -> int:
    """Levels above the leaves of a tree with that many."""
    depth = 0
    while most > 1:
        most, depth = -(-most // arity), depth + 1
    return depth


def _with_paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``_path``, their siblings level by level; ``tops`` has (_key, _top) with each tree's own path."""
    own = F.array(F.struct("_before", "_after"))
    above = None
    for level in reversed(levels):
        ends = level.filter(F.col("_n") == 1).join(tops, "_key")
        paths = ends.withColumn("_path", F.col("_top.path"))
        if above is not None:
            up = above.select("_key", F.col("_at").alias("_up"), F.col("_path").alias("_rest"), "_top")
            inner = level.filter(F.col("_n") > 1).withColumn("_up", F.floor(F.col("_at") / arity))
            inner = inner.join(up, ["_key", "_up"]).withColumn("_path", F.concat(own, "_rest"))
            paths = paths.unionByName(inner.drop("_up", "_rest"))
        above = paths
    return above


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    columns: Sequence[str] = COLUMNS,
    arity: int = ARITY,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, group, ``leaf``, ``subroot``, ``root``, ``path`` and ``proof_sha256``.

    ``path`` holds, level by level up to the root, the siblings before and after the node, as joined binary digests;
    ``proof_sha256`` is the digest of all of them in that order. ``extra`` names further columns to compute from
    ``docs`` and to keep.
    """
    if BLOCK % arity:
        raise ValueError(f"arity must divide {BLOCK}")
    extra = extra or {}
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{group_col}`").alias("_group"),
        # A key that is never null and sorts as the groups do, null first.
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("_key"),
        F.unhex(leaf_digest([F.col(f"`{name}`") for name in columns])).alias("_digest"),
        F.struct(F.lit(0), *(value.alias(name) for name, value in extra.items())).alias("_extra"),
    )
    leaves = written(leaves, "manifest-leaves")
    sizes = written(leaves.groupBy("_key").agg(F.count("*").alias("_n")), "manifest-groups")
    most, groups = sizes.agg(F.max("_n"), F.count("*")).first()
    places = number_rows(leaves, ["_key"], ["_id", "_digest"], to="_at").withColumn("_at", F.col("_at") - 1)
    levels = _levels(places.join(sizes, "_key"), _depth(most or 0, arity), arity)

    ends = [level.filter(F.col("_n") == 1).select("_key", "_digest") for level in levels]
    subroots = ends[0]
    for end in ends[1:]:
        subroots = subroots.unionByName(end)
    one = subroots.select(F.lit("").alias("_all"), F.col("_key").alias("_tree"), "_digest")
    one = number_rows(one, ["_all"], ["_tree"], to="_at").select(
        F.col("_all").alias("_key"), (F.col("_at") - 1).alias("_at"), F.lit(groups).alias("_n"), "_digest", "_tree"
    )
    upper = _levels(one, _depth(groups, arity), arity)
    root = upper[-1].filter(F.col("_n") == 1).select(
        "_key", F.struct(F.lit(None).cast(_PATH).alias("path"), F.col("_digest").alias("root")).alias("_top")
    )
    root = root.withColumn("_top", F.col("_top").withField("path", F.array().cast(_PATH)))
    tops = _with_paths(upper, root, arity).select(
        F.col("_tree").alias("_key"),
        F.struct(F.col("_path").alias("path"), F.col("_top.root").alias("root"), F.col("_digest").alias("subroot")).alias("_top"),
    )
    placed = _with_paths(levels, tops, arity)
    joined = F.aggregate("_path", F.lit(b""), lambda all_, s: F.concat(all_, s["_before"], s["_after"]))
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_group").alias(group_col),
        _hex(F.col("_digest")).alias("leaf"),
        _hex(F.col("_top.subroot")).alias("subroot"),
        _hex(F.col("_top.root")).alias("root"),
        F.col("_path").cast(_PUBLIC_PATH).alias("path"),
        F.sha2(_hex(joined), 256).alias("proof_sha256"),
        *(F.col("_extra")[name].alias(name) for name in extra),
    )


_PATH = "array<struct<_before:binary,_after:binary>>"
_PUBLIC_PATH = "array<struct<before:binary,after:binary>>"


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(_hex(s["before"]), node, _hex(s["after"])))
