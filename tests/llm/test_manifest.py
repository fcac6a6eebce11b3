import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest
from millrace.llm.manifest import COLUMNS, fold, leaf_digest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, _key string, _at string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes):
    """The root of these nodes, and for each of them its siblings (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] // 8 * 8
            run = nodes[first : first + 8]
            path.append((run[: at[k] - first], run[at[k] - first + 1 :]))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    trees = {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = (members, *climb([plain_leaf(r) for r in members]))
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, tops = climb([trees[g][1] for g in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        members, subroot, paths = trees[lang]
        for row, path in zip(members, paths, strict=True):
            siblings = [d for before, after in path + top for d in before + after]
            out.append((row[0], row[2], plain_leaf(row), subroot, root, h(*siblings)))
    return sorted(out, key=repr)


def rows_of(sizes, seed=1):
    draw = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            doc_id = draw.choice([None, *range(10 * n)])
            text = draw.choice([None, "", "Zoë\n" * draw.randrange(5), "x" * 50_000, "same"])
            rows.append((doc_id, draw.choice([None, "s"]), lang, draw.choice([None, 7]), text, "k", "a", "l"))
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"en": 1},
        {None: 65, "en": 8, "": 1, "zz": 64, "é": 3},
        {"en": 513, **{f"g{i}": 1 + i % 3 for i in range(9)}},
    ],
)
def test_manifest_equals_a_plain_one(spark, sizes):
    rows = rows_of(sizes)
    rows += rows[:2]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = manifest.manifest(docs)
    found = [tuple(r) for r in got.select("doc_id", "lang", "leaf", "subroot", "root", "proof_sha256").collect()]
    assert sorted(found, key=repr) == brute(rows)
    folded = got.select((fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"))
    assert folded.filter("same").count() == len(rows)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = rows_of({"en": 20, "fr": 11}, seed=3)
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = leaf_digest([F.lit("other") if c == "text" else F.col(c) for c in COLUMNS])
    got = manifest.manifest(docs, extra={"changed": changed, "text": F.col("text")})
    got = got.withColumn("back", fold(F.col("changed"), F.col("path")))
    assert got.filter("back = root").count() == 0
    assert got.filter("text IS NULL").count() == sum(r[4] is None for r in rows)


def test_other_columns_and_arity(spark):
    rows = spark.createDataFrame([(i, f"p{i % 2}", "v") for i in range(9)], "k int, part string, v string")
    got = manifest.manifest(rows, "k", "part", ["k", "v"], arity=2)
    assert {len(r.path) for r in got.collect()} == {3, 4}
    assert got.filter(fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 9


def test_an_empty_table_has_no_rows(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
