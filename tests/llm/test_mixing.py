import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.queries import by_thirds

DOCS = "doc_id bigint, text string, source string, position string"


def water(sizes, weights, total, cap):
    """Targets by giving out what is left until none is above its cap."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= cap * sizes[s]}
        if not full:
            return target | {s: weights[s] * level for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], DOCS)


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 11}") for i in range(400)]
    rows += [(900, None, "s1"), (901, "", None), (None, "a b c", None), (902, "long " * 20_000, "tiny"), (5, "w w", "s1")]
    docs = corpus(spark, rows).repartition(4)
    mixed = mixing.mix(mixing.sized(docs), by_thirds).collect()
    assert len(mixed) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    targets = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = dict.fromkeys(sizes, 0)
    for row in mixed:
        got = sum(p.taken for p in row.passes)
        size = len((row.text or "").split())
        assert got <= 2 * size and (row._mix_size, row.source_size) == (size, sizes[row.source])
        assert math.isclose(row.target, targets[row.source], rel_tol=1e-9, abs_tol=1e-9)
        assert all(0 <= p.position <= 1 for p in row.passes)
        taken[row.source] += got
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 0.5
    again = mixing.mix(mixing.sized(docs.repartition(7)), by_thirds).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text, str(r.passes))
    assert sorted(map(key, mixed), key=str) == sorted(map(key, again), key=str)


def test_positions_invert_the_cumulative_demand(spark):
    knots = F.array(*[
        F.struct(F.lit(at).alias("at"), F.lit(w).alias("weight"))
        for at, w in ((0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (0.75, 0.0), (1.0, 2.0))
    ])
    wanted = [0.0, 0.1, 0.5, 0.9, 1.0, 1.1, 1.2, 1.25]
    rows = spark.createDataFrame([(w,) for w in wanted], "w double").select(
        "w", mixing.inverted(mixing.integrated(knots), F.col("w")).alias("t"), mixing.area(mixing.integrated(knots)).alias("a")
    ).collect()

    def demand(t):
        if t <= 0.25:
            return 8 * t * t
        if t <= 0.5:
            return 1.0 - 8 * (0.5 - t) ** 2
        return 1.0 if t <= 0.75 else 1.0 + 4 * (t - 0.75) ** 2

    assert all(math.isclose(r.a, 1.25) for r in rows)
    assert all(math.isclose(demand(r.t), r.w, abs_tol=1e-12) for r in rows)
    assert [r.t for r in rows] == sorted(r.t for r in rows)


def test_order_and_cut_texts(spark):
    rows = [(i, f"one two  three\nfour d{i} ", f"s{i % 2}") for i in range(9)]
    ordered = mixing.training_order(mixing.mix(mixing.sized(corpus(spark, rows)), by_thirds)).collect()
    places = [r.position for r in ordered]
    assert places == sorted(places)
    texts = {i: t for i, t, _ in rows}
    cut = [r for r in ordered if r.text != texts[r.doc_id]]
    assert len(cut) <= 2 and all(texts[r.doc_id].startswith(r.text) for r in cut)
    # s0 is full at twice its size; what s1 takes is the rest.
    words = sum(len(r.text.split()) for r in ordered)
    assert abs(words - 1.5 * 45) <= 1
    assert {r.epoch for r in ordered} == {0, 1}


def test_first_words(spark):
    text = " a  b\tc \n"
    rows = spark.range(1, 5).select("id", mixing.first_words(F.lit(text), F.col("id")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [" a", " a  b", " a  b\tc", text]


@pytest.mark.parametrize("rows", [[], [(1, None, "s")], [(1, "", None), (None, None, None)]])
def test_nothing_to_take(spark, rows):
    mixed = mixing.mix(mixing.sized(corpus(spark, rows)), by_thirds).collect()
    assert len(mixed) == len(rows) and all(not r.passes and r.target == 0 for r in mixed)


def test_words_are_those_of_the_contract(spark):
    text = "a\x0bb\x0cc\rd\te f\x85g\u00a0h"
    (row,) = mixing.sized(corpus(spark, [(1, text, "s")])).collect()
    assert row._mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", text))
