import random
import re
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import near_dedup
from millrace.llm.components import components
from millrace.llm.near_dedup import near_duplicates

DOCS = "doc_id bigint, text string, component_id string"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(id, size, component, kept) per row, by comparing all sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, one in enumerate(sets):
        for shingle in one:
            holders[shingle].append(k)
    seen = set()
    for members in holders.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        parent[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(
        ((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str
    )


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def edited(draw, words, share):
    return [f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


def test_families_passages_and_edge_cases(spark):
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3_000)]
    fresh = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    texts = []
    # A large family whose members differ from the base and from each other, some beyond the threshold.
    base = fresh(180)
    texts += [base, *(edited(draw, base, draw.choice([0.01, 0.02, 0.03, 0.06, 0.3])) for _ in range(120))]
    # Chains: each member is like the one before.
    chain = fresh(120)
    for _ in range(12):
        chain = chain[4:] + fresh(4)
        texts.append(chain)
    # Short sets around the threshold, and lengths around the bounds of the two ways.
    for n in (5, 6, 7, 8, 9, 12, 20, 60, 66, 70, 90, 98, 101, 110, 130):
        short = fresh(n)
        texts += [short, short + fresh(1), short + fresh(2), short[1:], edited(draw, short, 0.03), [w.upper() for w in short]]
    # A passage that many unlike texts share.
    passage = fresh(70)
    texts += [fresh(40) + passage + fresh(40) for _ in range(60)]
    texts += [fresh(draw.randrange(1, 300)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(9_000, None), (9_001, ""), (9_002, " \n\t"), (9_003, "a b"), (9_004, "A  B\n"), (9_005, "a b c d e")]
    rows += [(9_100 + i, "copy of one text in many rows") for i in range(50)]
    rows += [(None, "copy of one text in many rows"), (None, "alone without an id"), (9_005, "a b c d e")]
    rows += [(9_300, " ".join(fresh(20_000)))]
    check(spark, rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_registers_estimate_the_similarity(spark):
    draw = np.random.default_rng(5)
    for shared, own in ((900, 100), (600, 400), (100, 900)):
        common = draw.integers(0, 2**64, shared, np.uint64)
        a, b = (np.unique(np.concatenate([common, draw.integers(0, 2**64, own, np.uint64)])) for _ in range(2))
        row = spark.createDataFrame(
            [(near_dedup.band_keys(a).tolist(), near_dedup.band_keys(b).tolist())], "a array<bigint>, b array<bigint>"
        )
        estimate = row.select(near_dedup.estimated_similarity(row.a, row.b)).first()[0]
        truth = shared / (shared + 2 * own)
        assert abs(estimate - truth) < 5 * (truth * (1 - truth) / near_dedup.REGISTERS) ** 0.5


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    links += [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)] + [(700, 700)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
