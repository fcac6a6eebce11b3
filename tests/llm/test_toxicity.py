import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.queries import op4_toxicity
from millrace.llm.toxicity import ASSOCIATION, NEIGHBOURS, Index, pooled, score_toxicity, words_of

SF_DIR = "/root/testdata/sf0.1"


def plain(docs, labels, learnable):
    """Scores and evidence by whole vectors and all similarities."""
    marks = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and learnable(i):
            marks[i] = max(marks.get(i, 0), toxic)
    texts = {}
    for i, text in docs:
        if i in marks:
            texts[i] = min(filter(None, (texts.get(i), text)), default=None)
    bags = {i: words_of(text) for i, text in texts.items()}
    terms, df = sorted({w for bag in bags.values() for w in bag}), Counter()
    for _, text in docs:
        df.update(words_of(text).keys())
    total, toxic = len(bags), sum(marks[i] for i in bags)
    share = toxic / total

    def factor(word):
        n = sum(word in bag for bag in bags.values())
        a = sum(marks[i] for i, bag in bags.items() if word in bag)
        cells = [(a, n * share), (n - a, n * (1 - share)), (toxic - a, (total - n) * share),
                 (total - toxic - n + a, (total - n) * (1 - share))]
        g2 = 2 * sum(x * math.log(x / e) for x, e in cells if x)
        return math.log(1 + len(docs) / df[word]) * (1 + ASSOCIATION * (math.sqrt(max(g2, 0)) if a > n * share else 0))

    factors = {word: factor(word) for word in terms}

    def unit(bag):
        vector = {w: (1 + math.log(n)) * factors[w] for w, n in bag.items() if w in factors}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        return {w: x / norm for w, x in vector.items()}

    units = {i: unit(bag) for i, bag in bags.items()}
    lead = {i: max(((x, w) for w, x in u.items()), default=(0, "")) for i, u in units.items()}
    order = sorted(units, key=lambda i: (marks[i], lead[i][1], i))

    def vote(vector, skip=None):
        near = [(round(sum(x * units[i].get(w, 0) for w, x in vector.items()), 9), -k) for k, i in enumerate(order) if i != skip]
        near = sorted((one for one in near if one[0] > 0), reverse=True)[:NEIGHBOURS]
        votes = [1 / (1.05 - min(s, 1)) for s, _ in near]
        found = [order[-k] for _, k in near]
        return (sum(v * marks[i] for v, i in zip(votes, found, strict=True)) + share) / (sum(votes) + 1), found

    curve = pooled([(vote(u, i)[0], marks[i]) for i, u in units.items() if u], share)
    bare = [marks[i] for i, u in units.items() if not u]
    out = []
    for i, text in docs:
        bag = words_of(text)
        vector = unit(bag) if any(w in factors for w in bag) else None
        if not vector:
            out.append((i, (sum(bare) + share) / (len(bare) + 1), []))
        else:
            raw, found = vote(vector)
            out.append((i, 0.999 * np.interp(raw, *curve) + 0.001 * raw, found[:3]))
    return out


def test_blocks_are_skipped_and_neighbours_exact():
    draw = np.random.default_rng(3)
    n, terms = 900, 300
    rows = []
    for k in range(n):
        own = draw.choice(np.arange(k // 90 * 30, k // 90 * 30 + 30), 6, replace=False)
        own = np.unique(np.append(own, draw.choice(terms, 2)))
        weights = draw.uniform(0.2, 5, len(own))
        rows += [(t, k, w) for t, w in zip(own, weights / np.sqrt(weights @ weights), strict=True)]
    rows.sort()
    term, example, weight = (np.array(c) for c in zip(*rows, strict=True))
    index = Index(term, example, weight, draw.integers(0, 2, n).astype(float), draw.uniform(0.5, 6, terms))
    dense = np.zeros((n, terms))
    dense[example, term] = weight
    for k in range(0, n, 7):
        own = np.flatnonzero(dense[k])
        weights = index.unit(own, draw.integers(1, 9, len(own)))
        similarity = dense[:, own] @ weights
        for top, skip in ((1, -1), (NEIGHBOURS, -1), (NEIGHBOURS, k)):
            expected = similarity.copy()
            expected[skip if skip >= 0 else []] = 0
            found, scores = index.nearest(own, weights, top, skip)
            assert np.allclose(scores, np.sort(expected)[::-1][: len(scores)])
            assert len(found) == min(top, int((expected > 0).sum())) and skip not in found
            assert np.allclose(scores, expected[found])
    assert index.skipped > 0.5 * index.scored


def test_texts_scored_together_have_the_neighbours_of_each_alone(monkeypatch):
    draw = np.random.default_rng(5)
    n, terms = 700, 400
    dense = draw.uniform(0.1, 3, (n, terms)) * (draw.random((n, terms)) < 0.5 / np.arange(1, terms + 1) ** 0.5)
    dense[draw.choice(n, 40)] = dense[3]
    dense[9] = 0
    dense /= np.maximum(np.sqrt((dense * dense).sum(axis=1, keepdims=True)), 1e-9)
    term, example = np.nonzero(dense.T)
    own = [np.sort(draw.choice(terms, size, replace=False)) for size in draw.integers(1, 60, 150)]
    skip = draw.integers(-1, n, len(own))
    for rows, at_once, together in ((1_024, 1 << 20, 64), (5, 300, 64), (0, 1, 7)):
        monkeypatch.setattr(toxicity, "ROWS", rows)
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        monkeypatch.setattr(toxicity, "TOGETHER", together)
        index = Index(term, example, dense.T[term, example], np.ones(n), np.ones(terms))
        assert index.rows.shape[1] <= rows
        queries = [(t, index.unit(t, draw.integers(1, 9, len(t)))) for t in own]
        got = list(index.search(queries, NEIGHBOURS, skip))
        assert len(got) == len(queries)
        for (t, weights), left, (found, scores) in zip(queries, skip, got, strict=True):
            expected = np.round(dense[:, t] @ weights, 9)
            expected[left if left >= 0 else []] = 0
            best = np.lexsort((np.arange(n), -expected))[:NEIGHBOURS]
            best = best[expected[best] > 0]
            assert np.array_equal(found, best) and np.allclose(scores, expected[best])


def test_scores_and_evidence_equal_a_plain_version(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(f"w{chr(97 + int(draw.paretovariate(1)) % 26)}{draw.choice('abc')}" for _ in range(draw.randrange(12)))
             + " vile" * (i % 5 == 0 and draw.random() < 0.8)) for i in range(260)]
    rows += [(None, "wa wb"), (7, "wz other"), (301, None), (302, ""), (303, "unseen wordsonly")]
    labels = [(i, int(i % 5 == 0)) for i in range(0, 200)] + [(3, 1), (4, None), (None, 1), (301, 0), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = score_toxicity(docs, marks, F.col("doc_id") % 4 != 2).collect()
    expected = plain(rows, labels, lambda i: i % 4 != 2)
    got = sorted(((r.doc_id, round(r.score, 6), list(r.evidence)) for r in got), key=repr)
    assert got == sorted(((i, round(float(s), 6), e) for i, s, e in expected), key=repr)


def test_planted_words_are_found_and_clean_texts_left(spark):
    draw = random.Random(8)
    bad = ["vile", "nasty", "awful", "rotten"]

    def text(toxic):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(20, 120))]
        for _ in range(4 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad) + draw.choice(["", "ly", "ness"]))
        return " ".join(words)

    labels = [(i, int(i % 6 == 0)) for i in range(600)]
    rows = [(i, text(toxic), toxic) for i, toxic in labels]
    rows += [(1_000, None, 0), (1_001, "", 0), (None, "vilely nastyness awful", 1), (1_002, "vile " * 20_000, 1), (5, "w1 w2", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    marks = spark.createDataFrame([*labels, (7, None), (None, 1), (2, 0)], "doc_id bigint, toxic int")
    scored = score_toxicity(docs, marks, F.col("doc_id") % 4 != 2)
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if r.doc_id is None or r.doc_id % 4 == 2 or r.doc_id >= 1_000]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all((r.predicted == 1) == (r.score >= 0.3) for r in got)
    evidence = {e for r in got for e in r.evidence}
    assert evidence and all(e % 4 != 2 for e in evidence)


def test_without_examples_or_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r.score, r.predicted) for r in score_toxicity(docs, labels, F.lit(True)).collect()] == [(0.0, 0)] * 2
    assert score_toxicity(docs.limit(0), labels, F.lit(True)).collect() == []


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = op4_toxicity(spark, SF_DIR).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.85 * sum(r.toxic for r in rows) and hits >= 0.85 * sum(r.predicted for r in rows)


def test_near_copy_without_a_toxic_word_is_found_by_its_words(spark):
    draw = random.Random(9)

    def text(n=60):
        return [f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{''.join(draw.choices('klmnprst', k=3))}" for _ in range(n)]

    rows = [(i, " ".join(text() + ["vile"] * (i % 6 == 0)), int(i % 6 == 0)) for i in range(300)]
    planted = text()
    rows += [(1_000, " ".join(planted), 1), (1_002, " ".join(planted[:-2] + text(2)), None)]
    rows += [(2_002 + 4 * i, " ".join(text()), None) for i in range(20)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in rows if t is not None], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, marks, F.col("doc_id") % 4 != 2).collect()}
    assert got[1_002].evidence[0] == 1_000
    assert all(r.evidence for r in got.values())
    assert got[1_002].score > max(r.score for i, r in got.items() if i > 2_000)


def test_toxic_words_are_learnt_where_most_labels_are_toxic(spark):
    draw = random.Random(10)

    def text(toxic):
        return " ".join([f"w{draw.randrange(50)}{draw.choice('abcdef')}" for _ in range(30)] + ["vile", "nasty"] * toxic)

    rows = [(i, text(i % 3 > 0), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    got = [r for r in score_toxicity(docs, marks, F.col("doc_id") % 4 != 2).collect() if r.doc_id % 4 == 2]
    toxic = [r.score for r in got if r.doc_id % 3 > 0]
    assert min(toxic) > max(r.score for r in got if r.doc_id % 3 == 0)
