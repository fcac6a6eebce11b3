import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.quality import Estimate, Rule, judge, ordered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    counts = (
        n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
    )
    base = n < 10 or 100 * len(covered) > 20 * n
    rejected = (
        10 * counts[2] > n or counts[1] > 40 * n or 2 * counts[3] > len(text.split("\n"))
        or 2 * sum(text.count(c) for c in "!?") > n
        or sum(c.isupper() for c in text) > 3 * n
        or 4 * sum(a == b for a, b in zip(words, words[1:])) > n
        or 10 * sum(any(c.isalpha() for c in w) for w in words) < 4 * n
    )
    return (*counts, base, not base and not rejected)


PROSE = "The quick brown fox jumps over the lazy dog while seven small cats watch from a warm roof."
TEXTS = [
    None, "", " \t\n", "one two", PROSE, PROSE + "\n" + PROSE, PROSE.upper(), PROSE.replace(" ", "!! "),
    PROSE.replace(" ", " | "), "a b c d e f a b c d e x y z " * 3, "a " * 30, " ".join(map(str, range(40))),
    "word " * 9 + "\x85x\u00a0y", "𝔘𝔫𝔦 " + PROSE, "\n".join(["same line here"] * 9 + ["other line there"] * 2),
    " ".join(f"w{i}" for i in range(30_000)), ("abcdefghijkl" * 40 + " ") * 12,
]


def test_counts_and_verdicts_equal_brute_force(spark):
    rows = [(i if i % 4 else None, text, "x") for i, text in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    got = judge(docs).select("doc_id", "text", *quality.COUNTS, "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for row in got:
        assert tuple(row)[2:] == brute(row.text), row.text
    assert judge(docs.limit(0)).collect() == []


def test_the_order_follows_rejection_per_cost_among_the_undecided():
    rules = [Rule(name, F.lit(True)) for name in "abcd"]
    estimates = [
        Estimate(1.0, (True, True, False, False)),
        Estimate(0.1, (True, False, False, False)),
        Estimate(1.0, (False, True, True, False)),
        Estimate(0.5, (False, False, False, False)),
    ]
    assert [rule.name for rule in ordered(rules, estimates)] == ["b", "c", "d", "a"]
    assert [rule.name for rule in ordered(rules, [Estimate(1.0, ()) for _ in rules])] == ["a", "b", "c", "d"]


def test_later_rules_run_only_where_earlier_ones_did_not_reject(spark):
    docs = quality.measured(spark.createDataFrame([(1, "a b"), (2, PROSE)], "doc_id bigint, text string"))
    fails = Rule("raises", F.when(F.col("n_words") < 10, F.raise_error(F.lit("ran")).cast("boolean")).otherwise(False))
    first = Rule("short", F.col("n_words") < 10)
    rows = quality.cascade(docs, [fails], first).orderBy("doc_id").collect()
    assert [r.rejected_by for r in rows] == ["short", None]
    with pytest.raises(Exception, match="ran"):
        quality.cascade(docs, [first], fails).collect()
