"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample.

``measured`` adds what the rules read: the words of the whole text and the base counts. ``estimate`` runs every
rule over a sample of at most ``SAMPLE_ROWS`` rows, times it and keeps its verdict per row; ``ordered``
then picks greedily the rule that rejects most of the still undecided sample per second. ``cascade`` evaluates the
rules in that order, each only for rows that none before it rejected. The order decides how fast the answer
comes and which of several failing rules is named, never whether a document is kept.

A null or empty text has no word and fails the base rule. A rule that gives null does not reject. Ids may
be null or repeated; every row is judged by itself, without a shuffle. An empty table leaves the rules in
the order given. Names that start with ``_q_`` are reserved, and the added columns replace any of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, let, words

#: Bounds of the sample that fixes the order of the rules; it has no other effect.
SAMPLE_ROWS = 200
SAMPLE_FRACTION = 0.25
WINDOW = 5
SYMBOLS = "#*$%&|<>"
WORDS, TEXT = "_q_words", "_q_text"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which ``reject`` holds; it may read the base counts, ``WORDS`` and ``TEXT``."""

    name: str
    reject: Column


@dataclass(frozen=True)
class Estimate:
    """Seconds for the sample, and per sampled row whether the rule rejects it."""

    cost: float
    rejects: tuple[bool, ...]


def without(text: Column, characters: str) -> Column:
    """Code points left when these characters are removed."""
    return F.length(F.translate(text, characters, ""))


def repeated_words(items: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found at least twice in the list."""

    def covered(starts: Column) -> Column:
        """Words under windows at these sorted starts; overlaps count once."""
        steps = F.transform(
            starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def starts(ordered: Column) -> Column:
        """Starts of the windows whose hash a neighbour in hash order shares, sorted."""
        shared = F.transform(
            ordered,
            lambda one, k: F.when(
                (one.h == F.get(ordered, k - 1).h) | (one.h == F.get(ordered, k + 1).h), one.at
            ),
        )
        return F.sort_array(F.array_compact(shared))

    def counted(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at")))
        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            let(F.sort_array(placed), lambda ordered: let(starts(ordered), covered)),
        ).otherwise(F.lit(0))

    def windows(hashes: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(first, lambda k: F.xxhash64(*(F.get(hashes, k + j) for j in range(WINDOW))))

    hashes = F.transform(items, lambda word: F.xxhash64(word))
    return F.when(
        F.size(items) >= WINDOW, let(hashes, lambda all_: let(windows(all_), counted))
    ).otherwise(F.lit(0))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, and with ``TEXT`` and ``WORDS`` for the rules."""
    text, found = F.col(TEXT), F.col(WORDS)
    counts = {
        "n_words": F.size(found),
        "word_chars": without(text, SPACE_CHARS),
        "n_symbols": F.length(text) - without(text, SYMBOLS),
        "n_dup_lines": repeated_lines(text),
        "n_repeat_words": repeated_words(found),
    }
    return (
        docs.withColumn(TEXT, F.coalesce(F.col(text_col), F.lit("")))
        .withColumn(WORDS, words(F.col(TEXT)))
        .withColumns({name: count.cast("bigint") for name, count in counts.items()})
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)


def default_rules() -> list[Rule]:
    """Rules that ordinary prose of any script passes with a wide margin."""
    n, text, found = F.col("n_words"), F.col(TEXT), F.col(WORDS)
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    doubled = F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: a == b)
    lettered = F.filter(found, lambda word: word.rlike(r"\p{L}"))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("long_words", F.col("word_chars") > 40 * n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(F.split(text, "\n"))),
        Rule("exclamations", 2 * (F.length(text) - without(text, "!?")) > n),
        Rule("capitals", capitals > 3 * n),
        Rule("doubled_words", 4 * F.size(F.filter(doubled, lambda same: same)) > n),
        Rule("few_lettered_words", 10 * F.size(lettered) < 4 * n),
    ]


def estimate(docs: DataFrame, rules: Sequence[Rule], first: Column) -> list[Estimate]:
    """Cost and verdicts of each rule over a sample of the measured rows that ``first`` does not reject.

    Each probe is a ``take``: it reads as many partitions as it needs for the sample, not the table.
    """
    sampled = docs.sample(SAMPLE_FRACTION, seed=11).select(TEXT, WORDS, *COUNTS)

    def probe(*columns: Column) -> tuple[float, list]:
        began = time.perf_counter()
        rows = sampled.select("n_words", *columns).limit(SAMPLE_ROWS).collect()
        return time.perf_counter() - began, rows

    verdicts = [F.coalesce(rule.reject, F.lit(False)).alias(f"_q_{k}") for k, rule in enumerate(rules)]
    rows = [row for row in probe(*verdicts, F.coalesce(first, F.lit(False)).alias("_q_first"))[1] if not row["_q_first"]]
    base = min(probe()[0] for _ in range(2))
    floor = 1e-3
    return [
        Estimate(max(probe(verdict)[0] - base, floor), tuple(row[f"_q_{k}"] for row in rows))
        for k, verdict in enumerate(verdicts)
    ]


def ordered(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """Greedily by rejections among the rows still undecided, per cost; ties keep the order given."""
    left = list(range(len(rules)))
    open_rows = set(range(max((len(e.rejects) for e in estimates), default=0)))
    order = []
    while left:
        gain = {k: sum(estimates[k].rejects[row] for row in open_rows) / estimates[k].cost for k in left}
        # Rules that reject nothing more in the sample go last, the cheapest first.
        best = max(left, key=lambda k: (gain[k], -estimates[k].cost if gain[k] == 0 else 0.0, -k))
        order.append(rules[best])
        left.remove(best)
        open_rows -= {row for row in open_rows if estimates[best].rejects[row]}
    return order


def cascade(docs: DataFrame, rules: Sequence[Rule], first: Rule) -> DataFrame:
    """``docs`` with ``rejected_by`` (null: kept): ``first``, then ``rules``, each only where none before hit."""
    branch = F.when(F.coalesce(first.reject, F.lit(False)), F.lit(first.name))
    for rule in rules:
        branch = branch.when(F.coalesce(rule.reject, F.lit(False)), F.lit(rule.name))
    return docs.withColumn("rejected_by", branch.otherwise(F.lit(None).cast("string")))


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``rejected_by`` and ``kept``."""
    rules = default_rules() if rules is None else list(rules)
    counted = measured(docs, text_col)
    if len(rules) > 1:
        rules = ordered(rules, estimate(counted, rules, base_failed()))
    judged = cascade(counted.withColumn("base_failed", base_failed()), rules, Rule("base", F.col("base_failed")))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop(TEXT, WORDS)
