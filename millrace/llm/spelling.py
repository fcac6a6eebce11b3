"""Spelling variants: words that differ by one letter, grouped under the frequent form they go back to.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Near words are found in a
bit-sliced index: for every position and letter a bitset over a block of the vocabulary tells which words have that
letter there. A word runs over its letters once; four bitsets per block hold the words that fit so far without an
error, or with one, replaced, inserted (positions shifted by one) or deleted (shifted the other way). 64 words
advance with each machine word, and many words and blocks with each numpy call.

The vocabulary is partitioned so that a word meets only words it may be near to. Of a pair, the shorter word's
positions are cut into ``PIECES``; the error lies in one of them, so the letters before and after that piece are the
same, and these, with length and piece, are the key of a bucket. Each word lies in the buckets of all its pieces, as
the shorter and as the longer of a pair. Buckets are sorted, packed into blocks of 64 words and searched whole,
however large; a pair that is found more than once counts once. Frequent words were counted before, so a word is one row.

Null texts have no words. Ids only matter to ``change``. Ties go to the smallest word in code-point order. An empty
table gives no words. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form has at least so many times the word's occurrences.
FORM_FACTOR = 10
PIECES = 4
#: Letters indexed at a time, whole buckets; a larger bucket is indexed alone.
CHUNK_LETTERS = 1 << 18
#: Pairs of a word and a block that advance together.
TILE = 1 << 17


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    change: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """The words of all texts and their occurrences ``n``: longest runs of Latin letters, A-Z in lower case.

    ``change`` gets id and word and gives the word to count instead. Lengths are in code points.
    """
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit("[A-Za-zÀ-ÿ]{%d,}" % min_length), F.lit(0))
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.explode(runs).alias("_run"))
    found = found.withColumn("_run", F.translate("_run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    word = change(F.col("_id"), F.col("_run")) if change else F.col("_run")
    counted = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _bucketed(words: DataFrame, pieces: int = PIECES) -> DataFrame:
    """Every word once per bucket: its ``key``, a hash, which at worst adds words that are not near."""
    length = F.length("word")
    short = F.explode(F.array(length, length - 1))
    rows = words.select("word", "n", short.alias("_short"))
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    start = F.floor(F.col("_short") * F.col("_piece") / pieces).cast("int")
    end = F.floor(F.col("_short") * (F.col("_piece") + 1) / pieces).cast("int")
    tail = F.col("_short") - end
    key = F.xxhash64("_short", "_piece", F.left("word", start), F.right("word", tail))
    return rows.filter("_short > 0").select(key.alias("key"), "word", "n")


class BitIndex:
    """Bitsets over words, in blocks of 64, for each position and letter that occurs."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(word) for word in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(letters)) - self.starts[owner]
        self.blocks = -(-len(words) // 64)
        bit = np.uint64(1) << (owner % 64).astype(np.uint64)
        keys, here = np.unique(place << 21 | letters, return_inverse=True)
        # The last row is empty: no word has that letter there.
        self.sets = np.zeros((len(keys) + 1) * self.blocks, np.uint64)
        # Each bit is added once, so the sum is the union.
        np.add.at(self.sets, here * self.blocks + owner // 64, bit)

        def row(shift: int) -> np.ndarray:
            want = (place + shift) << 21 | letters
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return np.where(keys[at] == want, at, len(keys))

        # For every letter of every word: the bitset of that letter at its place, one to the right, one to the left.
        self.same, self.right, self.left = here, row(1), row(-1)
        longest = int(self.lengths.max()) + 2
        self.of_length = np.zeros((longest + 1, self.blocks), np.uint64)
        at = np.arange(len(words))
        np.add.at(self.of_length.reshape(-1), self.lengths * self.blocks + at // 64, np.uint64(1) << (at % 64).astype(np.uint64))

    def near(self, query: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of a word and a block, as numbers: the words and those of the block near to them."""
        order = np.argsort(-self.lengths[query], kind="stable")
        query, block = query[order], block[order]
        length, start = self.lengths[query], self.starts[query]
        exact = np.full(len(query), ~np.uint64(0))
        replaced, inserted, deleted = (np.zeros(len(query), np.uint64) for _ in range(3))
        for place in range(int(length[0])):
            # Words are in order of length, so those with a letter at this place come first.
            live = slice(0, np.searchsorted(-length, -place, side="left"))
            at, b, before = start[live] + place, block[live], exact[live].copy()
            here = self.sets[self.same[at] * self.blocks + b]
            replaced[live] = replaced[live] & here | before
            deleted[live] = deleted[live] & self.sets[self.left[at] * self.blocks + b] | before
            inserted[live] = (inserted[live] | before) & self.sets[self.right[at] * self.blocks + b]
            exact[live] = before & here
        inserted |= exact
        found = replaced & ~exact & self.of_length[length, block]
        found |= inserted & self.of_length[length + 1, block]
        found |= deleted & self.of_length[length - 1, block]
        hit = np.flatnonzero(found)
        bits = np.unpackbits(found[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        return query[hit[row]], block[hit[row]] * 64 + bit


def near_in_buckets(words: list[str], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near words of the same bucket, both ways, as numbers; buckets begin at ``starts``.

    Blocks may hold several buckets, so pairs across buckets can be among them, and pairs can come again.
    """
    index = BitIndex(words)
    ends = np.append(starts[1:], len(words))
    sizes = ends - starts
    first = np.repeat(starts // 64, sizes)
    count = np.repeat((ends - 1) // 64, sizes) - first + 1
    upto = np.cumsum(count)
    # Tiles of whole words; a word with more blocks than a tile is cut.
    for low in range(0, int(upto[-1]), TILE):
        pair = np.arange(low, min(low + TILE, int(upto[-1])))
        query = np.searchsorted(upto, pair, side="right")
        yield index.near(query, first[query] + pair - (upto - count)[query])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words out of rows sorted by key."""

    def searched(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table["key"].to_numpy()
        opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(opens, len(keys)))
        table = table.filter(pa.array(np.repeat(sizes > 1, sizes)))
        sizes = sizes[sizes > 1]
        if not len(sizes):
            return
        ends = np.cumsum(sizes)
        letters = np.cumsum(pc.utf8_length(table["word"]).to_numpy())[ends - 1]
        low = 0
        while low < len(sizes):
            base = letters[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(letters, base + CHUNK_LETTERS, side="right")))
            start = int(ends[low] - sizes[low])
            part = table.slice(start, int(ends[high - 1]) - start).combine_chunks()
            words, counts = part["word"], part["n"]
            for a, b in near_in_buckets(words.to_pylist(), (ends - sizes)[low:high] - start):
                found = pa.Table.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), counts.take(pa.array(b))], ["word", "near", "near_n"])
                yield from found.combine_chunks().to_batches()
            low = high

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        # The last bucket may go on in the next batch.
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from searched(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif held and held[-1].column(0)[0].as_py() != keys[0]:
            yield from searched(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from searched(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near, near_n) of words one edit apart, both ways; a pair may come more than once."""
    sorted_ = _bucketed(words).repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(_search, "word string, near string, near_n bigint")


def spelling_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """One row per word of (word, n): ``n_near``, its ``form`` and ``form_n`` if it has one, and its ``root``.

    The form is the near word with the largest n if that is at least ``factor`` times the word's, two or more;
    the root is the form of the form and so on.
    """
    if factor < 2:
        raise ValueError("a form has to be more frequent than its word, or forms may go round in circles")
    words = written(words.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    best = near_words(words).groupBy("word").agg(
        F.countDistinct("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best")
    )
    best = best.select("word", "n_near", F.col("_best.near").alias("_near"), (-F.col("_best.less")).alias("_near_n"))
    ahead = F.col("_near_n") >= factor * F.col("n")
    judged = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(ahead, F.col("_near")).alias("form"), F.when(ahead, F.col("_near_n")).alias("form_n"),
        ),
        "variants",
    )
    # Every link multiplies n by the factor, which bounds their number; following doubles what is behind.
    most, links = judged.agg(F.max("n")).first()[0] or 0, 0
    while factor ** (links + 1) <= most:
        links += 1
    roots = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < links:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        roots = written(
            roots.join(onward, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "roots"
        )
        reach *= 2
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
