"""Near duplicates by HyperMinHash: banded compressed registers, estimate, then full comparison.

Texts are compared as sets of ``WINDOW``-word shingles with A-Z in lower case. Two documents are linked when the
Jaccard similarity of their sets is ``PERCENT`` or more; a component is what links reach.

1. *Classes.* Documents with equal sets form a class, known by a 128-bit digest of the set. From here on
   classes are compared, so groups of copies cost one row each.
2. *Registers.* A shingle hash falls into one of ``REGISTERS`` buckets; the bucket's smallest remainder is stored
   as 6 bits of leading zeros and ``MANTISSA`` bits after them, 16 in all. Empty buckets borrow from the next.
   ``PER_BAND`` registers make a 64-bit band key; ``BANDS`` of them miss a pair of similarity 0.75 with
   probability ``(1 - 0.75 ** 4) ** 40``, about 3e-7. Sets below ``BAND_MIN`` shingles are too small for that:
   for sets up to ``SMALL_MAX`` the rarest ``n - ceil(0.75 n) + 1`` shingles are keys as well, and two similar
   sets always share one of them. The bounds overlap, so every pair is covered by one of the two.
3. *Pairs.* Classes that share a key are candidates. First all are paired with one pivot per key, the class that
   shares most keys with others, and the verified links are joined to components. Classes with a key that
   several components still hold are paired once more, across components, by the rarest shingles of their
   full sets as above. Groups of near copies thus cost a pair per member, a passage in thousands of texts
   pairs none of them, and no link that could join two components stays unseen.
4. *Estimate.* Equal registers, corrected for chance collisions, estimate the similarity; pairs more than
   ``SIGMAS`` standard errors below the threshold are dropped, as are pairs of too different sizes.
5. *Verification.* The rest is confirmed on the full sets.

A null or empty text, or one without words, has an empty set and is linked with nothing. A text of fewer than
``WINDOW`` words has its whole sequence as its only shingle. Rows are told apart by their set, so repeated ids and
rows are fine; null ids count as larger than any other. Names that start with ``_near_`` are reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

WINDOW = 5
PERCENT = 75
PER_BAND, BANDS = 4, 40
REGISTERS = PER_BAND * BANDS
MANTISSA = 10
BAND_MIN, SMALL_MAX = 64, 96
SIGMAS = 6.0
CACHED_WORDS = 1 << 18

ID, KEY, N = "_near_id", "_near_set", "_near_n"


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds ``CACHED_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


# Odd multipliers: one per place of a window, and two that spread the sum over all bits.
_PLACES = tuple(
    np.uint64(xxhash.xxh3_64_intdigest(f"place {k}") | 1) for k in range(WINDOW)
)
_SPREAD = tuple(np.uint64(xxhash.xxh3_64_intdigest(f"spread {k}") | 1) for k in range(2))


def shingle_set(text: bytes | None, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    items = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not items:
        return np.empty(0, np.uint64)
    if len(items) < WINDOW:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(items), seed=1)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, items), np.uint64, len(items))
    last = len(h) - WINDOW + 1
    mixed = h[:last] * _PLACES[0]
    for k in range(1, WINDOW):
        mixed += h[k : k + last] * _PLACES[k]
    for multiplier in _SPREAD:
        mixed ^= mixed >> np.uint64(32)
        mixed *= multiplier
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


# The smallest hash of each bucket: bucket k holds the hashes from k * 2**64 / REGISTERS on.
_BOUNDS = np.array([-(-(k << 64) // REGISTERS) for k in range(REGISTERS)], np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The registers of a sorted, non-empty set, ``PER_BAND`` of 16 bits in each of ``BANDS`` longs."""
    first = np.searchsorted(hashes, _BOUNDS)
    low = hashes[np.minimum(first, len(hashes) - 1)]
    ends = np.append(first[1:], len(hashes))
    filled = np.flatnonzero(ends > first)
    # What remains of the hash below its bucket, as 64 bits; its float form gives zeros and mantissa.
    mantissa, exponent = np.frexp((low * np.uint64(REGISTERS)).astype(np.float64))
    zeros = np.minimum(64 - exponent, 63)
    bits = np.clip((mantissa * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1)
    registers = ((zeros.astype(np.int64) << MANTISSA) | bits.astype(np.int64)).astype(np.uint16)
    lender = filled[np.searchsorted(filled, np.arange(REGISTERS)) % len(filled)]
    return registers[lender].view(np.int64)


_SIGNATURES = T.StructType(
    [
        T.StructField(N, T.LongType()),
        T.StructField(KEY, T.BinaryType()),
        T.StructField("_near_bands", T.ArrayType(T.LongType())),
        T.StructField("_near_small", T.ArrayType(T.LongType())),
    ]
)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = _WordHashes()
    for batch in batches:
        yield batch, [shingle_set(text.as_py(), hashes) for text in batch.column(1)]


def _digest(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch, sets in _sets(batches):
        arrays = [
            batch.column(0),
            pa.array([len(one) for one in sets], pa.int64()),
            pa.array([_digest(one) for one in sets], pa.binary()),
            pa.array([band_keys(one) if len(one) >= BAND_MIN else [] for one in sets], longs),
            pa.array([one.view(np.int64) if len(one) <= SMALL_MAX else [] for one in sets], longs),
        ]
        yield pa.RecordBatch.from_arrays(arrays, [ID, *_SIGNATURES.names])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _sets(batches):
        arrays = [
            pa.array([_digest(one) for one in sets], pa.binary()),
            pa.array([one.view(np.int64) for one in sets], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, [KEY, "_near_full"])


def _signed(texts: DataFrame) -> DataFrame:
    schema = T.StructType([texts.schema[ID], *_SIGNATURES.fields])
    return written(texts.mapInArrow(_signatures, schema), "signatures")


def _classes(signed: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: ``cls``, digest, size, smallest id, band keys, small set."""
    grouped = (
        signed.filter(F.col(N) > 0)
        .groupBy(KEY)
        .agg(
            F.min(ID).alias(ID),
            # Equal within a class.
            *(F.first(name).alias(name) for name in (N, "_near_bands", "_near_small")),
        )
    )
    return written(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")


def _rare_keys(held: DataFrame) -> DataFrame:
    """(``shingle``, ``cls``, size, rank): of each set its rarest ``n - ceil(0.75 n) + 1`` that others hold too.

    ``held`` has a row per class and shingle, with the size of the set. Two similar sets share one of these
    at least, whatever the order of the shingles; from the rarest on, passages that many texts share come last.
    """
    shared = written(
        held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1), "shared"
    )
    own = Window.partitionBy("cls")
    rarer = F.row_number().over(own.orderBy("df", "shingle"))
    alone = F.col(N) - F.count(F.lit(1)).over(own)
    prefix = F.col(N) - F.ceil(F.col(N) * PERCENT / F.lit(100)) + 1
    return (
        held.join(shared, "shingle")
        .withColumn("rank", alone + rarer)
        .filter(F.col("rank") <= prefix)
        .select("shingle", "cls", N, "rank")
    )


def _memberships(classes: DataFrame) -> DataFrame:
    """(``bucket``, ``cls``, ``members``) of all keys that at least two classes share."""
    banded = classes.select("cls", F.posexplode("_near_bands").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("bucket"), "cls"
    )
    small = _rare_keys(classes.select("cls", N, F.explode("_near_small").alias("shingle")))
    small = small.select(F.xxhash64(F.lit(-1), F.col("shingle")).alias("bucket"), "cls")
    entries = banded.unionByName(written(small, "small-keys"))
    shared = written(
        entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1),
        "buckets",
    )
    return written(entries.join(shared, "bucket"), "memberships")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """(``a``, ``b``), a < b: every class with the pivot of each key it has."""
    weight = written(members.groupBy("cls").agg(F.sum("members").alias("weight")), "weights")
    pivots = written(
        members.join(weight, "cls")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", "cls")).getField("cls").alias("pivot")),
        "pivots",
    )
    return (
        members.join(pivots, "bucket")
        .filter(F.col("cls") != F.col("pivot"))
        .select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))
        .distinct()
    )


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(``cls``, ``component``) of the classes with a key that several components hold."""
    label = F.coalesce("component", "cls").alias("component")
    named = written(
        members.select("bucket", "cls").join(labels, F.col("cls") == F.col("node"), "left").select("bucket", "cls", label),
        "named",
    )
    open_ = written(
        named.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("bucket"),
        "open",
    )
    return written(
        named.join(open_, "bucket", "left_semi").groupBy("cls").agg(F.first("component").alias("component")),
        "unsettled",
    )


def _cross_pairs(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """(``a``, ``b``), a < b: classes of different components that may be similar.

    Only unsettled classes can be; ``sets`` holds theirs. Pairs come from the rarest shingles of the full
    sets, so that a passage in thousands of texts does not pair them all.
    """
    held = sets.select("cls", F.size("full").cast("bigint").alias(N), F.explode("full").alias("shingle"))
    keys = written(_rare_keys(held).join(unsettled, "cls"), "rare-keys")
    x, y = keys.alias("x"), keys.alias("y")
    # Shingles that two sets of these sizes share at least, were they similar; so many can't be left out before.
    share = F.ceil(PERCENT * (F.col(f"x.{N}") + F.col(f"y.{N}")) / F.lit(100.0 + PERCENT))
    return (
        x.join(
            y,
            (F.col("x.shingle") == F.col("y.shingle"))
            & (F.col("x.component") < F.col("y.component"))
            & (F.col("x.rank") <= F.col(f"x.{N}") - share + 1)
            & (F.col("y.rank") <= F.col(f"y.{N}") - share + 1),
        )
        .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
        .distinct()
    )


def estimated_similarity(left: Column, right: Column) -> Column:
    """Share of equal registers, less the share expected to be equal by chance."""
    lane = (1 << 16) - 1
    same = F.aggregate(
        F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda total, x: total
        + sum(
            (F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(lane)) == 0).cast("int")
            for k in range(PER_BAND)
        ),
    )
    chance = 2.0**-MANTISSA / 3  # equal zeros in a third of the cases, then equal mantissas
    return (same / F.lit(float(REGISTERS)) - chance) / (1 - chance)


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and registers do not rule out."""

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("cls").alias(name), F.col(N).alias(f"n_{name}"), F.col("_near_bands").alias(f"bands_{name}")
        )

    n = F.least("n_a", "n_b")
    empty = F.exp(-n / F.lit(float(REGISTERS)))
    # Borrowed registers are alike, so they count for less.
    registers = F.lit(float(REGISTERS)) * (1 - empty) / (1 + empty)
    threshold = PERCENT / 100
    allowed = threshold - SIGMAS * F.sqrt(F.lit(threshold * (1 - threshold)) / registers)
    alike = estimated_similarity(F.col("bands_a"), F.col("bands_b"))
    banded = (F.size("bands_a") > 0) & (F.size("bands_b") > 0)
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .filter(100 * n >= PERCENT * F.greatest("n_a", "n_b"))
        .filter(F.when(banded, alike >= allowed).otherwise(True))
        .select("a", "b", "n_a", "n_b")
    )


def _with_sets(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(``cls``, ``full``) of these classes; sets of long texts are made anew from one document each."""
    small = named.filter(F.col(N) <= SMALL_MAX).select("cls", F.col("_near_small").alias("full"))
    large = named.filter(F.col(N) > SMALL_MAX).select("cls", KEY, F.col(ID).alias("_near_first"))
    ids = large.select("_near_first").distinct()
    # Always by a shuffle: how many ids there are depends on the data.
    found = texts.join(ids.hint("merge"), F.col(ID).eqNullSafe(F.col("_near_first")), "left_semi").mapInArrow(
        _full_sets, "_near_set binary, _near_full array<bigint>"
    )
    made = (
        large.join(found, KEY)
        # Several documents of a class may share the id; rows lie by the digest already.
        .groupBy(KEY, "cls")
        .agg(F.first("_near_full").alias("full"))
        .select("cls", "full")
    )
    return written(small.unionByName(made), "sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = F.size(F.array_intersect("full_a", "full_b"))
    return (
        pairs.join(sets.select(F.col("cls").alias("a"), F.col("full").alias("full_a")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("full").alias("full_b")), "b")
        .filter(100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept`` (the id is the component's)."""
    texts = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("binary").alias("_near_text"))
    signed = _signed(texts)
    classes = _classes(signed)
    members = _memberships(classes)

    # From here on only classes that share a key with another matter.
    named = written(classes.join(members.select("cls").distinct(), "cls", "left_semi"), "candidates")
    sets = _with_sets(texts, named)
    tested = written(_pivot_pairs(members), "pairs")
    links = written(_linked(_plausible(tested, named), sets), "links")
    labels = components(links)

    unsettled = _unsettled(members, labels)
    open_sets = written(sets.join(unsettled, "cls", "left_semi"), "open-sets")
    crossing = _cross_pairs(unsettled, open_sets).join(tested, ["a", "b"], "left_anti")
    more = written(_linked(_plausible(crossing, named), open_sets), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    of_class = (
        classes.select("cls", KEY, ID)
        .join(labels, F.col("cls") == F.col("node"), "left")
        .select(KEY, ID, F.coalesce("component", "cls").alias("component"))
    )
    of_class = written(of_class, "class-components")
    first = of_class.groupBy("component").agg(F.min(ID).alias("component_id"))
    of_key = written(of_class.join(written(first, "component-ids"), "component").select(KEY, "component_id"), "of-key")
    component_id = F.when(F.col(N) == 0, F.col(ID)).otherwise(F.col("component_id"))
    return signed.select(ID, N, KEY).join(of_key, KEY, "left").select(
        F.col(ID).alias(id_col),
        F.col(N).alias("n_shingles"),
        component_id.alias("component_id"),
        F.col(ID).eqNullSafe(component_id).alias("kept"),
    )
