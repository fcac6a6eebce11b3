"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The terms are the words (runs of letters, lower case) of the *examples*, a bounded sample of labelled documents. A
term of a document weighs ``(1 + ln tf) * ln(1 + N / df)`` with the document frequency in the whole table, times
``1 + ASSOCIATION * sqrt(G2)`` if the log-likelihood ratio G2 finds it more often among toxic examples; there is no
threshold. Vectors have length 1. Words of no example are no terms.

The index is built by Spark as one sorted table of postings and opened by the tasks; the driver never holds it.
Examples lie in blocks of ``BLOCK`` neighbours, alike ones together. Of rare terms a text adds up all postings. Terms of
many examples have their largest weight per block; these, on top of the best sum in a block, bound it. A text
scores the most promising blocks, and then only those whose bound reaches the k-th best score so far, so what is
skipped can't hold a neighbour. Texts are scored in groups, block by block. Similarities have 9 digits. Votes weigh
``1 / (1 + OFFSET - similarity)``, the label's base rate votes once with ``PRIOR``, and an isotonic fit on the
examples' own votes, each without itself, turns the result into a probability. Ties of similarity go to the example
that comes first by label, heaviest term and id. Texts without any term, empty ones too, get the rate of the examples without one. The nearest
examples are the evidence.

Only labelled rows that ``learnable`` selects are learnt from. Label rows with nulls are ignored; of several
labels for a document the greater counts, of several texts the smallest. Null and repeated ids and texts are fine:
every row is scored by its own text. Without examples every score is 0. The model is bounded by ``EXAMPLES`` documents
and ``POSTINGS`` terms of documents, whatever the input: examples are taken in the order of a hash of their id.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from millrace.session import fresh_path

from .common import written

#: Bounds of the sample of labelled rows.
EXAMPLES = 6_000
POSTINGS = 4_000_000
ASSOCIATION = 2.0
BLOCK = 64
NEIGHBOURS = 15
OFFSET, PRIOR = 0.05, 1.0
EVIDENCE = 3
THRESHOLD = 0.3
#: Share of the examples from which on a term has rows instead of postings, and the most terms that have.
DENSE, ROWS = 1 / 15, 1_024
#: Blocks scored before any is skipped.
FIRST_BLOCKS = 6
#: Texts scored at once, and their postings if there is more than one.
TOGETHER, AT_ONCE = 64, 1 << 20
CACHED_QUERIES = 1 << 14
#: Similarities closer than this are equal; rounding must not lose a tie.
ROUNDING = 1e-9

_LETTERS = re.compile(r"[^\W\d_]+")

#: Terms and their weights or counts.
Query = tuple[np.ndarray, np.ndarray]


def words_of(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


def read_shared(path: str) -> pa.Table:
    """A written table of the shared folder, opened inside a task."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    path = re.sub(r"^file:/+", "/", path)
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    files = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read() for f in sorted(files)])


class Index:
    """Unit vectors of examples by term: rows of weights per block for frequent terms, postings for all others."""

    def __init__(self, term: np.ndarray, example: np.ndarray, weight: np.ndarray, labels: np.ndarray, factors: np.ndarray):
        """Postings sorted by term and example; ``factors`` are the weights of terms apart from their counts."""
        self.factors, self.labels = factors, labels
        self.bare = np.bincount(example, minlength=len(labels)) == 0
        self.base = float(labels.mean()) if len(labels) else 0.0
        self.bare_rate = (float(labels[self.bare].sum()) + self.base) / (int(self.bare.sum()) + 1)
        self.n_blocks = -(-len(labels) // BLOCK)
        seen = np.bincount(term, minlength=len(factors))
        many = np.zeros(len(factors), bool)
        many[np.argsort(-seen, kind="stable")[:ROWS]] = True
        many &= seen >= max(DENSE * len(labels), 1)
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.rows = np.zeros((self.n_blocks, int(many.sum()), BLOCK))
        dense = many[term]
        at = example[dense]
        self.rows[at // BLOCK, self.row[term[dense]], at % BLOCK] = weight[dense]
        self.row_most = np.ascontiguousarray(self.rows.max(axis=2, initial=0.0).T)
        term, self.example, self.weight = term[~dense], example[~dense].astype(np.int32), weight[~dense]
        # Postings of term t: from first[t] up to first[t + 1].
        self.first = np.searchsorted(term, np.arange(len(factors) + 1))
        self.scored = self.skipped = 0

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.factors[terms]
        return weights / np.sqrt(weights @ weights)

    def _add(self, now: np.ndarray, own: np.ndarray, scores: np.ndarray) -> None:
        """What the frequent terms add to these blocks (by query and block)."""
        for block in np.flatnonzero(now.any(axis=0)):
            asking = np.flatnonzero(now[:, block])
            scores[asking, block] += own[asking] @ self.rows[block]
        self.scored += int(now.sum())

    def _together(self, queries: list[Query], k: int, skip: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, width = len(queries), self.n_blocks * BLOCK
        owner = np.repeat(np.arange(n), [len(terms) for terms, _ in queries])
        terms, weights = (np.concatenate(part) for part in zip(*queries, strict=True))
        row = self.row[terms]
        frequent = row >= 0
        own = np.zeros((n, self.rows.shape[1]))
        own[owner[frequent], row[frequent]] = weights[frequent]
        owner, terms, weights = owner[~frequent], terms[~frequent], weights[~frequent]
        lengths = self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[terms] - ends + lengths, lengths)
        scores = np.zeros(n * width)
        if len(at):
            place = self.example[at] + np.repeat(owner * width, lengths)
            scores = np.bincount(place, np.repeat(weights, lengths) * self.weight[at], n * width)
        scores.reshape(n, width)[skip >= 0, skip[skip >= 0]] = -np.inf
        scores = scores.reshape(n, self.n_blocks, BLOCK)
        bound = scores.max(axis=2) + own @ self.row_most
        most = min(FIRST_BLOCKS, self.n_blocks)
        chosen = np.argpartition(-bound, most - 1, axis=1)[:, :most]
        todo, now = bound > 0, np.zeros(bound.shape, bool)
        np.put_along_axis(now, chosen, True, axis=1)
        now &= todo
        self._add(now, own, scores)
        best = np.zeros(n)
        if most * BLOCK > k:
            best = np.partition(scores[np.arange(n)[:, None], chosen].reshape(n, -1), -k, axis=1)[:, -k].clip(0)
        todo &= ~now
        now = todo & (bound >= best[:, None] - ROUNDING)
        self._add(now, own, scores)
        self.skipped += int((todo & ~now).sum())
        # What a skipped block holds of a score is below its bound, so it drops out here.
        scores = scores.reshape(n, width)
        query, found = np.nonzero((scores > 0) & (scores >= best[:, None] - ROUNDING))
        similarity = np.round(scores[query, found], 9)
        order = np.lexsort((found, -similarity, query))
        edges = np.searchsorted(query, np.arange(n + 1))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            own_order = order[begin : min(begin + k, end)]
            yield found[own_order], similarity[own_order]

    def search(self, queries: list[Query], k: int, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` most similar examples with a common term, nearest first, and their similarities.

        ``TOGETHER`` queries are scored at once, or fewer as their postings reach ``AT_ONCE``.
        """
        skip = np.full(len(queries), -1) if skip is None else skip
        rare = [int((self.first[terms + 1] - self.first[terms]).sum()) for terms, _ in queries]
        begin = 0
        while begin < len(queries):
            end, held = begin + 1, rare[begin]
            while end < min(begin + TOGETHER, len(queries)) and held + rare[end] <= AT_ONCE:
                held += rare[end]
                end += 1
            yield from self._together(queries[begin:end], k, skip[begin:end])
            begin = end

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return next(self.search([(terms, weights)], k, np.array([skip])))

    def votes(self, counted: list[Query], skip: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray]]:
        """For each text's terms and counts the vote of its neighbours, and these."""
        queries = [(terms, self.unit(terms, counts)) for terms, counts in counted]
        for found, similarity in self.search(queries, NEIGHBOURS, skip):
            votes = 1 / (1 + OFFSET - np.minimum(similarity, 1.0))
            yield (float(votes @ self.labels[found]) + PRIOR * self.base) / (float(votes.sum()) + PRIOR), found


def pooled(votes: list[tuple[float, int]], base: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of labels to votes, smoothed by the base rate, as points of a line between the pools' middles."""
    pools: list[list[float]] = []
    for raw, label in sorted(votes):
        pools.append([label, 1.0, raw, raw])
        while len(pools) > 1 and (
            pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]
        ):
            y, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2], high]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return (
        np.array([(low + high) / 2 for _, _, low, high in pools]),
        np.array([(y + base) / (n + 1) for y, n, _, _ in pools]),
    )


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = words_of(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key.as_py()] * len(found), batch.schema.types[0]), pa.array(found.keys(), pa.string()),
                 pa.array(found.values(), pa.int32())], ["example", "word", "n"],
            )


def _vectors(docs: DataFrame, terms_path: str) -> DataFrame:
    """(first column, ``terms``, ``counts``) of texts; ``terms_path`` holds (word, term)."""
    ints = T.ArrayType(T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_shared(terms_path)
        number = dict(zip(table["word"].to_pylist(), table["term"].to_pylist(), strict=True))
        del table
        look = number.get
        for batch in batches:
            terms, counts, offsets = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [0]
            for text in batch.column(1):
                found = {look(word): n for word, n in words_of(text.as_py()).items()}
                found.pop(None, None)
                own = np.fromiter(found.keys(), np.int32, len(found))
                order = np.argsort(own)
                terms.append(own[order])
                counts.append(np.fromiter(found.values(), np.int32, len(found))[order])
                offsets.append(offsets[-1] + len(found))
            lists = [pa.ListArray.from_arrays(np.array(offsets, np.int32), np.concatenate(flat)) for flat in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], schema.names)

    schema = T.StructType([docs.schema.fields[0], T.StructField("terms", ints), T.StructField("counts", ints)])
    return docs.mapInArrow(run, schema)


class Fitted:
    """Where the model's tables are; ``open`` reads them inside a task."""

    def __init__(self, postings: str, examples: str, factors: str):
        self.paths, self.curve = (postings, examples, factors), (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def open(self) -> tuple[Index, list]:
        postings, examples, factors = map(read_shared, self.paths)
        examples, factors = examples.sort_by("number"), factors.sort_by("term")
        columns = [postings[name].to_numpy() for name in ("term", "number", "weight")]
        return Index(*columns, examples["toxic"].to_numpy().astype(float), factors["factor"].to_numpy()), examples["example"].to_pylist()


def _one_file(df: DataFrame, purpose: str, *order: str) -> str:
    """A sorted table of bounded size, written as one file."""
    path = fresh_path(df.sparkSession, purpose)
    df.repartition(1).sortWithinPartitions(*order).write.parquet(path)
    return path


def _sample(labels: DataFrame, texts: DataFrame, learnable: Column, id_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The examples (example, toxic) and their words (example, word, n)."""
    drawn = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learnable)
        .groupBy(F.col(id_col).alias("_tox_example"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_tox_example"), "_tox_example")
        .limit(EXAMPLES)
    )
    drawn = F.broadcast(written(drawn, "labelled"))  # at most EXAMPLES rows
    found = texts.join(drawn, F.col("_tox_id") == F.col("_tox_example"))
    found = found.groupBy("_tox_example").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    words = found.select("_tox_example", "text").mapInArrow(
        _example_words, T.StructType([T.StructField("example", found.schema[0].dataType), *_WORD_FIELDS])
    )
    words = written(words, "example-words")
    sizes = words.groupBy("example").count()
    # At most EXAMPLES rows in this window.
    so_far = F.sum(F.coalesce("count", F.lit(0))).over(W.orderBy(F.xxhash64("_tox_example"), "_tox_example"))
    kept = found.select("_tox_example", "toxic").join(sizes, F.col("example") == F.col("_tox_example"), "left")
    kept = written(
        kept.withColumn("_so_far", so_far).filter(F.col("_so_far") <= POSTINGS)
        .select(F.col("_tox_example").alias("example"), "toxic"),
        "examples",
    )
    return kept, words.join(F.broadcast(kept), "example")


_WORD_FIELDS = [T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType())]


def _association(a: Column, n: Column, toxic: int, total: int) -> Column:
    """Root of the log-likelihood ratio of a word in ``a`` of ``toxic`` and ``n`` of all examples; 0 if it is not more frequent there."""
    share = F.lit(toxic / total)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    b, none = n - a, total - n
    g2 = 2 * (
        part(a, n * share) + part(b, n * (1 - share))
        + part(toxic - a, none * share) + part(total - toxic - b, none * (1 - share))
    )
    return F.when(a > n * share, F.sqrt(F.greatest(g2, F.lit(0.0)))).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str, text_col: str, label_col: str) -> tuple[Fitted, DataFrame] | None:
    """(where the model is, written vectors of all documents), or None without examples."""
    texts = docs.select(F.col(f"`{id_col}`").alias("_tox_id"), F.col(f"`{text_col}`").alias("text"))
    examples, words = _sample(labels, texts, learnable, id_col, label_col)
    total, toxic = examples.agg(F.count("*"), F.sum("toxic")).first()
    if not total:
        return None
    terms = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n_examples"))
    # Bounded by POSTINGS, so one window numbers them.
    terms = terms.withColumn("term", F.row_number().over(W.orderBy("word")) - 1)
    terms_path = _one_file(terms, "terms", "term")
    terms = docs.sparkSession.read.schema(terms.schema).parquet(terms_path)
    rows = written(_vectors(texts, terms_path), "vectors")
    n_docs = max(rows.count(), 1)
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    factor = F.log(1 + n_docs / F.col("df")) * (1 + ASSOCIATION * _association(F.col("a"), F.col("n_examples"), toxic, total))
    factors_path = _one_file(terms.join(df, "term").select("term", factor.alias("factor")), "factors", "term")
    factors = docs.sparkSession.read.schema("term int, factor double").parquet(factors_path)

    weighted = written(
        words.join(terms.select("word", "term"), "word").join(factors, "term")
        .select("example", "term", ((1 + F.log("n")) * F.col("factor")).alias("weight"), "n"),
        "weighted",
    )
    norms = weighted.groupBy("example").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.max_by("term", F.struct("weight", "term")).alias("lead")
    )
    # Alike examples side by side: by label and heaviest term. At most EXAMPLES rows.
    numbered = examples.join(norms, "example", "left")
    numbered = numbered.withColumn("number", (F.row_number().over(W.orderBy("toxic", "lead", "example")) - 1).cast("int"))
    examples_path = _one_file(numbered, "numbered", "number")
    numbered = docs.sparkSession.read.schema(numbered.schema).parquet(examples_path)
    postings = weighted.join(F.broadcast(numbered.filter("norm > 0")), "example").select(
        "term", "number", (F.col("weight") / F.col("norm")).cast("double").alias("weight")
    )
    fitted = Fitted(_one_file(postings, "postings", "term", "number"), examples_path, factors_path)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _ = fitted.open()
        for batch in batches:
            numbers, *counted = (column.to_pylist() for column in batch.columns)
            counted = [(np.array(terms), np.array(counts)) for terms, counts in zip(*counted, strict=True)]
            votes = [raw for raw, _ in index.votes(counted, np.array(numbers))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.float64()), pa.array(index.labels[numbers].astype(np.int32))], ["raw", "label"]
            )

    own = weighted.join(F.broadcast(numbered.select("example", "number")), "example").groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("term", "n"))).alias("own")
    )
    votes = own.select("number", "own.term", "own.n").mapInArrow(own_votes, "raw double, label int")
    # Two numbers for each of at most EXAMPLES examples.
    fitted.curve = pooled([(row["raw"], row["label"]) for row in votes.collect()], toxic / total)
    return fitted, rows


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """A row per document: id, ``score``, ``predicted`` (1 from ``THRESHOLD`` on) and ``evidence`` (ids of examples).

    ``learnable`` is a condition on the columns of ``labels``.
    """
    evidence_type = labels.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("evidence", T.ArrayType(evidence_type)),
        ]
    )
    model = fit(docs, labels, learnable, id_col, text_col, label_col)
    if model is None:
        nothing = (F.lit(0.0), F.lit(0), F.array().cast(schema["evidence"].dataType))
        return docs.select(F.col(f"`{id_col}`"), *(c.alias(n) for c, n in zip(nothing, schema.names[1:], strict=True)))
    fitted, rows = model
    arrow_type = pa.list_(to_arrow_type(evidence_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (index, ids), known = fitted.open(), {}

        bare = index.bare_rate if index.base else 0.0, []

        def scored(counted: list[Query]) -> Iterator[tuple[float, list]]:
            for raw, found in index.votes(counted):
                # A little of the vote itself orders the documents within a pool.
                yield 0.999 * float(np.interp(raw, *fitted.curve)) + 0.001 * raw, [ids[i] for i in found[:EVIDENCE]]

        for batch in batches:
            columns = [batch.column(k) for k in (1, 2)]
            values = [column.values.to_numpy(zero_copy_only=False) for column in columns]
            edges = [column.offsets.to_numpy() for column in columns]
            keys, fresh = [], {}
            for k in range(batch.num_rows):
                terms, counts = (value[edge[k] : edge[k + 1]] for value, edge in zip(values, edges, strict=True))
                key = hashlib.sha256(terms.tobytes() + counts.tobytes()).digest() if len(terms) else None
                keys.append(key)
                if key is not None and key not in known:
                    fresh[key] = terms, counts
            if len(known) + len(fresh) > CACHED_QUERIES:
                known = {key: known[key] for key in known.keys() & set(keys)}
            known.update(zip(fresh, scored(list(fresh.values())), strict=True))
            scores, evidence = zip(*(bare if key is None else known[key] for key in keys), strict=True) if keys else ((), ())
            flags = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(flags, pa.int32()), pa.array(evidence, arrow_type)],
                schema.names,
            )

    return rows.mapInArrow(run, schema)
