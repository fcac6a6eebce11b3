"""Packing token sequences by minimum bin slack.

Every document becomes its token ids and a closing id. Whole windows of ``CAPACITY`` ids are cut off and fill a
sequence each; what remains of a document, at most ``CAPACITY - 1`` ids, joins the pool of its task. A window
is filled with the longest remainder and the multiset of other remainders that comes closest to the
capacity: a subset-sum over the pool's lengths with multiplicities, one bitset of reachable sums per length,
from which the counts are traced back. If the best sum still leaves more than ``MAX_SLACK`` ids, a further
remainder is cut to fit. At the end of a task what is left, less than a window, is cut into sequences
whose lengths are powers of two and need no padding.

A task keeps at most ``POOL`` remainders, so its memory does not depend on the input, and nothing is
shuffled. ``sequence_id`` carries the task's number, so it is unique; a task that runs again builds its
sequences from the same rows. Null and empty texts consist of the closing id. Nulls and repeats among
the ids, and equal rows, are packed like any other. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2_048
CLOSING_ID = 1
POOL = 512
MAX_SLACK = 8
FLUSH_ROWS = 20_000

#: Fixed: the split of byte-level BPE before its merges.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: printable ones for themselves, then 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in own]
    return {chr(byte): byte for byte in own} | {chr(256 + k): byte for k, byte in enumerate(others)}


class Encoder:
    """Ids of a text, as little-endian 32-bit bytes, by a file of ``tokenizers``.

    A plain byte-level BPE whose merges are numbered in their order is run by ``tiktoken`` with the ranks of
    that file: the same ids in a quarter of the time. Any other file is run as it is.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer, self._ranked = Tokenizer.from_file(path), None
        kind = json.loads(self._tokenizer.to_str())
        model, split = kind["model"], kind["pre_tokenizer"] or {}
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model.get("merges", [])]
        plain = (
            kind["normalizer"] is None and split.get("type") == "ByteLevel"
            and split.get("use_regex", True) and not split.get("add_prefix_space")
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        )
        if plain:
            alphabet = _byte_alphabet()
            added = {token["content"]: token["id"] for token in kind["added_tokens"]}
            words = {token: k for token, k in model["vocab"].items() if token not in added}
            merged = [words.get(left + right, -1) for left, right in merges]
            simple = all(token["special"] and not token["single_word"] and not token["lstrip"]
                         and not token["rstrip"] for token in kind["added_tokens"])
            if simple and merged == sorted(merged) and all(c in alphabet for token in words for c in token):
                ranks = {bytes(alphabet[c] for c in token): k for token, k in words.items()}
                self._ranked = tiktoken.Encoding(
                    "ranks", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=added
                )

    def __call__(self, text: str) -> bytes:
        if self._ranked is not None:
            return self._ranked.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def closest_fill(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, count) pairs, within the counts given, whose sum is the largest up to ``room``.

    ``lengths`` are (length, available) by descending length. Bit s of ``sums`` tells that s can be
    reached; one bitset per length is kept for the way back.
    """
    mask, sums, before = (1 << (room + 1)) - 1, 1, []
    for length, available in lengths:
        if length > room:
            continue
        before.append((length, available, sums))
        left, step = min(available, room // length), 1
        while left > 0:
            taken = min(step, left)
            sums |= (sums << (taken * length)) & mask
            left -= taken
            step *= 2
        if sums >> room & 1:
            break
    target, chosen = sums.bit_length() - 1, []
    for length, available, earlier in reversed(before):
        count = 0
        while not earlier >> target & 1:
            target -= length
            count += 1
        if count:
            chosen.append((length, count))
    return chosen


class Pool:
    """Remainders by length. A remainder is (document, start, ids); a document is (id, its number of ids)."""

    def __init__(self, capacity: int, max_slack: int):
        self.capacity, self.max_slack = capacity, max_slack
        self.by_length: dict[int, list] = {}
        self.size = 0

    def add(self, document, start: int, ids: bytes) -> None:
        self.by_length.setdefault(len(ids) // 4, []).append((document, start, ids))
        self.size += 1

    def take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
        self.size -= 1
        return piece

    def cut(self, length: int) -> tuple:
        """The first ``length`` ids of the shortest remainder that is longer; the rest goes back."""
        document, start, ids = self.take(min(have for have in self.by_length if have > length))
        self.add(document, start + length, ids[4 * length :])
        return document, start, ids[: 4 * length]

    def window(self) -> list[tuple]:
        """Remainders that fill one window as closely as possible, the longest among them."""
        longest = max(self.by_length)
        pieces, room = [self.take(longest)], self.capacity - longest
        lengths = [(n, len(self.by_length[n])) for n in sorted(self.by_length, reverse=True)]
        for length, count in closest_fill(lengths, room):
            pieces += [self.take(length) for _ in range(count)]
            room -= length * count
        if room > self.max_slack and any(have > room for have in self.by_length):
            pieces.append(self.cut(room))
        return pieces

    def total(self) -> int:
        return sum(length * len(pieces) for length, pieces in self.by_length.items())

    def last(self) -> Iterator[list[tuple]]:
        """What is left, less than a window, as sequences whose lengths are powers of two."""
        pieces = [piece for n in sorted(self.by_length, reverse=True) for piece in self.by_length[n]]
        left = self.total()
        while left:
            room, sequence = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                document, start, ids = pieces.pop(0)
                n = min(room, len(ids) // 4)
                sequence.append((document, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    pieces.insert(0, (document, start + n, ids[4 * n :]))
                room -= n
            yield sequence


def sequences(
    documents: Iterator[tuple], capacity: int = CAPACITY, pool: int = POOL, max_slack: int = MAX_SLACK
) -> Iterator[list[tuple]]:
    """Sequences as lists of (document, start, ids) from (id, ids) pairs."""
    kept = Pool(capacity, max_slack)
    for key, ids in documents:
        n = len(ids) // 4
        document, whole = (key, n), n // capacity * capacity
        for start in range(0, whole, capacity):
            yield [(document, start, ids[4 * start : 4 * (start + capacity)])]
        if whole < n:
            kept.add(document, whole, ids[4 * whole :])
        if kept.size >= pool:
            while kept.size >= pool // 2 and kept.total() >= capacity:
                yield kept.window()
    while kept.total() >= capacity:
        yield kept.window()
    yield from kept.last()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    closing_id: int = CLOSING_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``with_ids`` adds the piece's ``ids``. ``tokenizer_path`` is read on every executor.
    """
    id_type = docs.schema[id_col].dataType
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n in longs)])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = Encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        id_arrow = None

        def documents():
            nonlocal id_arrow
            for batch in batches:
                id_arrow = batch.schema.field(0).type
                for k in range(batch.num_rows):
                    yield batch[0][k].as_py(), encode(batch[1][k].as_py() or "") + closing

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], id_arrow), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(c, "<i4") for c in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        rows = []
        for number, pieces in enumerate(sequences(documents(), capacity)):
            offset = 0
            for (key, tokens), start, ids in pieces:
                n = len(ids) // 4
                rows.append((key, start, n, zlib.crc32(ids), tokens, first + number, offset, *([ids] * with_ids)))
                offset += n
            if len(rows) >= FLUSH_ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
