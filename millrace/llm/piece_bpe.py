"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A chunk of texts becomes one flat array of code points. It is cut wherever two neighbours stand side by side in no
piece of the model, since no merge can cross such a border; each different stretch ("word") is encoded once. The
words' symbols lie in one flat array. A round looks at all words at once: the best pair rank of each word by a
segmented minimum, all its occurrences from left to right without overlap, one new symbol for each, then
compaction. Where a merge makes a pair that would come before the occurrences to its right, these wait for the next
round, so the order is that of one merge at a time. Rounds end when no word has a pair left. Words that still have
some after ``ROUNDS``, such as a hundred thousand blanks, go on one merge at a time from a heap, in n log n.

Characters outside the model become byte pieces. Null and empty texts give the begin and end id alone. Rows are encoded
one by one, so null and repeated ids, ties and equal rows are kept as they are, and an empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Code points encoded at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20
ROUNDS = 100
_CODES = 0x110000
_NONE = np.iinfo(np.int32).max

#: Fixed: types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of several stretches, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Model:
    """The tables of a model file: a BPE with byte pieces, a blank put first and no other normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, {piece.type for piece in model.pieces}
        plain = (
            model.trainer_spec.model_type == proto.TrainerSpec.BPE and model.trainer_spec.byte_fallback
            and not model.trainer_spec.treat_whitespace_as_suffix and rules.add_dummy_prefix and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
            and not model.denormalizer_spec.precompiled_charsmap
        )
        if not plain or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte pieces, a leading blank and no normalisation are supported")
        names = [piece.piece for piece in model.pieces]
        self.types = np.array([piece.type for piece in model.pieces], np.int8)
        ids = {names[k]: k for k in np.flatnonzero(self.types == NORMAL).tolist()}
        # Characters that occur in pieces but are none themselves: symbols that can merge but have no id.
        letters = sorted({c for name in ids for c in name})
        symbols = dict(ids)
        for letter in letters:
            symbols.setdefault(letter, len(names) + len(symbols) - len(ids))
        self.n_ids = len(names)
        self.loose_codes = np.array([ord(c) for c in symbols if symbols[c] >= self.n_ids], np.int64)
        self.begin, self.end = names.index(model.trainer_spec.bos_piece), names.index(model.trainer_spec.eos_piece)
        self.byte_ids = np.array([names.index(f"<0x{byte:02X}>") for byte in range(256)], np.int32)

        # Symbols of code points; those that no piece contains are negative and never merge.
        self.of_code = -1 - np.arange(_CODES, dtype=np.int32)
        self.class_of = np.zeros(_CODES, np.int16)
        for k, letter in enumerate(letters):
            self.of_code[ord(letter)] = symbols[letter]
            self.class_of[ord(letter)] = k + 1
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for name in ids:
            row = self.class_of[[ord(c) for c in name]]
            self.together[row[:-1], row[1:]] = True

        ranks = np.unique(-np.array([piece.score for piece in model.pieces], np.float32), return_inverse=True)[1]
        self.n_symbols = len(names) + len(self.loose_codes)
        pairs = sorted(
            (symbols[name[:k]] * self.n_symbols + symbols[name[k:]], number)
            for name, number in ids.items() for k in range(1, len(name)) if name[:k] in symbols and name[k:] in symbols
        )
        self.pair_keys = np.array([key for key, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        made = np.array([number for _, number in pairs], np.int64)
        # Behind the last pair: none, with the worst rank.
        self.pair_made = np.append(made, -1).astype(np.int32)
        self.pair_rank = np.append(ranks[made], _NONE).astype(np.int32)
        self.no_pair = len(pairs)
        # Pieces that, once made, can be part of a pair that is no worse.
        own_rank = np.full(self.n_symbols, -1, np.int64)
        own_rank[: self.n_ids] = ranks
        self.hasty = np.zeros(self.n_symbols, bool)
        for side in (self.pair_keys[:-1] // self.n_symbols, self.pair_keys[:-1] % self.n_symbols):
            self.hasty[side[self.pair_rank[:-1] <= own_rank[side]]] = True

        shown = [
            bytes([int(name[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL
            else " ⁇ ".encode() if kind == UNKNOWN else name.replace(SPACE, " ").encode()
            for name, kind in zip(names, self.types.tolist(), strict=True)
        ]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_length = np.array([len(one) for one in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.leads = np.array([name.startswith(SPACE) for name in names]) & (self.types == NORMAL)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the pairs of these symbols in the tables, ``no_pair`` for those that make no piece."""
        key = left.astype(np.int64) * self.n_symbols + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, at, self.no_pair)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of each word when no pair remains, and their words, in order of words."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(symbols), self.no_pair)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair[inside] = self.pairs(symbols[inside], symbols[inside + 1])
        rounds = 0
        while len(symbols):
            rank = self.pair_rank[pair]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            ready = best == _NONE
            if ready.any():
                here = np.repeat(ready, length)
                done.append((symbols[here], word[here]))
                symbols, word, pair, rank = symbols[~here], word[~here], pair[~here], rank[~here]
                best, length = best[~ready], length[~ready]
                if not len(symbols):
                    break
            if rounds == ROUNDS:
                done += self._one_by_one(symbols, word)
                break
            rounds += 1
            chosen = np.flatnonzero(rank == np.repeat(best, length))
            # Of occurrences that overlap in a row every second one merges, from the left.
            steps = np.arange(len(chosen))
            opens = np.append(True, chosen[1:] != chosen[:-1] + 1)
            chosen = chosen[(steps - np.maximum.accumulate(np.where(opens, steps, 0))) % 2 == 0]
            made = self.pair_made[pair[chosen]]
            if self.hasty[made].any():
                keep = self._before_a_better_one(symbols, word, rank, chosen, made)
                chosen, made = chosen[keep], made[keep]
            symbols[chosen] = made
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            at = chosen - np.arange(len(chosen))
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            changed = np.union1d(at, at[at > 0] - 1)
            pair[changed] = self.no_pair
            inside = changed[changed < len(symbols) - 1]
            inside = inside[word[inside] == word[inside + 1]]
            pair[inside] = self.pairs(symbols[inside], symbols[inside + 1])
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(parts) for parts in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _before_a_better_one(self, symbols, word, rank, chosen, made) -> np.ndarray:
        """Which of these merges happen in this round: in each word those up to the first that makes a pair no worse."""
        n, owner = len(symbols), word[chosen]
        before, after = chosen - 1, np.minimum(chosen + 2, n - 1)
        left = symbols[np.maximum(before, 0)].copy()
        joined = np.flatnonzero(chosen[1:] == chosen[:-1] + 2) + 1
        left[joined] = made[joined - 1]
        left[(before < 0) | (word[np.maximum(before, 0)] != owner)] = -1
        right = np.where((chosen + 2 < n) & (word[after] == owner), symbols[after], -1)
        worst = rank[chosen]
        better = self.pair_rank[self.pairs(left, made)] <= worst
        better |= self.pair_rank[self.pairs(made, right)] <= worst
        opens = np.append(True, owner[1:] != owner[:-1])
        so_far = np.cumsum(better) - better
        return so_far == np.repeat(so_far[opens], np.diff(np.append(np.flatnonzero(opens), len(owner))))

    def _one_by_one(self, symbols: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for words with many merges that wait for one another: best pair first, from a heap."""
        for one in np.split(np.arange(len(symbols)), np.flatnonzero(word[1:] != word[:-1]) + 1):
            own, n = symbols[one].tolist(), len(one)
            after, before = [*range(1, n), -1], [-1, *range(n - 1)]
            table = {}

            def look(a: int, b: int) -> int:
                key = (own[a], own[b])
                if key not in table:
                    table[key] = int(self.pairs(np.array([key[0]]), np.array([key[1]]))[0])
                return table[key]

            heap = [(int(self.pair_rank[p]), k, own[k], own[k + 1], p)
                    for k in range(n - 1) if (p := look(k, k + 1)) != self.no_pair]
            heapq.heapify(heap)
            while heap:
                _, k, left, right, p = heapq.heappop(heap)
                next_ = after[k]
                if next_ < 0 or own[k] != left or own[next_] != right:
                    continue
                own[k], own[next_] = int(self.pair_made[p]), None
                after[k] = after[next_]
                if after[k] >= 0:
                    before[after[k]] = k
                after[next_] = -1
                for a, b in ((before[k], k), (k, after[k])):
                    if a >= 0 and b >= 0 and (p := look(a, b)) != self.no_pair:
                        heapq.heappush(heap, (int(self.pair_rank[p]), a, own[a], own[b], p))
            left_over = np.array([s for s in own if s is not None], np.int32)
            yield left_over, np.full(len(left_over), word[one[0]])

    def _to_ids(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their words; a symbol without an id becomes the bytes of its character."""
        out = (symbols < 0) | (symbols >= self.n_ids)
        if not out.any():
            return symbols, word
        codes = -1 - symbols[out].astype(np.int64)
        loose = symbols[out] >= self.n_ids
        codes[loose] = self.loose_codes[symbols[out][loose] - self.n_ids]
        size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        width = np.ones(len(symbols), np.int64)
        width[out] = size
        ids, raw = np.repeat(symbols, width), codes.astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[np.repeat(out, width)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        return ids, np.repeat(word, width)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the number of ids of each."""
        lengths = np.array([len(text) + 1 if text else 0 for text in texts], np.int64)
        total = int(lengths.sum())
        if not total:
            return np.zeros(0, np.int32), lengths
        joined = "".join(SPACE + text for text in texts if text).replace(" ", SPACE)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        classes = self.class_of[codes]
        opens = np.append(True, ~self.together[classes[:-1], classes[1:]])
        ends = np.cumsum(lengths)
        opens[(ends - lengths)[lengths > 0]] = True

        starts = np.flatnonzero(opens)
        sizes = np.diff(np.append(starts, total))
        word = np.cumsum(opens) - 1
        place = np.arange(total) - starts[word]
        # A random factor for each place; equal sums are looked at letter by letter below.
        factor = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        factor = (factor ^ (factor >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        factor = (factor ^ (factor >> np.uint64(27))) | np.uint64(1)
        sums = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * factor, starts)
        _, model_of, kind = np.unique(sums, return_index=True, return_inverse=True)
        same_size = sizes[model_of[kind]] == sizes
        mirror = np.where(same_size[word], starts[model_of[kind]][word] + place, 0)
        unlike = np.unique(word[(codes[mirror] != codes) | ~same_size[word]])
        if len(unlike):
            kind[unlike] = len(model_of) + np.arange(len(unlike))
            model_of = np.append(model_of, unlike)

        own = _gather(starts[model_of], sizes[model_of])
        merged = self.merge(self.of_code[codes[own]], np.repeat(np.arange(len(model_of)), sizes[model_of]))
        ids, of_word = self._to_ids(*merged)
        n_ids = np.bincount(of_word, minlength=len(model_of))
        each = n_ids[kind]
        flat = ids[_gather((np.cumsum(n_ids) - n_ids)[kind], each)]
        upto = np.append(0, np.cumsum(each))
        words_before = np.searchsorted(starts, ends)
        counts = np.diff(np.append(0, upto[words_before]))
        return flat.astype(np.int32), counts

    def decode(self, ids: np.ndarray) -> str:
        """The text of these ids, as the library gives it."""
        kinds = self.types[ids]
        raw = self.shown[_gather(self.shown_start[ids], self.shown_length[ids])].tobytes()
        seen = np.flatnonzero(kinds != CONTROL)
        if len(seen) and self.leads[ids[seen[0]]]:
            raw = raw[1:]
        if len(seen) and seen[-1] - seen[0] < len(seen):
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_broken(ids, kinds)

    def _decode_broken(self, ids: np.ndarray, kinds: np.ndarray) -> str:
        """Bytes that are no text, or apart: what can be read is, every other byte is the replacement character."""
        parts, run, first = [], b"", True
        for one, kind in [*zip(ids.tolist(), kinds.tolist(), strict=True), (None, None)]:
            if kind == BYTE:
                run += bytes([self.shown[self.shown_start[one]]])
                first = False
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if _readable(run[:n])), 0)
                parts.append(run[:size].decode() if size else "�")
                run = run[size or 1 :]
            if kind is None or kind == CONTROL:
                continue
            start, length = self.shown_start[one], self.shown_length[one]
            shown = self.shown[start : start + length].tobytes().decode()
            parts.append(shown[1:] if first and self.leads[one] else shown)
            first = False
        return "".join(parts)


def _readable(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text) + 1
    if chunk:
        yield chunk


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False
) -> DataFrame:
    """Per row its id and ``ids``, with begin and end id; ``packed``: as little-endian 32-bit binary instead of an array.

    ``model_path`` is read on every executor.
    """
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            texts, at = [text or "" for text in batch[1].to_pylist()], 0
            for chunk in _chunks(texts):
                ids, counts = model.encode(chunk)
                borders = np.cumsum(counts + 2)
                out = np.empty(int(borders[-1]), "<i4")
                inner = np.ones(len(out), bool)
                inner[borders - 1] = inner[borders - counts - 2] = False
                out[borders - counts - 2], out[borders - 1], out[inner] = model.begin, model.end, ids
                offsets = np.append(0, borders)
                if packed:
                    raw = pa.py_buffer(out.tobytes())
                    column = pa.Array.from_buffers(
                        pa.large_binary(), len(chunk), [None, pa.py_buffer((offsets * 4).astype(np.int64).tobytes()), raw]
                    ).cast(pa.binary())
                else:
                    column = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch[0].slice(at, len(chunk)), column], schema.names)
                at += len(chunk)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row its id, its ids as they came, and ``text``; null ids give an empty text."""
    fields = [encoded.schema[name] for name in (id_col, ids_col)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("text", T.StringType())])
    packed = isinstance(fields[1].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            texts = []
            for one in batch[1]:
                value = one.as_buffer() if packed else one.values
                ids = np.frombuffer(value or b"", "<i4") if packed else np.array([] if value is None else value, np.int32)
                texts.append(model.decode(ids))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string())], schema.names)

    return encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, schema)
