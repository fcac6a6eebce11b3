import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.packing import CAPACITY, Encoder, closest_fill, pack, sequences
from millrace.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoders():
    plain = Tokenizer.from_file(tokenizer_path())
    return Encoder(tokenizer_path()), lambda t: np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200) | st.text(" \n\t'sabcé1½漢\x1c\x85\u200b", max_size=80))
def test_ids_are_those_of_the_file(encoders, text):
    fast, plain = encoders
    assert fast(text) == plain(text)


def test_added_tokens_and_other_files(encoders):
    fast, plain = encoders
    text = "a<|endoftext|>b <|endoftext|>"
    assert fast(text) == plain(text)
    other = Encoder(tokenizer_path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode("Two Words", add_special_tokens=False).ids
    assert other("Two Words") == np.array(whole, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(lengths=st.dictionaries(st.integers(1, 60), st.integers(1, 4), max_size=6), room=st.integers(0, 120))
def test_the_fill_is_the_closest_one(lengths, room):
    chosen = closest_fill(sorted(lengths.items(), reverse=True), room)
    assert all(0 < count <= lengths[length] for length, count in chosen)
    sums = {0}
    for length, count in lengths.items():
        sums = {s + length * k for s in sums for k in range(count + 1)}
    assert sum(length * count for length, count in chosen) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(0, 400), max_size=60), capacity=st.sampled_from([16, 64]))
def test_every_id_lies_in_one_piece_and_little_is_padded(sizes, capacity):
    documents = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(sizes)]
    packed = list(sequences(iter(documents), capacity, pool=8, max_slack=1))
    pieces = sorted((key, start, ids) for pieces in packed for (key, _), start, ids in pieces)
    rebuilt = {i: b"" for i, n in enumerate(sizes) if n}
    for key, start, ids in pieces:
        assert ids and start == len(rebuilt[key]) // 4
        rebuilt[key] += ids
    assert rebuilt == {i: ids for i, ids in documents if ids}
    totals = [sum(len(ids) // 4 for *_, ids in pieces) for pieces in packed]
    assert all(total <= capacity for total in totals)
    # Only powers of two, and windows that are full but for the slack, unless nothing was left to cut.
    odd = [total for total in totals if total & (total - 1) and capacity - total > 1]
    assert len(odd) <= 1


def test_pieces_of_documents(spark, encoders):
    fast, _ = encoders
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "null id"), (4, "word " * 9_000), (5, "same"), (5, "same")]
    rows += [(100 + i, "text " * (37 * i % 900)) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, length string").repartition(2)
    pieces = pack(docs, tokenizer_path(), with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        ids = np.array(p.ids, "<u4").tobytes()
        assert (p.length, p.ids_crc32) == (len(p.ids), zlib.crc32(ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    for doc_id, text in rows:
        if doc_id == 5:
            continue
        whole = fast(text or "") + np.array([1], "<u4").tobytes()
        assert b"".join(ids for _, ids, _ in sorted(by_doc[doc_id])) == whole
        assert {n for *_, n in by_doc[doc_id]} == {len(whole) // 4}
    assert len(by_doc[5]) == 2
    padded = sum(CAPACITY - n for n in (sum(k for _, k in v) for v in by_sequence.values()) if n & (n - 1))
    assert padded < 0.01 * sum(p.length for p in pieces)
    assert pack(docs.limit(0), tokenizer_path()).collect() == []
