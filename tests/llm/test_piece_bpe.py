import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from millrace.llm import piece_bpe
from millrace.llm.piece_bpe import Model, decode, encode
from millrace.llm.queries import op11_sentencepiece, tokenizer_path


@pytest.fixture(scope="module")
def models():
    path = tokenizer_path("piece_bpe_32k.model")
    return Model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def ids_of(model, texts):
    ids, counts = model.encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


runs = st.builds(lambda parts: "".join(c * n for c, n in parts), st.lists(st.tuples(st.sampled_from(" =-*ab\n▁"), st.integers(1, 70)), max_size=8))


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(max_size=60) | st.text(" aehinorst", max_size=200) | runs, min_size=1, max_size=5))
@example(texts=["", " ", "▁", "  <s> <0x41> \x00", "漢字かな😀", "a" * 3_000])
def test_ids_and_text_are_those_of_the_library(models, texts):
    model, library = models
    got = ids_of(model, texts)
    assert got == [library.encode(text) for text in texts]
    assert [model.decode(np.array([1, *ids, 2])) for ids in got] == [library.decode([1, *ids, 2]) for ids in got]


def test_long_words_go_on_one_merge_at_a_time(models, monkeypatch):
    model, library = models
    texts = [" " * 20_000 + "end", "word of words", "=" * 30_001, "ab" * 9_000, "x" + " " * 333]
    assert ids_of(model, texts) == [library.encode(text) for text in texts]
    monkeypatch.setattr(piece_bpe, "ROUNDS", 0)
    assert ids_of(model, texts) == [library.encode(text) for text in texts]


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.sampled_from([0, 1, 2, 29871, 263]) | st.integers(3, 258) | st.integers(0, 31_999), max_size=12))
def test_any_ids_are_decoded_like_the_library(models, ids):
    model, library = models
    assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_words_with_equal_sums_are_told_apart(models, monkeypatch):
    model, library = models
    texts = ["one two three two one", "vier fünf vier"]
    monkeypatch.setattr(piece_bpe.np, "unique", lambda *a, _unique=np.unique, **k: _unique(a[0] % 3 if a[0].dtype == np.uint64 else a[0], **k))
    assert ids_of(model, texts) == [library.encode(text) for text in texts]


def test_rows(spark, models, tmp_path):
    _, library = models
    rows = [(1, "a b"), (2, None), (3, ""), (None, "no id"), (4, "lång " * 300_000), (5, "same"), (5, "same")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string").repartition(2)
    path = tokenizer_path("piece_bpe_32k.model")
    expected = sorted((str(i), [1, *library.encode(t or ""), 2]) for i, t in rows)
    coded = encode(docs, path)
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == expected
    assert sorted((str(r.doc_id), r.text) for r in decode(coded, path).collect()) == sorted((str(i), t or "") for i, t in rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_sentencepiece(spark, str(tmp_path)).collect()]
    hashed = [
        (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        for i, ids in ((i, [1, *library.encode(t or ""), 2]) for i, t in rows)
    ]
    assert sorted(got, key=str) == sorted(hashed, key=str)
    assert encode(docs.limit(0), path).collect() == []
    assert decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), path).first().text == ""
