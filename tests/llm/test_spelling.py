import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import spelling
from millrace.llm.spelling import near_in_buckets, spelling_variants, vocabulary


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, factor=10):
    rows = {}
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best and counts[best] >= factor * n else None
        rows[word] = (n, len(others), form, counts[form] if form else None)
    out = []
    for word, row in rows.items():
        root = word
        while rows[root][2]:
            root = rows[root][2]
        out.append((word, *row, root))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_the_index_finds_all_near_words_of_a_large_bucket():
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randrange(3, 9))) for _ in range(700)})
    tile, spelling.TILE = spelling.TILE, 1_000
    try:
        got = [(a, b) for x, y in near_in_buckets(words, np.array([0])) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    finally:
        spelling.TILE = tile
    expected = {(i, k) for i, a in enumerate(words) for k, b in enumerate(words) if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == expected


def test_variants_equal_brute_force(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdé") for _ in range(draw.randrange(7, 12))) for _ in range(25)] + ["aaaaaaa", "x" * 3_000]
    counts = Counter(dict.fromkeys(base, 5_000))
    for _ in range(900):
        word = draw.choice(list(counts))
        k = draw.randrange(len(word) + 1)
        word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("abcdé") + word[k:],
                            word[:k] + draw.choice("abcdé") + word[k + 1 :]])
        if len(word) >= 7 and word not in counts:
            counts[word] = draw.choice([2, 3, 40, 400])
    words = spark.createDataFrame(list(counts.items()), "word string, n int").repartition(3)
    assert found(spelling_variants(words)) == brute(counts)


def test_words_of_texts(spark):
    texts = [None, "", "Straßen straßen STRAßEN ÉCOLIERS écoliers naïveté-naïveté", "sixsix " * 9, "letters2letters letters",
             "Ωletters letterss " + "long" * 20_000, "long" * 20_000]
    docs = spark.createDataFrame([(i if i % 3 else None, t, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")
    got = {r.word: r.n for r in vocabulary(docs).collect()}
    assert got == {"straßen": 3, "naïveté": 2, "letters": 4, "long" * 20_000: 2}

    def change(doc_id, run):
        return F.when(F.crc32(run.cast("binary")) % 2 == 0, F.substr(run, F.lit(2))).otherwise(run)

    changed = Counter()
    for word in "straßen straßen straßen naïveté naïveté letters letters letters letters letterss Écoliers écoliers".split():
        changed[word[1:] if zlib.crc32(word.encode()) % 2 == 0 else word] += 1
    got = {r.word: r.n for r in vocabulary(docs, change=change).collect() if len(r.word) < 99}
    assert got == {w: n for w, n in changed.items() if n > 1 and len(w) >= 7}


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants(vocabulary(docs)).collect() == []
