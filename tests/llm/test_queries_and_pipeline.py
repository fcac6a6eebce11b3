import datetime as dt
import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_near_dedup import brute as brute_near
from test_quality import brute as brute_quality

import corpus_pipeline
from millrace.llm.packing import Encoder
from millrace.llm.queries import QUERIES, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents pages conversations labels benchmark".split()


def canonical(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return v.isoformat() if isinstance(v, dt.datetime) else repr(v)

    return sorted(tuple(map(cell, row)) for row in rows)


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    query, sql = QUERIES[name]
    result = query(spark, SF_DIR)
    names = ", ".join(f'"{c}"' for c in sorted(result.columns))
    expected = duck.execute(f"SELECT {names} FROM ({sql})").fetchall()
    assert canonical(result.select(*sorted(result.columns)).collect()) == canonical(expected)


def plain_mix(docs):
    """Words taken per (id, text), by the contract's rules."""
    order = sorted({s for *_, s in docs if s is not None}) + [None]
    groups = defaultdict(list)
    for i, text, source in docs:
        key = hashlib.md5(f"{'' if i is None else i}\n{text}".encode()).hexdigest()[:15]
        groups[source].append((int(key, 16), i, text, len(text.split())))
    sizes = {s: sum(one[3] for one in rows) for s, rows in groups.items()}
    weights = {s: (3, 1, 2)[[o for o in order if o in groups].index(s) % 3] for s in groups}
    left, open_, target = 1.5 * sum(sizes.values()), set(groups), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in full} if full else {s: weights[s] * level for s in open_}
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    passes = []
    for s, rows in groups.items():
        at, want = 0, math.floor(target[s] + 0.5)
        for epoch in range(2):
            for _, i, text, n in sorted(rows, key=lambda one: (one[0], one[1] is not None, one[1] or 0, one[3])):
                took = max(0, min(n, want - at))
                at += n
                if took:
                    passes.append((i, text, took, n))
    return passes


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    draw = random.Random(2)

    def prose(n):
        return " ".join(f"w{draw.randrange(2_000)}" for _ in range(n))

    rows = [(i, prose(draw.randrange(12, 200)), "src%d" % (i % 4 if i % 3 else 0)) for i in range(120)]
    rows += [(200 + i, rows[i][1], "src1") for i in range(20)]
    rows += [(300 + i, rows[i][1] + " tail", None) for i in range(60)]
    rows += [(400, None, "src0"), (401, "", None), (402, "too short", "src0"), (None, prose(40), "src9"), (403, prose(9_000), "src2")]
    rows += [(404, "| # " * 40, "src1"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(
        [(i, t, "en", s, len(t) if t else None, "extra") for i, t, s in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string",
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    kept = [(i, t, s) for i, t, s in rows if brute_quality(t)[-1]]
    best = {}
    for i, t, s in kept:
        if t not in best or (i is not None and (best[t][0] is None or i > best[t][0])):
            best[t] = (i, t, s)
    survivors = list(best.values())
    one = {c for i, _, c, k in brute_near([(i, t) for i, t, _ in survivors]) if k}
    survivors = [d for d in survivors if d[0] is None or d[0] in one]
    passes = plain_mix(survivors)

    stages, rows_in = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        rows_in = stage(spark, rows_in, str(tmp_path))
        path = str(tmp_path / name)
        rows_in.write.parquet(path)
        rows_in = spark.read.parquet(path)
        stages.append(rows_in)
    assert all(stage.columns == docs.columns for stage in stages[:4])
    assert sorted(((r.doc_id, r.text) for r in stages[0].collect()), key=str) == sorted(((i, t) for i, t, _ in kept), key=str)
    assert sorted((r.text for r in stages[2].collect())) == sorted(t for _, t, _ in survivors)
    words = sorted(((r.doc_id, len(r.text.split())) for r in stages[3].collect()), key=str)
    assert words == sorted(((i, took) for i, _, took, _ in passes), key=str)

    encode = Encoder(tokenizer_path())
    lengths = defaultdict(int)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        lengths[p.doc_id] += p.length
    expected = defaultdict(int)
    for r in stages[3].collect():
        expected[r.doc_id] += len(np.frombuffer(encode(r.text), "<u4")) + 1
    assert lengths == expected


def test_pipeline_of_no_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
