import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import drop_duplicates, duplicate_groups
from millrace.llm.url_filters import judge_urls

DOCS = "doc_id bigint, text string, source string, kept string"


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i), reverse=True)):
            out.append((i, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_groups_equal_brute_force(spark, support):
    # A text that holds a third of the rows, pairs, nulls, empties, repeated rows, a long text.
    rows = [(i, "hot") for i in range(100)] + [(200 + i, f"t{i // 2}") for i in range(150)]
    rows += [(400, None), (401, ""), (None, "hot"), (None, "alone"), (500, "again"), (500, "again"), (600, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], DOCS).repartition(5)
    got = [tuple(r) for r in duplicate_groups(docs, support=support).collect()]
    assert sorted(got, key=str) == sorted(brute_groups(rows), key=str)
    kept = drop_duplicates(docs, support=support)
    assert kept.columns == docs.columns
    best = {}
    for doc_id, text in rows:
        if doc_id is not None:
            best[text or ""] = max(best.get(text or "", (-1, None)), (doc_id, text), key=lambda pair: pair[0])
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(best.values())
    assert [r.text for r in kept.filter("doc_id IS NULL").collect()] == ["alone"]


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert duplicate_groups(empty).collect() == [] and drop_duplicates(empty).collect() == []


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_equal_brute_force(spark):
    rules = [
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
        ("com", "", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/", "allow"),
    ]
    urls = [
        None, "", "example.org/es/", "http://example.org/es/1", "HTTP://WWW.Example.ORG/es/", "http://xexample.org/es/",
        "http://example.org/en/12?x=/es/", "http://example.org/en/2#t", "http://example.org", "http://example.org?es/",
        "http://a.com/x", "http://b.a.com/xyz", "http://c.b.a.com/", "ftp://com", "http://È.com/é://", "x://y://org/",
        "http://" + "a." * 5_000 + "org/" + "p" * 50_000, "http://org:80/",
    ]
    pages = spark.createDataFrame(
        [(k // 2 if k % 5 else None, u, "h", "r") for k, u in enumerate(urls + urls)],
        "page_id bigint, url string, html string, rule string",
    )
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(map(str, (tuple(r) for r in judge_urls(pages, table).collect())))
    want = sorted(str((r.page_id, *brute_verdict(r.url, rules))) for r in pages.collect())
    assert got == want
    assert judge_urls(pages.limit(0), table).collect() == []
    nothing = judge_urls(pages, table.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in nothing] == [(None, "allow")]


def test_a_rule_without_host_is_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    rules = spark.createDataFrame([("", "/", "block")], "host string, path string, verdict string")
    with pytest.raises(Exception, match="a rule needs a host"):
        judge_urls(pages, rules).collect()


def test_urls_need_one_shuffle_and_no_python(spark):
    pages = spark.range(10).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"))
    rules = spark.sql("SELECT * FROM VALUES ('org', '/', 'block') AS r(host, path, verdict)")
    plan = judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
