import itertools
import math
import re
from collections import Counter

from millrace.llm.licenses import COMMENT, FILE_SCORE, HEADER_LINES, HEADER_SCORE, NOTICES, full_texts, scan_licenses
from millrace.llm.queries import op7_license_scan

FILES = "doc_id bigint, path string, text string, license string"
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
GPL_HEADER = """#!/usr/bin/env python
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

import this
"""


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows):
    df = Counter(t for _, _, text in rows for t in set(tokens(text)))
    total = len(rows)

    def vector(found):
        weights = {t: (1 + math.log(n)) * math.log(1 + total / df.get(t, 1)) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()} if norm else {}

    def listed(templates):
        return [(name, len(tokens(text)), vector(tokens(text))) for name, text in templates]

    short, full = listed(NOTICES), listed(full_texts())

    def best(found, least, templates, sized=False):
        unit = vector(found)
        scores = [
            (round(sum(w * unit.get(t, 0) for t, w in one.items()), 9), name)
            for name, size, one in templates
            if not sized or size / 2 <= len(found) <= size * 2
        ]
        top = max(scores, default=(0, ""))
        return top if top[0] >= least else None

    def units(text):
        lines = [(tokens(line), re.match(COMMENT, line)) for line in (text or "").split("\n")]
        lines = [line for line in lines if line[0]]
        block = list(itertools.takewhile(lambda line: line[1], lines))
        runs = [lines[at : at + n] for n in range(1, HEADER_LINES + 1) for at in range(len(lines) - n + 1)]
        body, *headers = ([t for line in run for t in line[0]] for run in [lines[len(block) :], *runs, block])
        return body, headers

    own = {}
    for k, (_, _, text) in enumerate(rows):
        body, headers = units(text)
        file = best(body, FILE_SCORE, full, sized=True)
        found = [hit for unit in headers if (hit := best(unit, HEADER_SCORE, short))]
        own[k] = ("file", file) if file else ("header", max(found)) if found else None
    covered = {}
    for k, (_, path, _) in enumerate(rows):
        if own[k] and own[k][0] == "file" and path is not None and "/" in path:
            place = path.rsplit("/", 1)[0]
            covered[place] = max(covered.get(place, (0, "")), own[k][1])
    out = []
    for k, (i, path, _) in enumerate(rows):
        if own[k]:
            out.append((i, path, own[k][1][1], own[k][0], own[k][1][0], None))
            continue
        place = path
        while place is not None and "/" in place:
            place = place.rsplit("/", 1)[0]
            if place in covered:
                out.append((i, path, covered[place][1], "inherited", covered[place][0], place))
                break
        else:
            out.append((i, path, None, None, None, None))
    return sorted(map(str, out))


def test_scan_equals_brute_force(spark):
    prose = "some ordinary words about nothing in particular and the same again"
    full = dict(full_texts())
    owned = full["MIT"].replace("(c)", "(c) 2021 Some Holder of Rights")
    rows = [
        (1, "/a/LICENSE", owned), (2, "/a/x.txt", prose), (3, "/a/b/c/y.txt", prose), (4, "/a/b/COPYING", full["GPL-3.0"]),
        (5, "/a/b/z.txt", f"{prose}\n{MIT}\n{prose}"), (6, "/q/x.txt", prose), (7, None, owned), (8, None, prose),
        (9, "flat.txt", prose), (10, "/a/b/c/d/e", None), (11, "/a/b/c/d/e", ""), (12, "/a/w.txt", "# Licensed under CC BY-NC 4.0."),
        (13, "/a/v.txt", "All rights reserved by nobody at all"), (14, "/r/NOTICE", MIT + "\n" + GPL), (15, "/r/t", prose),
        (16, "/s/l", f"{prose} " * 3_000 + "\n" + GPL), (2, "/a/x.txt", prose), (None, "/a/b/n", "the MIT License"),
        (17, "/g/y.py", GPL_HEADER), (18, "/g/z.py", "import this\n"), (19, "/h/all.txt", (owned + prose + "\n") * 5), (20, "/h/q", prose),
        (21, "/i/LICENSE", full["Apache-2.0"]), (22, "/i/a/b.c", prose), (23, "/i/c.c", "/* " + owned.replace("\n", "\n * ")),
        (24, "/j/two", full["MIT"]), (25, "/j/one", full["ISC"]), (26, "/j/x", prose), (27, "/j/k", "#\n\n# x\n"),
        (28, "/k/LICENSE.md", "# " + full["MPL-2.0"]), (29, "/k/deep/down.rs", prose),
    ]
    rows += [(100 + i, f"/hot/{i % 3}/{i}", f"{prose} number {i}") for i in range(60)]
    files = spark.createDataFrame([(*r, "clash") for r in rows], FILES).repartition(3)
    got = scan_licenses(files, keep=("doc_id",))
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "path", "license", "origin", "score", "inherited_from").collect()) == brute(rows)
    by_id = {r["doc_id"]: (r["origin"], r["license"]) for r in got.collect()}
    assert by_id[1] == ("file", "MIT") and by_id[2] == ("inherited", "MIT") and by_id[3] == ("inherited", "GPL-3.0")
    assert by_id[17] == ("header", "GPL-3.0") and by_id[18] == (None, None) and by_id[20] == (None, None)
    assert by_id[22] == ("inherited", "Apache-2.0") and by_id[23] == ("header", "MIT")
    assert by_id[28] == ("file", "MPL-2.0") and by_id[29] == ("inherited", "MPL-2.0")
    assert scan_licenses(files.limit(0), keep=("doc_id",)).collect() == []


def test_every_full_text_is_a_licence_file_of_its_name(spark):
    rows = [(k, f"/{name}/LICENSE", text, "clash") for k, (name, text) in enumerate(full_texts())]
    got = scan_licenses(spark.createDataFrame(rows, FILES)).collect()
    assert len(got) == len(rows) > 10
    assert all(r["origin"] == "file" and r["path"] == f"/{r['license']}/LICENSE" for r in got)


def test_query_judges_documents_without_paths(spark, tmp_path):
    docs = [(1, MIT, "en", "a", 1), (None, full_texts()[0][1], "en", "a", 1), (2, "some words", "fr", "a", 1), (3, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["origin"], r["license"], r["inherited_from"]) for r in op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("header", "MIT", None), None: ("file", "Apache-2.0", None), 2: (None,) * 3, 3: (None,) * 3}


def test_query_lets_pages_inherit_by_their_urls(spark, tmp_path):
    full = dict(full_texts())
    owned = full["MIT"].replace("(c)", "(c) 2021 Some Holder of Rights")
    prose = "some ordinary words about nothing in particular"
    docs = [(1, MIT), (2, prose), (None, full["ISC"])]
    # page_id, url, html, path, text
    pages = [
        (1, "https://H.example.org/lib/LICENSE", f"<!DOCTYPE html><html><pre class='x'>{owned}</pre></html>", "h.example.org/lib/LICENSE", owned),
        (2, "http://h.example.org/lib/src/deep/x.html?a=/b#c/d", f"<p>{prose}</p>", "h.example.org/lib/src/deep/x.html", prose),
        (3, "https://h.example.org/other/x", f"<p>{prose}</p>", "h.example.org/other/x", prose),
        (4, "https://h.example.org/lib/y", "<div>This work is <b>licensed under</b> the GNU&nbsp;General <A href='/x'>Public License</A>, version 3.</div><p>a",
         "h.example.org/lib/y", GPL + "\na"),
        (5, "https://k.example.org", full["Unlicense"], "k.example.org/", full["Unlicense"]),
        (6, "https://k.example.org/a/b", f"<p>{prose}<br>{prose}", "k.example.org/a/b", f"{prose}\n{prose}"),
        (7, "https://x.k.example.org/a", f"<p>{prose}", "x.k.example.org/a", prose),
        (8, None, owned, None, owned), (9, "h.example.org/lib/z", prose, None, prose),
        (None, "https://h.example.org/lib/n/", None, "h.example.org/lib/n/", None),
        (10, "https://h.example.org/lib/LICENSE/", prose, "h.example.org/lib/LICENSE/", prose),
        (11, "http://c.example.org/z", "<!-- " + MIT + " --><p>" + prose, "c.example.org/z", "<!-- " + MIT + " -->\n" + prose),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op7_license_scan(spark, str(tmp_path)).collect()
    rows = [(f"document {i}", None, text) for i, text in docs] + [(f"page {p[0]}", p[3], p[4]) for p in pages]
    named = [(f"{r.kind} {r.doc_id if r.kind == 'document' else r.page_id}", r.path, r.license, r.origin, r.score, r.inherited_from) for r in got]
    assert sorted(map(str, named)) == brute(rows)
    by_page = {r.page_id: (r.origin, r.license, r.inherited_from) for r in got if r.kind == "page"}
    assert by_page[2] == by_page[10] == by_page[None] == ("inherited", "MIT", "h.example.org/lib")
    assert by_page[6] == ("inherited", "Unlicense", "k.example.org") and by_page[4] == ("header", "GPL-3.0", None)
    assert by_page[3] == by_page[7] == by_page[9] == (None,) * 3
