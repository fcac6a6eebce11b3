"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Tokens are longest runs of letters and digits in lower case. Document frequencies are counted over all files. A unit's
weights are ``(1 + ln tf) * ln(1 + N / df)``. Two kinds of units are scored:

* A file behind its leading comment block against full licence texts. With a cosine of ``FILE_SCORE`` or more, and between
  half and twice as many tokens as that text, it is a licence file (``file``): its licence covers its directory and all
  below. So it holds most of a full text and little else; a notice or a licence in a comment never covers a directory.
* Headers against short notices: every run of 1 to ``HEADER_LINES`` consecutive lines, and the leading comment
  block (a file's first lines as far as they begin with a comment sign). Lines without a token do not count. A file whose best
  header has ``HEADER_SCORE`` or more has that licence itself (``header``).

Any other file inherits from its nearest ancestor directory that holds a licence file.

Only units that can reach the score are weighed. By Cauchy-Schwarz a unit without any of a template's heaviest
tokens, as many as leave the rest below the score, stays below it; those *key tokens* select units exactly, in
the scan. Ties go to the greater licence name. Of several licence files in a directory the best score wins. Licences whose
texts differ in a few words get the name of the nearest template: a text of the AGPL reads as GPL-3.0.

A null or empty text has no unit. A file with a null path is scanned, but inherits nothing and covers nothing.
Repeated paths are fine: every row is judged by its own text. ``keep`` names the columns that are carried
along; names that start with ``_lic_`` are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written
from .url_filters import url_host, url_path

HEADER_SCORE, FILE_SCORE = 0.7, 0.8
#: Lines of a run; a wrapped notice has to fit.
HEADER_LINES = 5
#: Tokens of a licence file, as shares of those of the full text.
FILE_SIZE = (0.5, 2.0)
#: Signs that a comment line begins with, behind spaces.
COMMENT = r"^\s*(#|//|/\*|\*|--|;|<!--|%|'{3}|\x22{3})"
#: Markup of pages: tags inside a line, all tags and declarations (addresses in angle brackets are none), and character references.
INLINE_TAG = r"(?i)</?(a|abbr|b|code|em|font|i|small|span|strong|tt|u)(\s[^<>]*)?>"
TAG, REFERENCE = r"<[/!]?[A-Za-z][\w:-]*(\s[^<>]*|/)?>", r"&#?[A-Za-z0-9]{1,10};"
#: Full licence texts, a file each, named by licence.
FULL_TEXTS = Path(__file__).with_name("license_texts")

#: Usual notices of common licences.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
                "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
                "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a "
                "copy of the GNU General Public License along with this program. If not, see "
                "https://www.gnu.org/licenses/"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def full_texts(folder: Path = FULL_TEXTS) -> tuple[tuple[str, str], ...]:
    """(licence, text) of every ``.txt`` file of a folder."""
    return tuple((path.stem, path.read_text(encoding="utf-8")) for path in sorted(folder.glob("*.txt")))


def template_table(spark, templates) -> DataFrame:
    """(``template``, ``license``, ``text``) as rows made by SQL."""
    rows = F.array(
        *(
            F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
            for k, (name, text) in enumerate(templates)
        )
    )
    return spark.range(1).select(F.inline(rows))


def document_frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """(``token``, ``df``) over all files."""
    found = files.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    return written(found.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token-frequencies")


def weighed(units: DataFrame, key: str, frequencies: DataFrame, total: int) -> DataFrame:
    """(``key``, ``token``, ``weight``) of units with a ``tokens`` array; a token without ``df`` counts as in one file."""
    counts = (
        units.select(key, F.explode("tokens").alias("token"))
        .groupBy(key, "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    idf = F.log(1 + F.lit(float(max(total, 1))) / F.coalesce("df", F.lit(1)))
    return counts.join(frequencies, "token", "left").select(
        key, "token", ((1 + F.log("tf")) * idf).alias("weight")
    )


def normalised(weights: DataFrame, key: str) -> DataFrame:
    """The same with weights of length 1 per key."""
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_lic_norm"))
    return weights.join(norms, key).select(key, "token", (F.col("weight") / F.col("_lic_norm")).alias("weight"))


def template_vectors(spark, templates, frequencies: DataFrame, total: int) -> DataFrame:
    """(``template``, ``token``, ``weight``, ``license``, ``size``) with weights of length 1 per template."""
    units = template_table(spark, templates).withColumn("tokens", tokens(F.col("text")))
    named = units.select("template", "license", F.size("tokens").alias("size"))
    return written(
        normalised(weighed(units, "template", frequencies, total), "template").join(named, "template"), "templates"
    )


def key_tokens(vectors: DataFrame, score: float) -> list[str]:
    """The heaviest tokens of each template that a unit must share to reach the score; the templates bound their number."""
    rest = Window.partitionBy("template").orderBy("weight", "token").rowsBetween(Window.unboundedPreceding, 0)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(rest))
    # Just below the score, so that rounding cannot lose a unit.
    needed = vectors.withColumn("_lic_rest", length).filter(F.col("_lic_rest") >= score - 1e-9)
    return sorted(row[0] for row in needed.select("token").distinct().collect())


def _best(
    units: DataFrame, vectors: DataFrame, frequencies: DataFrame, total: int, score: float,
    sizes: tuple[float, float] | None = None,
) -> DataFrame:
    """(``unit``, ``score``, ``license``) of the units that reach the score with a template of fitting size."""
    units = units.select("unit", "tokens")
    rows = normalised(written(weighed(units, "unit", frequencies, total), "unit-weights"), "unit")
    listed = vectors.select("template", "license", "size", "token", F.col("weight").alias("_lic_weight"))
    scored = (
        rows.join(listed, "token")
        .groupBy("unit", "template", "license", "size")
        .agg(F.round(F.sum(F.col("weight") * F.col("_lic_weight")), 9).alias("score"))
        .filter(F.col("score") >= score)
    )
    if sizes is not None:
        held = units.select("unit", F.size("tokens").alias("_lic_held"))
        scored = scored.join(held, "unit").filter(
            F.col("_lic_held").between(F.col("size") * sizes[0], F.col("size") * sizes[1])
        )
    return scored.groupBy("unit").agg(F.max(F.struct("score", "license")).alias("best")).select(
        "unit", "best.score", "best.license"
    )


def lines_of(text: Column) -> Column:
    """(``words``, ``comment``) of the lines that hold a token."""
    return F.filter(
        F.transform(
            F.split(text, "\n"),
            lambda line: F.struct(tokens(line).alias("words"), line.rlike(COMMENT).alias("comment")),
        ),
        lambda line: F.size(line["words"]) > 0,
    )


def leading_comment(lines: Column) -> Column:
    """The number of comment lines before the first other line."""
    code = F.array_position(F.transform(lines, lambda line: ~line["comment"]), True).cast("int")
    return F.when(code == 0, F.size(lines)).otherwise(code - 1)


def header_units(lines: Column, candidate, most: int = HEADER_LINES) -> Column:
    """Token arrays of the runs of 1 to ``most`` lines and of the leading comment block, as far as ``candidate`` lets them."""

    def runs(length: int, held: Column, hits: Column) -> Column:
        last = F.size(held) - length + 1
        starts = F.filter(
            F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
            lambda at: F.array_contains(F.slice(hits, at, length), True),
        )
        return F.transform(starts, lambda at: F.flatten(F.slice(held, at, length)))

    held = F.transform(lines, lambda line: line["words"])
    hits = F.transform(lines, lambda line: candidate(line["words"]))
    block = F.flatten(F.slice(held, F.lit(1), leading_comment(lines)))
    return let(
        F.struct(held.alias("held"), hits.alias("hits"), block.alias("block")),
        lambda one: F.concat(
            *(runs(n, one["held"], one["hits"]) for n in range(1, most + 1)), F.filter(F.array(one["block"]), candidate)
        ),
    )


def body(lines: Column) -> Column:
    """The tokens behind the leading comment block."""
    held = F.transform(lines, lambda line: line["words"])
    return F.flatten(F.slice(held, leading_comment(lines) + 1, F.greatest(F.size(lines), F.lit(1))))


def page_text(html: Column) -> Column:
    """The lines of a page: tags inside a line fall away, others end it, character references are spaces; comments stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, INLINE_TAG, ""), TAG, "\n"), REFERENCE, " ")


def page_path(url: Column) -> Column:
    """Host and path of a url, ``/`` for an empty path; null without ``://``."""
    path = url_path(url)
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), F.when(path == "", "/").otherwise(path)))


def parent(path: Column) -> Column:
    """The directory of a path; null at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", ""))


def ancestors(directory: Column) -> Column:
    """(directory, depth) of a directory and all above it, the root ``""`` included."""
    parts = F.split(directory, "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    return F.transform(
        depths,
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory"), n.alias("depth")),
    )


def inherited(directories: DataFrame, covered: DataFrame) -> DataFrame:
    """(``directory``, ``from_directory``, ``license``, ``score``): the nearest covered ancestor of each directory."""
    return (
        directories.select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
        .join(covered.withColumnRenamed("directory", "from_directory"), F.col("above.directory") == F.col("from_directory"))
        .groupBy("directory")
        .agg(F.max(F.struct("above.depth", "from_directory", "license", "score")).alias("nearest"))
        .select("directory", "nearest.from_directory", "nearest.license", "nearest.score")
    )


def _any_of(found: list[str]):
    """A condition on token arrays: they hold one of the tokens."""
    keys = F.array(*(F.lit(token) for token in found)).cast("array<string>")
    return lambda held: F.arrays_overlap(held, keys)


def scan_licenses(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    notices=NOTICES,
    texts=None,
    header_score: float = HEADER_SCORE,
    file_score: float = FILE_SCORE,
    header_lines: int = HEADER_LINES,
) -> DataFrame:
    """A row per file: ``keep``, path, ``license``, ``origin`` (file, header, inherited or null), ``score``, ``inherited_from``.

    ``notices`` and ``texts`` are (licence, text) pairs; ``texts`` are those of ``FULL_TEXTS`` unless given.
    """
    spark = files.sparkSession
    frequencies = document_frequencies(files, text_col)
    total = files.count()
    short = template_vectors(spark, notices, frequencies, total)
    full = template_vectors(spark, full_texts() if texts is None else texts, frequencies, total)
    in_header, in_file = _any_of(key_tokens(short, header_score)), _any_of(key_tokens(full, file_score))
    least, most = full.agg(F.min("size"), F.max("size")).first()

    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = files.select(
        *(F.col(name).alias(f"_lic_{name}") for name in keep), F.col(path_col).alias("path"),
        text.alias("_lic_text"), tokens(text).alias("_lic_whole"),
    )
    enough = F.size("_lic_whole") >= (least or 0) * FILE_SIZE[0]
    lines, nothing = lines_of(F.col("_lic_text")), F.lit(None).cast("array<string>")

    def fitting(held: Column) -> Column:
        return F.when(F.size(held).between((least or 0) * FILE_SIZE[0], (most or 0) * FILE_SIZE[1]), held).otherwise(nothing)

    whole = let(let(lines, body), fitting)
    scanned = written(
        scanned.select(
            *(f"_lic_{name}" for name in keep),
            "path",
            F.when(enough & in_file(F.col("_lic_whole")), whole).alias("whole"),
            F.when(in_header(F.col("_lic_whole")), let(lines, lambda found: header_units(found, in_header, header_lines))).alias(
                "headers"
            ),
            F.monotonically_increasing_id().alias("row"),
        ),
        "scanned",
    )
    header_rows = written(
        scanned.select("row", F.explode("headers").alias("tokens")).withColumn("unit", F.monotonically_increasing_id()),
        "headers",
    )
    by_header = (
        _best(header_rows, short, frequencies, total, header_score)
        .join(header_rows.select("unit", "row"), "unit")
        .groupBy("row")
        .agg(F.max(F.struct("score", "license")).alias("header"))
    )
    wholes = scanned.filter(F.col("whole").isNotNull()).select(F.col("row").alias("unit"), F.col("whole").alias("tokens"))
    by_file = _best(wholes, full, frequencies, total, file_score, FILE_SIZE).select(
        F.col("unit").alias("row"), F.struct("score", "license").alias("file")
    )
    own = written(by_file.join(by_header, "row", "full"), "own-licenses")

    placed = scanned.drop("whole", "headers").join(own, "row", "left").withColumn("directory", parent(F.col("path")))
    covered = (
        placed.filter(F.col("file").isNotNull() & F.col("directory").isNotNull())
        .groupBy("directory")
        .agg(F.max("file").alias("file"))
        .select("directory", "file.license", "file.score")
    )
    directories = scanned.select(parent(F.col("path")).alias("directory")).filter("directory IS NOT NULL").distinct()
    above = written(inherited(directories, written(covered, "covered")), "inherited").select(
        F.col("directory").alias("_lic_directory"), F.struct("license", "score", "from_directory").alias("up")
    )
    judged = placed.join(above, F.col("directory") == F.col("_lic_directory"), "left")
    own_best = F.coalesce("file", "header")
    return judged.select(
        *(F.col(f"_lic_{name}").alias(name) for name in keep),
        "path",
        F.coalesce(own_best["license"], F.col("up.license")).alias("license"),
        F.when(F.col("file").isNotNull(), "file")
        .when(F.col("header").isNotNull(), "header")
        .when(F.col("up").isNotNull(), "inherited")
        .alias("origin"),
        F.coalesce(own_best["score"], F.col("up.score")).alias("score"),
        F.when(own_best.isNull(), F.col("up.from_directory")).alias("inherited_from"),
    )
