"""One query per operator over its whole table, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import fresh_path

from . import (
    chat,
    exact_dedup,
    licenses,
    manifest,
    mixing,
    near_dedup,
    packing,
    piece_bpe,
    quality,
    spelling,
    toxicity,
    url_filters,
    warc,
)
from .common import table, written

#: The rules of the url query.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that were just written have no gaps: one would be a lost page, so the query stops at it."""
    path = fresh_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    lost = F.raise_error(F.concat_ws(" ", F.lit("unreadable:"), "archive", F.col("offset").cast("string"), "reason"))
    records = warc.read_archives(spark, path).filter(F.when(F.col("status") == "record", True).otherwise(lost.cast("boolean")))
    header, kind = F.col("headers"), pages.schema["page_id"].dataType
    return records.select(
        F.try_element_at(header, F.lit(warc.PAGE_ID)).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.try_element_at(header, F.lit(warc.REFERS_TO)).cast(kind).alias("refers_to"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_rules(spark))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    scored = toxicity.score_toxicity(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "labels").select("doc_id", "toxic"),
        learnable=remainder != 2,
    )
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score", "predicted", "evidence")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def by_thirds(sizes: DataFrame) -> DataFrame:
    """Weights 3, 1, 2 by rank: the first class rises over the run, the second falls, the third is level."""

    def knots(start: float, end: float):
        return F.array(
            F.struct(F.lit(0.0).alias("at"), F.lit(start).alias("weight")),
            F.struct(F.lit(1.0).alias("at"), F.lit(end).alias("weight")),
        )

    kind = F.col("rank") % 3
    return sizes.withColumn(
        "knots", F.when(kind == 0, knots(1.5, 4.5)).when(kind == 1, knots(1.5, 0.5)).otherwise(knots(2.0, 2.0))
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = written(mixing.sized(docs).select(mixing.ID, mixing.SOURCE, mixing.SIZE, mixing.ORDER), "sized")
    # The drawn order spreads the documents that are not taken, which have no position.
    mixed = mixing.mix(sized, by_thirds).withColumn("position", F.get("passes", F.lit(0))["position"])
    mixed = mixed.orderBy(F.col("position").asc_nulls_last(), mixing.ORDER)
    taken = F.aggregate("passes", F.lit(0).cast("bigint"), lambda total, one: total + one["taken"])
    return mixed.select(
        F.col(mixing.ID).alias("doc_id"),
        F.col(mixing.SIZE).alias("size"),
        "source_size",
        "target",
        taken.alias("taken"),
        "position",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files of one scan. Pages lie where their url says and inherit from the directories above;
    documents have no paths, so they are judged by their own headers and texts. Without a pages table these are all."""
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.lit("document").alias("kind"), "doc_id", none.alias("path"), "text")
    try:
        pages = table(spark, sf_dir, "pages")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    found = pages.select(
        F.lit("page").alias("kind"),
        "page_id",
        licenses.page_path(F.col("url")).alias("path"),
        licenses.page_text(F.col("html")).alias("text"),
    )
    return licenses.scan_licenses(files.unionByName(found, allowMissingColumns=True), keep=("kind", "doc_id", "page_id"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda one: F.concat(one["start"].cast("string"), F.lit("-"), one["end"].cast("string")))
    return turns.withColumn("mask", F.array_join(spans, ","))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    coded = piece_bpe.encode(table(spark, sf_dir, "documents"), path, packed=True)
    return piece_bpe.decode(coded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some runs, by a checksum of document and run, lose a letter first."""

    def misspelt(doc_id, run):
        h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 31 == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)

    words = spelling.vocabulary(table(spark, sf_dir, "documents"), change=misspelt)
    return spelling.spelling_variants(words)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by its id, is read with its text in lower case and held against the manifest."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    read = [F.translate("text", upper, lower) if name == "text" else F.col(name) for name in manifest.COLUMNS]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(touched, manifest.leaf_digest(read))
    rows = manifest.manifest(table(spark, sf_dir, "documents"), extra={"tampered": tampered})
    folded = manifest.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.withColumn("folded_root", folded).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: CRC-32 of the list ``bytes``, by its rule; null for null.
CRC32 = """xor(4294967295, list_reduce(bytes, lambda acc, b: list_reduce(range(8),
    lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(acc, CAST(b AS BIGINT))), CAST(4294967295 AS BIGINT)))"""

SQL_WARC = """
    WITH hashed AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
               max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
        FROM pages),
    digits AS (SELECT *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters FROM hashed)
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda k: letters[
               (CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (k % 4))::INTEGER) % 32 + 1]), '')
               AS payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM digits
"""

SQL_CHAT = """
    WITH spoken AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations),
    turns AS (
        SELECT *, replace(said, '<|', '< |') AS text,
               CAST(coalesce(sum(length(said) + length(role) + {turn}) OVER (
                   PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {part} AS part
        FROM spoken),
    seen AS (
        SELECT s.perspective, t.*, s.perspective = t.role AS own,
               CASE WHEN s.perspective = t.role THEN '<|assistant|>' || chr(10)
                    WHEN t.role = 'system' THEN '<|system|>' || chr(10)
                    ELSE '<|user name=' || replace(t.role, '<|', '< |') || '|>' || chr(10) END AS header,
               t.text || '<|end|>' || chr(10) AS body
        FROM turns t JOIN (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system') s
          ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
    placed AS (
        SELECT *, coalesce(sum(length(header || body)) OVER (
            PARTITION BY conv_id, part, perspective ORDER BY turn NULLS FIRST, role, said
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM seen)
    SELECT conv_id, CAST(0 AS BIGINT) AS "window", part, perspective, count(*) AS n_turns,
           string_agg(header || body, '' ORDER BY turn NULLS FIRST, role, said) AS text,
           coalesce(string_agg(CAST(pos + length(header) AS BIGINT) || '-' || CAST(pos + length(header || body) AS BIGINT), ','
                    ORDER BY turn NULLS FIRST, role, said) FILTER (WHERE own), '') AS mask
    FROM placed GROUP BY conv_id, part, perspective
""".format(part=chat.PART_CHARS, turn=chat.TURN_CHARS)

SQL_URL = """
    WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
    urls AS (
        SELECT page_id,
               CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    parsed AS (
        SELECT page_id,
               translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM urls),
    best AS (
        SELECT page_id, host, path,
               max({{'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': verdict}}) AS hit
        FROM parsed LEFT JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY ALL)
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
           hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict
    FROM best
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))

SQL_QUALITY = r"""
    WITH split AS (
        SELECT doc_id, coalesce(text, '') AS text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents),
    numbered AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM split),
    windows AS (
        SELECT doc_id, pos, count(*) OVER ahead = 5 AS whole,
               string_agg(word, ' ') OVER ahead AS words
        FROM numbered
        WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    shared AS (
        SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words) AS n FROM windows WHERE whole),
    covered AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM shared WHERE n > 1)
        GROUP BY doc_id),
    counts AS (
        SELECT s.doc_id, text, w, len(w) AS n_words,
               length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(c.n, 0) AS n_repeat_words
        FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
    base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 40 * n_words
                OR 2 * n_dup_lines > len(string_split(text, chr(10)))
                OR 2 * length(regexp_replace(text, '[^!?]', '', 'g')) > n_words
                OR length(regexp_replace(text, '\P{Lu}', '', 'g')) > 3 * n_words
                OR 4 * len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) > n_words
                OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 4 * n_words) AS kept
    FROM base
"""

SQL_EXACT = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

SQL_MIX = r"""
    WITH sized AS (
        SELECT doc_id, source, text,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
               CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15)
                    AS BIGINT) AS drawn
        FROM documents),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
        FROM sized GROUP BY source),
    weighted AS (
        SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight,
               [1.5, 1.5, 2.0][rank % 3 + 1]::DOUBLE AS w0, [3.0, -1.0, 0.0][rank % 3 + 1]::DOUBLE AS slope,
               2.0::DOUBLE * source_size AS cap
        FROM sources),
    filling AS (
        SELECT *, cap / weight AS fills, 1.5::DOUBLE * (SELECT sum(source_size) FROM sources) AS total,
               coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
               sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS beyond
        FROM weighted),
    levels AS (
        SELECT *, max(CASE WHEN (total - earlier) / beyond <= fills THEN (total - earlier) / beyond END) OVER () AS level
        FROM filling),
    mixture AS (SELECT *, least(cap, coalesce(level * weight, cap)) AS target FROM levels),
    placed AS (
        SELECT s.doc_id, s.size, m.source_size, m.target, m.weight, m.w0, m.slope,
               CAST(floor(m.target + 0.5) AS BIGINT) AS want,
               CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.drawn, s.doc_id, s.size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
        FROM sized s JOIN mixture m ON s.source IS NOT DISTINCT FROM m.source),
    taken AS (
        SELECT *, least(size, greatest(want - ahead, 0)) AS pass1,
               least(size, greatest(want - source_size - ahead, 0)) AS pass2,
               ahead / target * weight AS demand
        FROM placed)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(pass1 + pass2 AS BIGINT) AS taken,
           CASE WHEN pass1 > 0 THEN CASE WHEN demand <= 0 THEN 0.0::DOUBLE ELSE
               2 * demand / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * demand, 0))) END END AS position
    FROM taken
"""

SQL_MANIFEST = """
    WITH RECURSIVE
    fields AS (
        SELECT doc_id, lang, text,
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') ||
               coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
               coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
               {crc} % 3 = 0 AS touched
        FROM (SELECT *, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)) AS bytes FROM documents)),
    leaves AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN touched THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END AS tampered
        FROM fields),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY lang) AS n
        FROM leaves),
    nodes AS (
        SELECT 0 AS level, lang, pos, n, leaf AS digest FROM placed
        UNION ALL
        SELECT level + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY level, lang, n, pos // 8),
    subroots AS (
        SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, pos, n, digest FROM subroots
        UNION ALL
        SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
        FROM tops WHERE n > 1 GROUP BY level, n, pos // 8),
    runs AS (
        SELECT level, lang, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
    top_runs AS (
        SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM tops WHERE n > 1 GROUP BY ALL),
    climb AS (
        SELECT 0 AS level, lang, pos AS start, pos, n, coalesce(tampered, leaf) AS node, '' AS proof FROM placed
        UNION ALL
        SELECT c.level + 1, c.lang, start, pos // 8, (n + 7) // 8,
               sha256(array_to_string(digests[:pos % 8] || [node] || digests[pos % 8 + 2:], '')),
               proof || array_to_string(digests[:pos % 8] || digests[pos % 8 + 2:], '')
        FROM climb c JOIN runs r ON r.level = c.level AND r.lang IS NOT DISTINCT FROM c.lang AND r.run = c.pos // 8
        WHERE n > 1),
    over AS (
        SELECT 0 AS level, c.lang, c.start, s.pos, s.n, node, proof
        FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
        UNION ALL
        SELECT o.level + 1, o.lang, start, pos // 8, (n + 7) // 8,
               sha256(array_to_string(digests[:pos % 8] || [node] || digests[pos % 8 + 2:], '')),
               proof || array_to_string(digests[:pos % 8] || digests[pos % 8 + 2:], '')
        FROM over o JOIN top_runs r ON r.level = o.level AND r.run = o.pos // 8
        WHERE n > 1)
    SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(o.proof) AS proof_sha256,
           o.node AS folded_root, o.node = t.digest AS verified
    FROM placed p
    JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    JOIN over o ON o.n = 1 AND o.lang IS NOT DISTINCT FROM p.lang AND o.start = p.pos
    JOIN tops t ON t.n = 1
""".format(crc=CRC32)

SQL_SPELLING = r"""
    WITH RECURSIVE
    runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
               unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents),
    counted AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (
        SELECT run, n, {crc} AS h
        FROM (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''),
                  lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS bytes
              FROM counted)),
    spelt AS (
        SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed),
    vocabulary AS (
        SELECT word, CAST(sum(spelt.n) AS BIGINT) AS n FROM spelt
        WHERE length(word) >= 7 GROUP BY word HAVING sum(spelt.n) >= 2),
    shorter AS (
        SELECT word, n, pos, left(word, pos - 1) || substr(word, pos + 1) AS rest
        FROM (SELECT *, unnest(range(1, length(word) + 1)) AS pos FROM vocabulary)),
    near AS (
        SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.rest = b.word),
    ranked AS (
        SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near,
               row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place
        FROM near),
    judged AS (
        SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near,
               CASE WHEN r.n >= 10 * v.n THEN r.other END AS form, CASE WHEN r.n >= 10 * v.n THEN r.n END AS form_n
        FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
    followed AS (
        SELECT word, word AS root, form AS next FROM judged
        UNION ALL
        SELECT f.word, j.word, j.form FROM followed f JOIN judged j ON f.next = j.word)
    SELECT j.word, j.n, j.n_near, j.form, j.form_n, f.root
    FROM judged j JOIN followed f ON f.word = j.word AND f.next IS NULL
""".format(crc=CRC32)

QUERIES = {
    "op1_warc": (op1_warc, SQL_WARC),
    "op2_url_filter": (op2_url_filter, SQL_URL),
    "op3_quality_rules": (op3_quality_rules, SQL_QUALITY),
    "op4_toxicity": (op4_toxicity, None),
    "op5_exact_dedup": (op5_exact_dedup, SQL_EXACT),
    "op6_source_mix": (op6_source_mix, SQL_MIX),
    "op7_license_scan": (op7_license_scan, None),
    "op8_packing": (op8_packing, None),
    "op9_near_dedup": (op9_near_dedup, None),
    "op10_chat": (op10_chat, SQL_CHAT),
    "op11_sentencepiece": (op11_sentencepiece, None),
    "op12_spelling": (op12_spelling, SQL_SPELLING),
    "op13_manifest": (op13_manifest, SQL_MANIFEST),
}
