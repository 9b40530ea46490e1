"""One query for each training-data operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, langid, license_scan, line_dedup, packing, quality_rules, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    out = quality_rules.apply_rules(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "licenses", "n_matches", "best_dice")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), distinct_ids=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), warc.archive_folder(spark))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_TEMPLATES = ", ".join("({}, [{}])".format(f"'{k}'", ", ".join(f"'{g}'" for g in license_scan.template_bigrams(v))) for k, v in sorted(license_scan.TEMPLATES.items()))
_RULE_CASES = " ".join(
    f"WHEN (h = '{r.partition('/')[0]}' OR suffix(h, '.{r.partition('/')[0]}')) AND prefix(p, '/{r.partition('/')[2]}') THEN '{r}'"
    for _, r in sorted(url_filter.RULES, key=lambda x: -len(x[1]))
)
_BLOCKED = ", ".join(f"'{r}'" for v, r in url_filter.RULES if v == "block")

ORACLE_SQL = {
    "op4_license_scan": rf"""
WITH u AS (
  SELECT doc_id, unnest(string_split(text, chr(10)) || CASE WHEN contains(text, chr(10)) THEN [text] ELSE [] END) AS unit
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, string_split(trim(regexp_replace(translate(unit, {_AZ}), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM u),
g AS (SELECT doc_id, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS gs FROM w WHERE len(ws) >= 2),
t(name, ts) AS (VALUES {_TEMPLATES}),
m AS (
  SELECT doc_id, name, round(2.0 * len(list_intersect(gs, ts)) / (len(gs) + len(ts)), 6) AS dice
  FROM g JOIN t ON len(gs) BETWEEN len(ts) * 0.6 AND len(ts) * 1.6 AND list_has_any(gs, ts)),
h AS (
  SELECT doc_id, string_agg(DISTINCT name, '; ' ORDER BY name) AS licenses, count(*) AS n_matches, max(dice) AS best_dice
  FROM m WHERE dice >= 0.8 GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches, best_dice FROM documents LEFT JOIN h USING (doc_id)""",
    "op5_url_filter": rf"""
WITH RECURSIVE x AS (
  SELECT page_id, url, html, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS h,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS p,
         regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest FROM pages),
k AS (SELECT *, CASE WHEN h <> '' THEN h || CASE WHEN prefix(rest, '/') THEN rest ELSE '/' || rest END END AS key FROM x),
tags AS (SELECT url, key, unnest(regexp_extract_all(html, '<(?:link|meta)[^>]*>', 0, 'is')) AS tag FROM k WHERE regexp_matches(html, 'canonical|http-equiv', 'i')),
links AS (
  SELECT key AS a, url, replace(CASE
    WHEN regexp_matches(tag, 'rel\s*=\s*["'']?[^"''>]*canonical', 'i') THEN regexp_extract(tag, 'href\s*=\s*["'']?([^"''\s>]+)', 1, 'i')
    WHEN regexp_matches(tag, 'http-equiv\s*=\s*["'']?refresh', 'i') THEN regexp_extract(tag, 'url\s*=\s*["'']?([^"''\s>]+)', 1, 'i') END, '&amp;', '&') AS link FROM tags),
abs AS (
  SELECT a, CASE WHEN contains(link, '://') THEN link
    WHEN prefix(link, '//') THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || link
    WHEN prefix(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*([^?#]*/)', 1, 's'), ''), '/') || link END AS t
  FROM links WHERE link <> ''),
e0 AS (
  SELECT DISTINCT a, lower(regexp_extract(t, '^.*?://([^/?#]*)', 1, 's')) || CASE WHEN prefix(regexp_extract(t, '^.*?://[^/?#]*([^#]*)', 1, 's'), '/') THEN '' ELSE '/' END
         || regexp_extract(t, '^.*?://[^/?#]*([^#]*)', 1, 's') AS b FROM abs WHERE a IS NOT NULL),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
hp AS (SELECT DISTINCT a AS n, regexp_extract(a, '^([^/?#]*)', 1, 's') AS h, regexp_extract(a, '^[^/?#]*([^?#]*)', 1, 's') AS p FROM e),
bad AS (SELECT n FROM hp WHERE CASE {_RULE_CASES} END IN ({_BLOCKED})),
reach AS (SELECT n FROM bad UNION SELECT e.b FROM reach r JOIN e ON e.a = r.n)
SELECT page_id, h AS host, p AS path, CASE {_RULE_CASES} END AS rule,
       CASE WHEN CASE {_RULE_CASES} END IS NOT NULL THEN CASE WHEN CASE {_RULE_CASES} END IN ({_BLOCKED}) THEN 'block' ELSE 'allow' END
            WHEN key IN (SELECT n FROM reach) THEN 'block' ELSE 'allow' END AS verdict
FROM k""",
    "op7_exact_dedup": rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op8_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT *, trim(translate(line, {_AZ}), {_WS}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, p, line, keep IS NOT NULL AND k.doc_id <> keep AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT h, max(page_id) AS lead FROM p GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM p JOIN g USING (h)""",
}
