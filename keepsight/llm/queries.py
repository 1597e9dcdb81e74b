"""Queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsight.llm import filteraudit, licences, prefixtrie, suffixdedup
from keepsight.llm.exactdedup import exact_dedup
from keepsight.llm.katz import katz_scores
from keepsight.llm.mainhtml import extract_main_text
from keepsight.llm.mixing import mix_sources
from keepsight.llm.packing import pack_documents
from keepsight.llm.quality import quality_rules
from keepsight.llm.simhash import simhash_components
from keepsight.llm.tables import table
from keepsight.llm.tokencount import count_tokens
from keepsight.llm.warc import archive_round_trip


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).drop("label", "text_key")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "text_key")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT rid, doc_id, t, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)),
common AS (SELECT rid, max(n) AS most FROM (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL) GROUP BY rid),
b AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m LEFT JOIN common USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 20 * n_symbols > word_chars OR 5 * most > n_words OR word_chars > 12 * n_words OR word_chars < 2 * n_words
            OR 2 * n_dup_lines > len(string_split(t, chr(10))) OR 100 * n_repeat_words > 30 * n_words
            OR 10 * len(regexp_extract_all(t, '!')) > n_words OR 10 * len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) > 3 * word_chars
            OR 10 * len(regexp_extract_all(t, '[0-9]')) > 3 * word_chars) AS kept
FROM b
"""

OP6_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
  FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""

OP9_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

#: Water-filling in closed form: sources by (3 * size / weight); the first k are full, the others share what is left.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
o AS (
  SELECT *, row_number() OVER r AS k, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum,
         sum(source_size) OVER () AS total
  FROM s WINDOW r AS (ORDER BY 3 * source_size / w::DOUBLE, source IS NULL, encode(source))),
f AS (SELECT min(k) AS k FROM o WHERE (total - held) * w <= cap * wsum),
level AS (SELECT (total - held)::BIGINT AS rest, wsum::DOUBLE AS wsum FROM o WHERE k = (SELECT k FROM f)),
t AS (
  SELECT source, source_size, CASE WHEN k < (SELECT k FROM f) THEN cap::DOUBLE ELSE (w * (SELECT rest FROM level))::DOUBLE / (SELECT wsum FROM level) END AS target
  FROM o),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_license_scan, op3_main_text, op4_quality_rules, op5_pack_documents, op6_warc_bundles, op7_katz_scores, op8_token_counts, op9_exact_dedup, op10_mix_sources, op11_filter_audit, op12_suffix_dedup, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licences.oracle(), "op4_quality_rules": OP4_SQL, "op6_warc_bundles": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op10_mix_sources": OP10_SQL, "op11_filter_audit": filteraudit.SQL, "op12_suffix_dedup": suffixdedup.SQL, "op13_prefix_trie": prefixtrie.SQL}
