"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, mixing, pii, quality_rules, secret_scan, substring_dedup, toxicity, warc
from .common import fold, load

#: A production key comes from a secret store; this one only makes the query repeatable.
PII_KEY = "docspark-query-key"

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(load(spark, sf_dir, "documents"), k=4, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    net = language_id.fit(docs, fold(F.col("doc_id"), 4) != 2)
    return language_id.identify(docs, net).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(load(spark, sf_dir, "documents"))[0]


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, model, 0.7).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(load(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, "n_pii")
    return out.select("doc_id", "text", *(F.get("n_pii", F.lit(i)).cast("long").alias(f"n_{kind}") for i, (kind, _) in enumerate(pii.KINDS)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rewritten(load(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(load(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_language_id, op3_secret_scan, op4_toxicity, op5_substring_dedup, op6_decontamination, op7_pii, op8_warc, op9_quality_rules, op10_mixing)
}

_W = r"[^\x20\x09-\x0D]+"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op3_secret_scan": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k(ord, kind, pattern, grp, least_) AS (VALUES
  (0, 'assign', '{_ASSIGN.replace("'", "''")}', 2, 8), (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 20), (4, 'forge', 'gh[pousr]_[A-Za-z0-9]{{36,}}', 0, 40),
  (5, 'jwt', 'eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}', 0, 36)),
m AS (
  SELECT r, ord, kind, least_, unnest(range(1, len(hits) + 1)) AS i, hits, vals, gaps FROM (
    SELECT r, ord, kind, least_, list_transform(regexp_extract_all(text, pattern, 0), lambda x: length(x)) AS hits,
      list_transform(regexp_extract_all(text, pattern, grp), lambda x: length(x)) AS vals,
      list_transform(string_split_regex(text, pattern), lambda x: length(x)) AS gaps
    FROM t, k WHERE regexp_matches(text, pattern))
), p AS (
  SELECT r, ord, kind, hits[i] AS n, list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) AS st FROM m WHERE vals[i] >= least_
), a AS (
  SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(kind || ':' || st::BIGINT || ':' || (st + n)::BIGINT, ',' ORDER BY st, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || st::BIGINT || ':' || (st + n)::BIGINT, ',' ORDER BY st, ord) AS spans FROM p GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (r)""",
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM q""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size, substr(sha256(coalesce(doc_id::VARCHAR, '') || '/mix-1'), 1, 16) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM d GROUP BY source
), r AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), b AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT min_by(level, ratio) FROM l WHERE level <= ratio), 0) * w) AS target FROM l
), x AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, ((CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END) * size
  + greatest(0, least(size, CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END - ahead)))::BIGINT AS taken FROM x""",
}
