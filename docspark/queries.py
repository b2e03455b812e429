"""One query for each operator over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions import time as tm
from docspark.operators import dedup, features, incremental, ml, nlp, providers, quality, relational, retrieval
from docspark.plans import sql_models
from docspark.session import table
from docspark.sources import files
from docspark.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def model(name: str, sql: str, oracle: str | None = None) -> None:
    """A SQL model: the same statement, with its references resolved, is run here and by the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql_models.run(spark, sql, {n: table(spark, sf_dir, n) for n in sql_models.refs(sql)})

    QUERIES[name] = run
    ORACLE[name] = oracle or sql_models.compile_sql(sql, {n: n for n in _TABLES})


model("sql_join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, CAST(round(coalesce(sum(o.o_totalprice), 0), 2) AS DOUBLE) AS spent FROM {{ ref('customer') }} c LEFT JOIN {{ ref('orders') }} o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
model("sql_join_inner", "SELECT n.n_name, count(*) AS customers FROM {{ ref('customer') }} c JOIN {{ ref('nation') }} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
model("sql_join_full", "SELECT coalesce(a.nk, b.nk) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS nk, count(*) AS n FROM {{ ref('customer') }} GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS nk, count(*) AS n FROM {{ ref('supplier') }} GROUP BY s_nationkey) b ON a.nk = b.nk")
model("sql_semi", "SELECT c_custkey, c_name FROM {{ ref('customer') }} c WHERE EXISTS (SELECT 1 FROM {{ ref('orders') }} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
model("sql_anti", "SELECT c_custkey, c_name FROM {{ ref('customer') }} c WHERE NOT EXISTS (SELECT 1 FROM {{ ref('orders') }} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
model("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS qty FROM {{ ref('lineitem') }} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
model("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {{ ref('orders') }} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
model("sql_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM {{ ref('part') }} GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
model("sql_window_rank", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {{ ref('orders') }}) t WHERE rn <= 3")
model("sql_window_frame", "SELECT event_id, CAST(round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS DOUBLE) AS moving FROM {{ ref('events') }}")
model("sql_setops", "SELECT c_nationkey AS k FROM {{ ref('customer') }} INTERSECT SELECT s_nationkey FROM {{ ref('supplier') }} EXCEPT SELECT n_nationkey FROM {{ ref('nation') }} WHERE n_regionkey = 0")
model("sql_union", "SELECT c_name AS name FROM {{ ref('customer') }} WHERE c_acctbal < 0 UNION SELECT s_name FROM {{ ref('supplier') }} WHERE s_acctbal < 0")


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2)::DOUBLE AS total FROM orders GROUP BY 1")
def date_trunc_month(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_name IS NOT NULL")
def predicates(spark, d):
    p = relational.predicate([("p_size", "ge", 10), ("p_size", "lt", 20), ("p_brand", "in", ["Brand#11", "Brand#12", "Brand#13"]), ("p_name", "is_not_null", None)])
    return table(spark, d, "part").where(p).select("p_partkey", "p_size")


@query("SELECT 0::BIGINT AS null_keys, (count(*) - count(DISTINCT o_custkey))::BIGINT AS duplicate_keys FROM orders")
def check_keys(spark, d):
    return relational.check_keys(table(spark, d, "orders"), ["o_custkey"])


_VERSIONS = "SELECT o_custkey AS k, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders"


@query(f"SELECT k, o_orderkey FROM ({_VERSIONS}) t WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to)")
def as_of_filter(spark, d):
    v = sql_models.run(spark, _VERSIONS.replace("FROM orders", "FROM {{ ref('orders') }}"), {"orders": table(spark, d, "orders")})
    v = v.withColumn("recorded_from", F.lit("1900-01-01").cast("timestamp_ntz")).withColumn("recorded_to", F.lit(None).cast("timestamp_ntz"))
    at = F.lit("1996-06-01").cast("timestamp_ntz")
    return relational.active_as_of(v, at, at).select("k", "o_orderkey")


_TOK = r"[\p{L}\p{N}_]+"


@query(
    rf"""SELECT doc_id, length(text)::BIGINT AS char_count, len(regexp_extract_all(text, '{_TOK}'))::BIGINT AS word_count,
  CASE WHEN regexp_matches(text, '\S') THEN greatest(len(list_filter(string_split_regex(regexp_replace(text, '[.!?]+(\s+|$)', chr(1), 'g'), chr(1)), lambda p: regexp_matches(p, '\S'))), 1) ELSE 0 END::BIGINT AS sentence_count,
  CASE WHEN regexp_matches(text, '\S') THEN greatest(len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S'))), 1) ELSE 0 END::BIGINT AS paragraph_count FROM documents"""
)
def text_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in tx.text_stats(F.col("text")).items()))


@query()
def pii_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.redact(F.col("text")).alias("text"))


_redact = "text"
for _kind, _pattern in tx.PII:
    _redact = f"regexp_replace({_redact}, '{_pattern}', '[{_kind}]', 'g')"
ORACLE["pii_redact"] = f"SELECT doc_id, {_redact} AS text FROM documents"


@query(
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(0, greatest(len(w) - 20 - 1, 0) + 1, 180) END) AS s FROM w)
SELECT doc_id, (s // 180)::BIGINT AS chunk_index, array_to_string(w[s + 1:s + 200], ' ') AS text FROM s"""
)
def chunk_word_windows(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(tx.word_windows(F.col("text"), 200, 20)).alias("chunk_index", "text"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query()
def chunk_recursive(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(tx.recursive_chunks(1000, 100)("text")).alias("c")).select("doc_id", "c.*")
    return c.withColumn("chunk_id", F.sha2(F.concat_ws("/", "doc_id", "chunk_index", "text"), 256))


@query()
def clean_encoding(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_encoding("text").alias("text"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{_TOK}'))::BIGINT AS word_token_count FROM documents")
def count_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("word_token_count"))


_LANG_SQL = " UNION ALL ".join(f"SELECT doc_id, text, -len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words)}))) AS n, '{lang}' AS lang FROM w" for lang, words in tx.COMMON.items())


@query(
    rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{_TOK}') AS w FROM documents), s AS ({_LANG_SQL}),
b AS (SELECT doc_id, any_value(text) AS text, min(n) AS n, min_by(lang, (n, lang)) AS lang FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 10 OR n = 0 THEN NULL ELSE lang END AS language FROM b"""
)
def detect_language(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.detect_language(F.col("text")).alias("language"))


@query()
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", files.html_document("html").alias("h")).select("page_id", "h.title", "h.text", F.size("h.links").alias("n_links"), "h.sections")


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def extract_json(spark, d):
    got, _ = files.json_fields(F.col("props"), ["k"])
    return table(spark, d, "events").select("event_id", got["k"].alias("k"))


def _sentences(spark, d) -> DataFrame:
    return nlp.token_table(table(spark, d, "documents"))


_STOP = ", ".join(repr(w) for w in tx.STOP_WORDS)
#: Sentences end at [.!?] before blanks; RE2 has no look-behind, so a mark is set after them first.
_TOKENS_SQL = rf"""s AS (SELECT doc_id, unnest(x) AS sentence, unnest(range(len(x))) AS si FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents)),
t0 AS (SELECT doc_id, si, unnest(w) AS token_text, unnest(range(len(w))) AS p FROM (SELECT doc_id, si, regexp_extract_all(sentence, '{_TOK}') AS w FROM s)),
t AS (SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY si, p) - 1)::BIGINT AS token_index, si::BIGINT AS sentence_index, token_text, lower(token_text) AS lemma,
  lower(token_text) IN ({_STOP}) AS is_stop, regexp_full_match(token_text, '\p{{L}}+') AS is_alpha FROM t0)"""


@query(f"WITH {_TOKENS_SQL} SELECT * FROM t")
def nlp_tokens(spark, d):
    return _sentences(spark, d)


@query(
    f"""WITH {_TOKENS_SQL},
g AS (SELECT document_id, lemma AS phrase FROM t WHERE NOT is_stop UNION ALL
  SELECT document_id, lemma || ' ' || l2 FROM (SELECT *, lead(lemma) OVER w AS l2, lead(is_stop) OVER w AS s2 FROM t WINDOW w AS (PARTITION BY document_id, sentence_index ORDER BY token_index)) WHERE NOT is_stop AND NOT s2),
c AS (SELECT document_id, phrase, count(*) AS count FROM g GROUP BY ALL),
r AS (SELECT *, round(count / sum(count) OVER (PARTITION BY document_id), 9) AS score FROM c)
SELECT * FROM (SELECT document_id, phrase, count, score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, phrase) AS rank FROM r) WHERE rank <= 5"""
)
def keyphrases_top5(spark, d):
    return nlp.keyphrases(_sentences(spark, d), 5, 2)


#: A small lexicon for the tables' invented words.
_LEXICON = (("the", "frequent", 0.5), ("is", "frequent", 0.25), ("idiot", "harsh", 1.0), ("worthless", "harsh", 0.8), ("pathetic", "harsh", 0.7))


@query(
    f"""WITH {_TOKENS_SQL}, lex(term, category, weight) AS (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _LEXICON)}),
x AS (SELECT *, max((lemma IN ('not', 'no', 'never'))::INT) OVER (PARTITION BY document_id, sentence_index ORDER BY token_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS neg FROM t),
h AS (SELECT document_id, category, count(*) AS hits, sum(weight * CASE WHEN neg = 1 THEN -1 ELSE 1 END) AS w FROM x JOIN lex ON lemma = term GROUP BY ALL),
n AS (SELECT document_id, count(*) AS token_count FROM t GROUP BY ALL),
p AS (SELECT document_id, sum(hits) FILTER (category = 'frequent') AS fh, sum(w) FILTER (category = 'frequent') AS fw, sum(hits) FILTER (category = 'harsh') AS hh, sum(w) FILTER (category = 'harsh') AS hw FROM h GROUP BY ALL)
SELECT d.doc_id AS document_id, coalesce(token_count, 0) AS token_count, coalesce(fh, 0)::BIGINT AS frequent_hits, CASE WHEN token_count > 0 THEN round(coalesce(fw, 0) / token_count, 9) END AS frequent_score,
  coalesce(hh, 0)::BIGINT AS harsh_hits, CASE WHEN token_count > 0 THEN round(coalesce(hw, 0) / token_count, 9) END AS harsh_score, CASE WHEN token_count > 0 THEN 'ok' ELSE 'insufficient_text' END AS status
FROM documents d LEFT JOIN n ON n.document_id = d.doc_id LEFT JOIN p ON p.document_id = d.doc_id"""
)
def document_tone(spark, d):
    lex = spark.createDataFrame(list(_LEXICON), "term string, category string, weight double")
    return nlp.document_tone(_sentences(spark, d), lex, table(spark, d, "documents").select(F.col("doc_id").alias("document_id")))


@query(
    f"""WITH {_TOKENS_SQL}, f AS (SELECT document_id, count(*) AS token_count, count(DISTINCT lemma) AS unique_lemmas, count(DISTINCT sentence_index) AS sentence_count, sum(is_stop::INT)::BIGINT AS stop_count, sum(is_alpha::INT)::BIGINT AS alpha_count FROM t GROUP BY ALL)
SELECT d.doc_id AS document_id, coalesce(token_count, 0) AS token_count, coalesce(unique_lemmas, 0) AS unique_lemmas, sentence_count, coalesce(stop_count, 0) AS stop_count, coalesce(alpha_count, 0) AS alpha_count,
  CASE WHEN token_count > 0 THEN round(stop_count / token_count, 9) END AS stop_ratio, CASE WHEN token_count > 0 THEN round(unique_lemmas / token_count, 9) END AS lexical_diversity
FROM documents d LEFT JOIN f ON f.document_id = d.doc_id"""
)
def document_features(spark, d):
    return nlp.document_features(_sentences(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("document_id")))


@query(
    """WITH m AS (SELECT c_custkey AS entity_id, upper(c_mktsegment) || ' ' AS entity_text FROM customer),
a AS (SELECT DISTINCT c_mktsegment AS alias, 'segment' AS entity_namespace, 'S:' || c_mktsegment AS canonical_id FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT m.entity_id, m.entity_text, a.entity_namespace, a.canonical_id, CASE WHEN a.alias IS NULL THEN NULL ELSE 'normalized' END AS method, CASE WHEN a.alias IS NULL THEN 'unmatched' ELSE 'matched' END AS status
FROM m LEFT JOIN a ON trim(lower(m.entity_text)) = lower(a.alias)"""
)
def entity_links_alias(spark, d):
    c = table(spark, d, "customer")
    m = c.select(F.col("c_custkey").alias("entity_id"), F.concat(F.upper("c_mktsegment"), F.lit(" ")).alias("entity_text"))
    a = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("alias"), F.lit("segment").alias("entity_namespace"), F.concat(F.lit("S:"), "c_mktsegment").alias("canonical_id")).distinct()
    return nlp.link_aliases(m, a, tx.normalise_alias)


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3)))"


@query(
    f"""WITH a AS (SELECT n_nationkey AS left_id, {_GRAMS} AS g FROM (SELECT n_nationkey, '  ' || lower(n_name) || ' ' AS t FROM nation)),
b AS (SELECT s_suppkey AS right_id, {_GRAMS} AS g FROM (SELECT s_suppkey, '  ' || lower(replace(s_name, 'Supplier', 'Nation')) || ' ' AS t FROM supplier)),
s AS (SELECT left_id, right_id, 2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS score FROM a, b)
SELECT left_id, right_id, round(score, 9) AS score FROM s WHERE score >= 0.6"""
)
def entity_links_fuzzy(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("left_id"), F.lower("n_name").alias("text"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("right_id"), F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Nation"))).alias("text"))
    return nlp.fuzzy_links(a, b, tx.trigrams, 0.6)


#: Mentions: frequent harsh words of a sentence stand in for named entities.
_NAMES = ("idiot", "worthless", "pathetic", "clown", "moron")


def _mentions(spark, d) -> DataFrame:
    t = _sentences(spark, d).where(F.col("lemma").isin(*_NAMES))
    return t.select("document_id", "sentence_index", F.col("token_index").alias("start"), (F.col("token_index") + 1).alias("end"), F.concat_ws(":", "document_id", "token_index").alias("entity_id"), F.col("lemma").alias("label"))


_MENTIONS_SQL = f"""{_TOKENS_SQL}, m AS (SELECT document_id, sentence_index, token_index AS start, document_id || ':' || token_index AS entity_id, lemma AS label FROM t WHERE lemma IN {_NAMES!r})"""


@query(
    f"""WITH {_MENTIONS_SQL} SELECT a.document_id, a.entity_id AS source_id, b.entity_id AS target_id, a.label AS source_label, b.label AS target_label
FROM m a JOIN m b ON a.document_id = b.document_id AND a.sentence_index = b.sentence_index AND a.start < b.start"""
)
def relations_cooccur(spark, d):
    return nlp.cooccurrences(_mentions(spark, d))


@query(
    f"""WITH {_MENTIONS_SQL} SELECT least(a.label, b.label) AS source, greatest(a.label, b.label) AS target, count(*) AS weight
FROM m a JOIN m b ON a.document_id = b.document_id AND a.start < b.start AND b.start - (a.start + 1) <= 50 WHERE a.label <> b.label GROUP BY ALL"""
)
def concept_edges(spark, d):
    return nlp.concept_edges(nlp.cooccurrences(_mentions(spark, d), 50), "source_label", "target_label")


_Q = quality


def _check(name: str, test, sql: str) -> None:
    """sql: a SELECT of failures and measure."""
    QUERIES[f"quality_{name}"] = lambda spark, d: test(lambda t: table(spark, d, t))
    ORACLE[f"quality_{name}"] = f"SELECT '{name}' AS test, failures::BIGINT AS failures, round(measure::DOUBLE, 6) AS measure FROM ({sql})"


def _measured(value: str, source: str, bad: str) -> str:
    return f"SELECT CASE WHEN {bad} THEN 1 ELSE 0 END AS failures, v AS measure FROM (SELECT {value} AS v FROM {source})"


_check("not_null", lambda t: _Q.not_null(t("documents"), ["text", "lang"]), "SELECT f AS failures, f AS measure FROM (SELECT count(*) FILTER (text IS NULL) + count(*) FILTER (lang IS NULL) AS f FROM documents)")
_check("unique", lambda t: _Q.unique(t("documents"), ["text"]), "SELECT count(*) AS failures, count(*) AS measure FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
_check("min_rows", lambda t: _Q.min_rows(t("nation"), 26), "SELECT (count(*) < 26)::INT AS failures, count(*) AS measure FROM nation")
_check("python", lambda t: _Q.custom(t("orders"), lambda df: F.col("o_totalprice") < 1000), "SELECT count(*) AS failures, count(*) AS measure FROM orders WHERE o_totalprice < 1000")
_check("matches_regex", lambda t: _Q.matches_regex(t("part"), "p_brand", "^Brand#1[0-9]$"), "SELECT count(*) AS failures, count(*) AS measure FROM part WHERE NOT regexp_matches(p_brand, '^Brand#1[0-9]$')")
_check("accepted_values", lambda t: _Q.accepted_values(t("documents"), "lang", ["en", "de"]), "SELECT count(*) AS failures, count(*) AS measure FROM documents WHERE lang NOT IN ('en', 'de')")
_check("accepted_range", lambda t: _Q.accepted_range(t("customer"), "c_acctbal", 0, 9000), "SELECT count(*) AS failures, count(*) AS measure FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
_check("null_rate", lambda t: _Q.null_rate(t("documents"), "lang", 0.1), _measured("coalesce(avg((lang IS NULL)::INT), 0)", "documents", "v > 0.1"))
_check("relationships", lambda t: _Q.relationships(t("labels"), "doc_id", t("documents").where("doc_id % 7 <> 0"), "doc_id"), "SELECT count(*) AS failures, count(*) AS measure FROM labels WHERE doc_id % 7 = 0")
_check("grounded_in", lambda t: _Q.grounded_in(t("documents").withColumn("v", F.concat(F.lit(" "), F.upper("source"), F.lit("\n"))), "v", "text"), "SELECT count(*) AS failures, count(*) AS measure FROM documents WHERE trim(source) <> '' AND NOT contains(lower(text), lower(trim(source)))")
_check("embedding_valid", lambda t: _Q.embedding_valid(t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 9 > 1, F.col("embedding"))), "embedding", 64, 0.5, 0.9999), "SELECT count(*) AS failures, count(*) AS measure FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 9 > 1 AND sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) NOT BETWEEN 0.5 AND 0.9999")
_check("embedding_variance", lambda t: _Q.embedding_variance(t("embeddings"), "embedding", 0.001), "SELECT (avg(v) < 0.001)::INT AS failures, avg(v) AS measure FROM (SELECT var_pop(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)")
_check("embedding_duplicates", lambda t: _Q.embedding_duplicates(t("embeddings"), "embedding", 0.0), _measured("sum(n - 1) / sum(n)", "(SELECT count(*) AS n FROM embeddings GROUP BY embedding)", "v > 0"))
_check("embedding_outliers", lambda t: _Q.embedding_outliers(t("embeddings"), "embedding", 2.0), "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT i, avg(x) AS c FROM x GROUP BY i), e AS (SELECT sqrt(sum((x - c) ** 2)) AS e FROM x JOIN c USING (i) GROUP BY vec_id) SELECT count(*) AS failures, count(*) AS measure FROM e WHERE e > (SELECT avg(e) + 2 * stddev_pop(e) FROM e)")
_check("column_stat", lambda t: _Q.column_stat(t("lineitem"), "l_quantity", "quantile", 0, 10, 0.9), _measured("quantile_cont(l_quantity, 0.9)", "lineitem", "v < 0 OR v > 10"))
_check("cardinality", lambda t: _Q.cardinality(t("part"), "p_brand", 10, 20), _measured("count(DISTINCT p_brand)", "part", "v < 10 OR v > 20"))
_check("outlier_rate", lambda t: _Q.outlier_rate(t("documents"), "n_chars", 0.01), "WITH q AS (SELECT quantile_cont(n_chars::DOUBLE, 0.25) AS a, quantile_cont(n_chars::DOUBLE, 0.75) AS b FROM documents) SELECT (avg(o) > 0.01)::INT AS failures, avg(o) AS measure FROM (SELECT (n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a))::INT AS o FROM documents, q)")
_check("golden", lambda t: _Q.golden(t("orders").select("o_orderkey", "o_totalprice"), t("orders").where("o_orderkey % 10 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice")), ["o_orderkey"], ["o_totalprice"], 0.5), "SELECT count(*) FILTER (o_orderkey % 10 = 0 OR o_orderkey % 11 = 0) AS failures, count(*) AS measure FROM orders")

_DRIFT_SQL = """WITH b AS (SELECT l_quantity AS v FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT l_quantity AS v FROM lineitem WHERE l_orderkey % 2 = 1 AND l_quantity > 5),
e AS (SELECT list_distinct(quantile_cont(v::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM b),
x AS (SELECT len(list_filter(e, lambda k: v > k)) AS bin, 1 AS nb, 0 AS nc FROM b, e UNION ALL SELECT len(list_filter(e, lambda k: v > k)), 0, 1 FROM c, e),
g AS (SELECT bin, sum(nb) AS nb, sum(nc) AS nc FROM x GROUP BY bin), p AS (SELECT *, nb / sum(nb) OVER () AS p, nc / sum(nc) OVER () AS q, sum(nc) OVER () AS tc FROM g)
"""


def _halves(t) -> tuple[DataFrame, DataFrame]:
    x = t("lineitem")
    return x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 = 1 AND l_quantity > 5")


def _drift(method: str, sql: str) -> None:
    QUERIES[f"drift_{method}"] = lambda spark, d: _Q.drift(*_halves(lambda t: table(spark, d, t)), "l_quantity", method, 0.05)
    ORACLE[f"drift_{method}"] = f"{_DRIFT_SQL} SELECT 'drift_{method}' AS test, (v > 0.05)::BIGINT AS failures, round(v, 6) AS measure FROM ({sql})"


_drift("psi", "SELECT sum((q - p) * ln((q + 1e-6) / (p + 1e-6))) AS v FROM p")
_drift("js", "SELECT sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS v FROM p")
_drift("chi2", "SELECT max(tc) * sum((q - p) ** 2 / (p + 1e-12)) AS v FROM p")
_drift("ks", "SELECT max(abs(fb - fc)) AS v FROM (SELECT sum(x) OVER (ORDER BY v) / sum(x) OVER () AS fb, sum(y) OVER (ORDER BY v) / sum(y) OVER () AS fc FROM (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT v, 1 AS x, 0 AS y FROM b UNION ALL SELECT v, 0, 1 FROM c) GROUP BY v))")


@query("WITH g AS (SELECT text, min(doc_id) AS g, count(*) AS n FROM documents GROUP BY text) SELECT doc_id, CASE WHEN n > 1 THEN g END AS duplicate_group FROM documents JOIN g USING (text)")
def dedup_exact(spark, d):
    return dedup.exact_groups(table(spark, d, "documents"))


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, (SELECT min(b) FROM r WHERE a = doc_id) AS duplicate_group FROM documents"""
)
def find_duplicates(spark, d):
    return dedup.near_duplicates(table(spark, d, "documents"), 0.8)


_TERMS_SQL = f"""c AS (SELECT row_id, term, count(*) AS count FROM (SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY ALL)"""


@query(f"WITH {_TERMS_SQL} SELECT * FROM c")
def count_features(spark, d):
    return ml.terms(table(spark, d, "documents"))


_VOCAB_SQL = "v AS (SELECT term, df, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_index FROM (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 1000))"


@query(
    f"""WITH {_TERMS_SQL}, {_VOCAB_SQL}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT *, count / sum(count) OVER (PARTITION BY row_id) AS tf FROM c JOIN v USING (term))
SELECT row_id, term, term_index, count, round(tf, 9) AS tf, round(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1, 9) AS idf, round(tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1), 9) AS tfidf FROM f, n"""
)
def tfidf_features(spark, d):
    docs = table(spark, d, "documents")
    c = ml.terms(docs)
    return ml.tfidf(c, ml.vocabulary(c, 2, 1.0, 1000), docs.count())


@query()
def hashing_features(spark, d):
    return ml.hashed(ml.terms(table(spark, d, "documents")), 4096)


@query(
    f"""WITH {_TERMS_SQL}, r AS (SELECT c.*, quality::VARCHAR AS label FROM c JOIN labels ON row_id = doc_id),
tr AS (SELECT * FROM r WHERE row_id % 2 = 0), te AS (SELECT row_id, term, count FROM r WHERE row_id % 2 = 1),
dl AS (SELECT label, count(DISTINCT row_id) AS c FROM tr GROUP BY label), T AS (SELECT label, sum(count) AS T FROM tr GROUP BY label), V AS (SELECT count(DISTINCT term) AS V FROM tr),
pr AS (SELECT label, ln((c + 1) / (sum(c) OVER () + count(*) OVER ())) AS lp FROM dl),
li AS (SELECT label, term, sum(count) AS t FROM tr GROUP BY ALL), kt AS (SELECT DISTINCT term FROM tr),
sc AS (SELECT te.row_id, pr.label, any_value(pr.lp) + sum(CASE WHEN kt.term IS NULL THEN 0 ELSE te.count * ln((coalesce(li.t, 0) + 1) / (T.T + V.V)) END) AS s
  FROM te CROSS JOIN pr JOIN T ON T.label = pr.label CROSS JOIN V LEFT JOIN kt ON kt.term = te.term LEFT JOIN li ON li.term = te.term AND li.label = pr.label GROUP BY te.row_id, pr.label),
m AS (SELECT *, max(s) OVER (PARTITION BY row_id) AS top FROM sc), z AS (SELECT row_id, label, s, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY row_id) AS p FROM m)
SELECT row_id, label, round(p, 6) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, label) AS r FROM z) WHERE r = 1"""
)
def naive_bayes_predict(spark, d):
    c = ml.terms(table(spark, d, "documents")).join(table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("label")), "row_id")
    train, test = c.where("row_id % 2 = 0"), c.where("row_id % 2 = 1").select("row_id", "term", "count")
    priors, like = ml.naive_bayes(train)
    return ml.naive_bayes_predict(test, priors, like, train)


@query(
    f"""WITH {_TERMS_SQL}, g AS (SELECT lang AS cluster, term, sum(count) AS n FROM c JOIN documents ON doc_id = row_id GROUP BY ALL),
x AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS tf, sum(n) OVER (PARTITION BY term) AS al FROM g), m AS (SELECT sum(n) / count(DISTINCT cluster) AS m FROM g),
y AS (SELECT cluster, term, round(tf * ln(1 + m / al), 9) AS score FROM x, m)
SELECT cluster, rank, term, score FROM (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) - 1)::BIGINT AS rank FROM y) WHERE rank < 10"""
)
def ctfidf_terms(spark, d):
    docs = table(spark, d, "documents")
    return ml.ctfidf(ml.terms(docs), docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("cluster")))


@query(
    ORACLE["ctfidf_terms"].replace("\nSELECT cluster, rank, term, score FROM", ", t AS (SELECT cluster, rank, term FROM")
    + """), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), p AS (SELECT a.cluster, a.term AS a, b.term AS b FROM t a JOIN t b ON a.cluster = b.cluster AND a.rank < b.rank),
q AS (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT a, b FROM p) JOIN c x ON x.term = a JOIN c y ON y.term = b AND y.row_id = x.row_id GROUP BY a, b)
SELECT cluster, count(*) AS pairs, round(avg(ln((coalesce(n, 0) + 1) / (df + 1))), 6) AS umass FROM p LEFT JOIN q USING (a, b) JOIN d ON d.term = p.a GROUP BY cluster"""
)
def topic_coherence(spark, d):
    docs = table(spark, d, "documents")
    counts = ml.terms(docs)
    return ml.coherence(ml.ctfidf(counts, docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("cluster"))), counts)


@query(
    """WITH e AS (SELECT vec_id, label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT cluster, i, avg(x) AS c FROM e GROUP BY ALL), r AS (SELECT vec_id, cluster, sum((x - c) ** 2) AS d2 FROM e JOIN m USING (cluster, i) GROUP BY ALL)
SELECT cluster, count(*) AS size, round(sum(d2), 6) AS inertia FROM r GROUP BY cluster"""
)
def cluster_inertia(spark, d):
    v = table(spark, d, "embeddings")
    return ml.inertia(ml.distances(v, ml.centroids(v)))


@query()
def kmeans_clusters(spark, d):
    return ml.kmeans(table(spark, d, "embeddings"), 10)


@query()
def kmeans_representatives(spark, d):
    return ml.representatives(ml.kmeans(table(spark, d, "embeddings"), 10), 3)


@query()
def lda_topics(spark, d):
    c = ml.terms(table(spark, d, "documents"))
    return ml.lda_topics(c, ml.vocabulary(c, 2, 1.0, 500), 4)


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS b FROM embeddings),
s AS (SELECT query_id, row_id, round(list_cosine_similarity(a, b), 6) AS score FROM q, r WHERE query_id <> row_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s) WHERE rank <= 10"""
)
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    hits = retrieval.vector_topk(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), 10, exclude_self=True)
    return hits.withColumn("score", F.round("score", 6))


_BM25_SQL = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM benchmark),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOK}') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10)"""


def _bm25(spark, d) -> DataFrame:
    return retrieval.bm25_topk(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents").select("doc_id", "text"), 10)


@query(f"WITH {_BM25_SQL} SELECT * FROM b")
def bm25_topk(spark, d):
    return _bm25(spark, d)


#: A vector that SQL can make: how often the text has each letter.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTERS_SQL = "list_transform(string_split('" + ",".join(_LETTERS) + "', ','), lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE)"


def _letters(text) -> F.Column:
    return F.array(*((F.length(text) - F.length(F.translate(text, c, ""))).cast("double") for c in _LETTERS))


@query(
    f"""WITH {_BM25_SQL}, va AS (SELECT item_id AS query_id, {_LETTERS_SQL} AS a FROM (SELECT item_id, lower(text) AS t FROM benchmark)), vb AS (SELECT doc_id, {_LETTERS_SQL} AS b FROM (SELECT doc_id, lower(text) AS t FROM documents)),
vs AS (SELECT query_id, doc_id, round(CASE WHEN list_sum(b) > 0 AND list_sum(a) > 0 THEN list_cosine_similarity(a, b) ELSE 0 END, 9) AS score FROM va, vb), v AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs),
l AS (SELECT query_id, doc_id AS id, rank FROM b UNION ALL SELECT * FROM v WHERE rank <= 10), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)) * 30.5::DOUBLE, 9) AS score FROM l GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_rrf(spark, d):
    words = _bm25(spark, d).select("query_id", F.col("doc_id").alias("id"), "rank")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), _letters(F.lower("text")).alias("v"))
    v = retrieval.vector_topk(q, table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), _letters(F.lower("text")).alias("v")), 10)
    return retrieval.rrf([words, v.select("query_id", F.col("row_id").alias("id"), "rank")], 10)


@query(
    f"""WITH {_BM25_SQL}, g AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
j AS (SELECT b.*, g.doc_id IS NOT NULL AS rel FROM b LEFT JOIN g USING (query_id, doc_id)), r AS (SELECT query_id, count(*) AS relevant FROM g GROUP BY ALL),
h AS (SELECT query_id, count(*) AS returned, count(*) FILTER (rel) AS found, min(rank) FILTER (rel) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rel), 0) AS dcg FROM j GROUP BY ALL)
SELECT query_id, CASE WHEN relevant > 0 THEN round(coalesce(found / relevant, 0), 6) END AS recall, CASE WHEN relevant > 0 THEN round(coalesce(found / returned, 0), 6) END AS precision,
  CASE WHEN relevant > 0 THEN coalesce((found > 0)::INT, 0)::DOUBLE END AS hit_rate, CASE WHEN relevant > 0 THEN round(coalesce(1 / first, 0), 6) END AS mrr,
  CASE WHEN relevant > 0 THEN round(coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) END AS ndcg FROM r FULL JOIN h USING (query_id)"""
)
def retrieval_metrics(spark, d):
    b = _bm25(spark, d).select("query_id", F.col("doc_id").alias("id"), "rank")
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    # An item that a document contains shares its first words, so an equi-join comes before the containment test.
    ws = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    runs = lambda text: tx.let(ws(text), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5))))
    q = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), F.xxhash64(F.slice(ws("text"), 2, 5)).alias("h"))
    g = docs.select("doc_id", "text", F.explode(F.array_distinct(runs(F.col("text")))).alias("h")).select("doc_id", "h").join(q, "h").select("query_id", "item", "doc_id").distinct()
    g = g.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("query_id", F.col("doc_id").alias("id")).distinct()
    return retrieval.retrieval_metrics(b, g, 10)


@query(
    f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{_TOK}') AS w FROM documents), s AS ({_LANG_SQL}),
b AS (SELECT doc_id, any_value(text) AS text, min(n) AS n, min_by(lang, (n, lang)) AS lang FROM s GROUP BY doc_id),
p AS (SELECT d.lang AS e, CASE WHEN length(trim(b.text, ' ')) < 10 OR n = 0 THEN 'none' ELSE b.lang END AS p FROM documents d JOIN b USING (doc_id)),
l AS (SELECT DISTINCT e AS label FROM p UNION SELECT p FROM p),
g AS (SELECT label, (SELECT count(*) FROM p WHERE e = label AND p = label) AS tp, (SELECT count(*) FROM p WHERE p = label) AS pp, (SELECT count(*) FROM p WHERE e = label) AS s FROM l),
f AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re FROM g), h AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM f)
SELECT label, metric, round(value, 6) AS value FROM (SELECT label, 'precision' AS metric, pr::DOUBLE AS value FROM h UNION ALL SELECT label, 'recall', re FROM h UNION ALL SELECT label, 'f1', f1 FROM h UNION ALL SELECT label, 'support', s FROM h
UNION ALL SELECT NULL, 'accuracy', sum(tp) / sum(s) FROM h UNION ALL SELECT NULL, 'macro_f1', avg(f1) FROM h)"""
)
def classification_eval(spark, d):
    return retrieval.classification_report(table(spark, d, "documents").select(F.col("lang").alias("expected"), tx.detect_language(F.col("text"), "none").alias("predicted")))


_STATE_SQL = """cur AS (SELECT o_orderkey::VARCHAR AS record_key, o_orderstatus AS input_fingerprint, 'v2' AS code_version FROM orders WHERE o_orderkey % 5 <> 0),
st AS (SELECT o_orderkey::VARCHAR AS record_key, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS input_fingerprint, 'v2' AS code_version FROM orders WHERE o_orderkey % 3 <> 0)"""


def _state(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("record_key"), F.col("o_orderstatus").alias("input_fingerprint"), F.lit("v2").alias("code_version"), "o_orderkey")
    return o.where("o_orderkey % 5 <> 0").drop("o_orderkey"), o.where("o_orderkey % 3 <> 0").withColumn("input_fingerprint", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("input_fingerprint"))).drop("o_orderkey")


@query(f"WITH {_STATE_SQL} SELECT c.*, CASE WHEN s.record_key IS NULL THEN 'new' WHEN c.input_fingerprint = s.input_fingerprint AND c.code_version = s.code_version THEN 'unchanged' ELSE 'changed' END AS status FROM cur c LEFT JOIN st s USING (record_key)")
def incremental_classify(spark, d):
    return incremental.classify(*_state(spark, d))


@query(f"WITH {_STATE_SQL} SELECT * FROM st WHERE record_key NOT IN (SELECT record_key FROM cur)")
def incremental_removed(spark, d):
    return incremental.removed(*_state(spark, d))


@query(f"WITH {_STATE_SQL} SELECT * FROM cur UNION ALL SELECT * FROM st WHERE record_key NOT IN (SELECT record_key FROM cur)")
def upsert_keyed(spark, d):
    cur, st = _state(spark, d)
    return incremental.upsert(st, cur, ["record_key"], ["input_fingerprint"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN -1 ELSE l_quantity END::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber = 1")
def replace_children(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    changed = li.where("l_orderkey % 4 = 0").select("l_orderkey")
    return incremental.replace_children(li, li.where("l_orderkey % 4 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.lit(-1.0)), changed, "l_orderkey")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return ev.tumbling(table(spark, d, "events"))


@query(
    """WITH e AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, s"""
)
def events_sessions(spark, d):
    return ev.sessions(table(spark, d, "events"))


@query("SELECT doc_id AS document_id, 'number' AS label, unnest(range(len(h)))::INT AS entity_index, unnest(h) AS entity_text FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS h FROM documents) UNION ALL SELECT doc_id, 'host', unnest(range(len(h)))::INT, unnest(h) FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+[.]example[.][a-z]+') AS h FROM documents)")
def nlp_entities(spark, d):
    return nlp.entity_table(table(spark, d, "documents"), {"number": "[0-9]{2,}", "host": "[a-z]+[.]example[.][a-z]+"})


_PAIRS_SQL = f"""{_MENTIONS_SQL}, pr AS (SELECT a.document_id, a.entity_id AS source_id, b.entity_id AS target_id, a.label AS source_label, b.label AS target_label
FROM m a JOIN m b ON a.document_id = b.document_id AND a.start < b.start AND b.start - (a.start + 1) <= 50)"""
_RULES = (("idiot", "clown", "insults"), ("worthless", "pathetic", "stresses"), ("moron", "moron", "repeats"))


@query(
    f"""WITH {_PAIRS_SQL}, ru(source_label, target_label, relation) AS (VALUES {", ".join(map(str, _RULES))}), tu AS (SELECT * FROM pr UNION ALL SELECT document_id, target_id, source_id, target_label, source_label FROM pr)
SELECT tu.*, relation FROM tu JOIN ru USING (source_label, target_label)"""
)
def relations_rule(spark, d):
    rules = spark.createDataFrame(list(_RULES), "source_label string, target_label string, relation string")
    return nlp.rule_relations(nlp.cooccurrences(_mentions(spark, d), 50), rules)


_CLAIMS_SQL = "c AS (SELECT o_orderkey AS source_id, o_custkey AS target_id, CASE o_orderkey % 3 WHEN 0 THEN 'buys' WHEN 1 THEN 'knows' ELSE 'other' END AS relation, round((o_orderkey % 10) / 10.0, 1)::DOUBLE AS confidence FROM orders UNION ALL SELECT o_orderkey, o_custkey, 'knows', 0.9 FROM orders WHERE o_orderkey % 4 = 0)"


@query(
    f"""WITH {_CLAIMS_SQL}, k AS (SELECT source_id, target_id, relation, max(confidence) AS confidence FROM c WHERE relation IN ('buys', 'knows') AND source_id % 5 <> 0 GROUP BY ALL)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY source_id, target_id) > 1 THEN 'ambiguous' WHEN confidence >= 0.5 THEN 'asserted' ELSE 'no_relation' END AS status FROM k"""
)
def relations_model(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"))
    kind = F.when(F.col("source_id") % 3 == 0, "buys").when(F.col("source_id") % 3 == 1, "knows").otherwise("other")
    claims = o.withColumn("relation", kind).withColumn("confidence", F.round((F.col("source_id") % 10) / 10.0, 1)).unionByName(o.where("source_id % 4 = 0").withColumn("relation", F.lit("knows")).withColumn("confidence", F.lit(0.9)))
    return nlp.asserted_relations(claims, o.where("source_id % 5 <> 0"), ["buys", "knows"], 0.5)


_SCORED_SQL = "(SELECT l_orderkey AS entity_id, l_returnflag AS entity_namespace, l_partkey AS canonical_id, l_linenumber, l_discount AS score FROM lineitem)"


@query(f"SELECT entity_id, entity_namespace, canonical_id, score, CASE WHEN count(*) OVER w > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (SELECT *, max(score) OVER w AS top FROM {_SCORED_SQL} WINDOW w AS (PARTITION BY entity_id, entity_namespace)) WHERE score >= top - 0.015::DOUBLE WINDOW w AS (PARTITION BY entity_id, entity_namespace)")
def resolve_ambiguity(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_returnflag").alias("entity_namespace"), F.col("l_partkey").alias("canonical_id"), F.col("l_discount").alias("score"))
    return nlp.resolve_candidates(li, 0.015)


@query("SELECT l_partkey AS canonical_id, count(*) AS frequency, count(DISTINCT l_orderkey) AS documents, bool_or(l_linenumber > 6) AS ambiguous, max(l_discount) AS score FROM lineitem GROUP BY l_partkey ORDER BY frequency DESC, canonical_id LIMIT 50")
def concepts_top(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("canonical_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") > 6, "ambiguous").otherwise("matched").alias("status"), F.col("l_discount").alias("score"))
    return nlp.concepts(links, 50)


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate + INTERVAL 200 DAY END AS b FROM orders),
w AS (SELECT *, row_number() OVER x AS r, lag(b) OVER x AS p FROM o WINDOW x AS (PARTITION BY o_custkey ORDER BY a, b NULLS LAST)) SELECT o_custkey, count(*) AS overlaps FROM w WHERE r > 1 AND (p IS NULL OR p > a) GROUP BY o_custkey"""
)
def interval_overlaps(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("a"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate") + F.expr("INTERVAL 200 DAY")).alias("b"))
    return relational.overlapping(o, "o_custkey", "a", "b").groupBy("o_custkey").agg(F.count("*").alias("overlaps"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber LIMIT 500")
def keyset_page(spark, d):
    return relational.page_after(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], (100, 2), 500)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 > 0 AND (o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1996-01-01')")
def publishable_rows(spark, d):
    groups = F.when(F.col("o_orderkey") % 3 > 0, F.array(F.lit("staff"))).when(F.col("o_orderkey") % 2 == 0, F.array().cast("array<string>"))
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "closed")).withColumn("access_groups", groups)
    o = o.withColumn("expires_at", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")))
    return o.where(relational.publishable(F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN age > 48 THEN 'error' WHEN age > 24 THEN 'warn' ELSE 'pass' END AS freshness FROM (SELECT event_id, (epoch(TIMESTAMP '2024-01-10') - floor(epoch(ts))) / 3600 AS age FROM events)")
def freshness_rows(spark, d):
    e = table(spark, d, "events")
    at = F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp"))
    return e.select("event_id", relational.freshness(at, F.lit("2024-01-10 00:00:00").cast("timestamp"), 24, 48).alias("freshness"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND source <> 'src1'")
def governed_filter(spark, d):
    return retrieval.filtered(table(spark, d, "documents"), [("n_chars", "ge", 500), ("source", "ne", "src1")], [("lang", "in", ["en", "de"])]).select("doc_id")


@query("SELECT l.o_orderkey FROM orders l JOIN orders r ON r.o_orderkey = l.o_orderkey WHERE l.o_orderkey % 6 = 0 OR l.o_orderkey % 10 = 0 AND NOT l.o_orderkey % 30 = 0")
def changed_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 15 != 0, F.col("o_custkey")).alias("o_custkey"))
    new = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_custkey")))
    return o.alias("l").join(new.alias("r"), "o_orderkey").where(relational.changed(["o_orderstatus", "o_custkey"])).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_rows(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.removed_rows(table(spark, d, "orders"), gone, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id AS id, (length(text) % 97)::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 0 END AS v FROM documents")
def reuse_vectors(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_hash"), F.lit("c1").alias("config_hash"), "text")
    made = lambda t: F.array((F.length(t) % 97).cast("double"))
    known = rows.withColumn("embedding", F.transform(made(F.col("text")), lambda x: x + 1000)).withColumn("text_hash", F.when(F.col("id") % 3 == 0, F.col("text_hash")).otherwise("old"))
    return incremental.reuse_vectors(rows, known, made).select("id", F.get("embedding", F.lit(0)).alias("v"))


@query("SELECT c_custkey, lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g'))) AS folded FROM customer")
def alias_folding(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.fold_alias(F.concat_ws("  ", "c_name", "c_mktsegment")).alias("folded"))


@query("SELECT p_partkey, unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3))) AS gram FROM part")
def char_ngram_features(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(ml.char_ngrams(F.col("p_name"), 3)).alias("gram"))


@query("SELECT p_partkey, unnest(flatten(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))) AS gram FROM part")
def char_wb_ngram_features(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(ml.char_ngrams(F.col("p_name"), 3, True)).alias("gram"))


@query(
    """WITH e AS (SELECT vec_id, label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT cluster, i, avg(x) AS c FROM e GROUP BY ALL),
r AS (SELECT vec_id, cluster, round(sqrt(sum((x - c) ** 2)), 9) AS distance FROM e JOIN m USING (cluster, i) GROUP BY ALL)
SELECT cluster, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) - 1 AS rank FROM r) WHERE rank < 3"""
)
def cluster_representatives(spark, d):
    v = table(spark, d, "embeddings")
    return ml.representatives(ml.distances(v, ml.centroids(v)).withColumn("distance", F.round("distance", 9)), 3)


_APART_SQL = "e AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.id, a.cluster, b.id AS other, b.cluster AS oc, list_distance(a.v, b.v) AS d FROM e a, e b)"


@query(
    f"""WITH {_APART_SQL}, n AS (SELECT cluster, count(*) AS n FROM e GROUP BY cluster), m AS (SELECT id, cluster, oc, sum(d * d) AS s, count(*) AS c FROM d GROUP BY ALL),
a AS (SELECT id, cluster, max(s) FILTER (cluster = oc) / nullif(max(c) FILTER (cluster = oc) - 1, 0) AS a, min(s / c) FILTER (cluster <> oc) AS b FROM m GROUP BY id, cluster)
SELECT cluster, count(*) AS size, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM a GROUP BY cluster"""
)
def cluster_silhouette(spark, d):
    return ml.silhouette(table(spark, d, "embeddings"))


@query(
    f"""WITH RECURSIVE {_APART_SQL}, near AS (SELECT id, other FROM d WHERE d <= 1.0), core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 4),
l AS (SELECT id AS a, other AS b FROM near WHERE id IN (FROM core) AND other IN (FROM core)), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a)
SELECT vec_id, coalesce((SELECT cluster FROM g WHERE g.id = vec_id), (SELECT min(g.cluster) FROM near JOIN g ON g.id = near.id WHERE near.other = vec_id)) AS cluster FROM embeddings"""
)
def dbscan_clusters(spark, d):
    return ml.dbscan(table(spark, d, "embeddings"), 1.0, 4)


@query(ORACLE["retrieval_metrics"].replace("WITH ", "WITH mm AS (WITH ", 1) + "), u AS (UNPIVOT (SELECT * EXCLUDE (query_id) FROM mm) ON COLUMNS(*) INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS value, count(value) AS queries FROM u GROUP BY metric")
def retrieval_means(spark, d):
    return retrieval.mean_metrics(QUERIES["retrieval_metrics"](spark, d))


@query(f"WITH {_BM25_SQL} SELECT query_id, doc_id AS id, rank, round(1.0::DOUBLE / rank, 9) AS score FROM b")
def search_rank_scores(spark, d):
    return retrieval.score_by_rank(_bm25(spark, d).select("query_id", F.col("doc_id").alias("id"), "rank"))


@query(
    f"""WITH {_BM25_SQL}, g AS (SELECT item_id AS query_id, doc_id AS id, 'required' AS rule FROM benchmark JOIN documents ON doc_id % 50 = item_id % 50 UNION ALL SELECT query_id, doc_id, 'excluded' FROM b WHERE doc_id % 2 = 0),
t AS (SELECT query_id, doc_id AS id FROM b WHERE rank <= 5) SELECT g.* FROM g LEFT JOIN t ON t.query_id = g.query_id AND t.id = g.id WHERE (rule = 'required') = (t.id IS NULL)"""
)
def golden_set_failures(spark, d):
    b = _bm25(spark, d).select("query_id", F.col("doc_id").alias("id"), "rank")
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    required = items.join(docs, F.col("doc_id") % 50 == F.col("item_id") % 50).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), F.lit("required").alias("rule"))
    return retrieval.golden_failures(b, required.unionByName(b.where("id % 2 = 0").select("query_id", "id", F.lit("excluded").alias("rule"))), 5)


@query("WITH x AS (SELECT o_custkey % 7 AS query_id, o_orderkey % 400 AS id, max(o_totalprice) AS score FROM orders GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x")
def dedupe_hits(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("query_id"), (F.col("o_orderkey") % 400).alias("id"), F.col("o_totalprice").alias("score"))
    return retrieval.best_hits(o)


@query("SELECT doc_id, CASE WHEN lang IS NULL AND source IS NULL THEN '' ELSE concat_ws(chr(10), 'lang: ' || lang, 'source: ' || CASE WHEN doc_id % 3 > 0 THEN source END) || chr(10) || '---' || chr(10) END AS block FROM documents")
def chunk_metadata(spark, d):
    docs = table(spark, d, "documents").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    return docs.select("doc_id", tx.metadata_block(["lang", "source"]).alias("block"))


_check("min_metric", lambda t: _Q.min_metric(t("events").select(F.col("event_type").alias("label"), F.lit("value").alias("metric"), "value", F.struct("ts", "event_id").alias("evaluated_at")), "value", 50.0, "view"), "SELECT (v < 50)::INT AS failures, v AS measure FROM (SELECT max_by(value, (ts, event_id)) AS v FROM events WHERE event_type = 'view')")
_check("cardinality_ratio", lambda t: _Q.cardinality(t("documents").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), "lang", None, 0.001, True).withColumn("test", F.lit("cardinality_ratio")), _measured("count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN lang END) / count(*)", "documents", "v > 0.001"))
_check("zscore", lambda t: _Q.outlier_rate(t("documents"), "n_chars", 0.01, "zscore").withColumn("test", F.lit("zscore")), "WITH q AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents) SELECT (avg(o) > 0.01)::INT AS failures, avg(o) AS measure FROM (SELECT (n_chars < m - 3 * s OR n_chars > m + 3 * s)::INT AS o FROM documents, q)")


@query("WITH b AS (SELECT p_brand AS v, count(*) AS nb FROM part WHERE p_size < 25 AND p_brand <> 'Brand#11' GROUP BY ALL), c AS (SELECT p_brand AS v, count(*) AS nc FROM part WHERE p_size >= 25 GROUP BY ALL), j AS (SELECT coalesce(nb, 0) / sum(nb) OVER () AS p, coalesce(nc, 0) / sum(nc) OVER () AS q FROM b FULL JOIN c USING (v)), x AS (SELECT sum((q - p) * ln((q + 1e-6) / (p + 1e-6))) AS v FROM j) SELECT 'drift_psi' AS test, (v > 0.2)::BIGINT AS failures, round(v, 6) AS measure FROM x")
def drift_categories(spark, d):
    p = table(spark, d, "part")
    return _Q.drift(p.where("p_size < 25 AND p_brand <> 'Brand#11'"), p.where("p_size >= 25"), "p_brand", "psi", 0.2, numeric=False)


@query("SELECT test, failures, measure, CASE WHEN failures = 0 THEN 'pass' ELSE 'warn' END AS status FROM (SELECT 'not_null' AS test, 0::BIGINT AS failures, 0.0::DOUBLE AS measure UNION ALL SELECT 'accepted_range', count(*), count(*)::DOUBLE FROM orders WHERE o_totalprice < 1000)")
def quality_report(spark, d):
    o = table(spark, d, "orders")
    return _Q.with_severity(_Q.report([_Q.not_null(o, ["o_orderkey"]), _Q.accepted_range(o, "o_totalprice", 1000)]), "warn")


@query(
    f"""WITH {_TOKENS_SQL}, p AS (SELECT document_id, CASE WHEN is_stop THEN 'STOP' WHEN is_alpha THEN 'WORD' ELSE 'OTHER' END AS pos FROM t),
f AS (SELECT document_id, count(*) AS n, count(*) FILTER (pos = 'STOP') AS s, count(*) FILTER (pos = 'WORD') AS w FROM p GROUP BY document_id)
SELECT doc_id AS document_id, coalesce(n, 0) AS token_count, coalesce(s, 0) AS pos_stop_count, coalesce(w, 0) AS pos_word_count, CASE WHEN n > 0 THEN round(s / n, 9) END AS pos_stop_ratio, CASE WHEN n > 0 THEN round(w / n, 9) END AS pos_word_ratio FROM documents LEFT JOIN f ON document_id = doc_id"""
)
def pos_features(spark, d):
    t = _sentences(spark, d).withColumn("pos", F.when(F.col("is_stop"), "STOP").when(F.col("is_alpha"), "WORD").otherwise("OTHER"))
    return features.pos_features(t, table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), ["STOP", "WORD"])


@query(f"WITH x AS ({ORACLE['nlp_entities']}), f AS (SELECT document_id, count(*) AS n, count(*) FILTER (label = 'number') AS a, count(*) FILTER (label = 'host') AS b FROM x GROUP BY document_id) SELECT doc_id AS document_id, coalesce(n, 0) AS entity_count, coalesce(a, 0) AS entity_number_count, coalesce(b, 0) AS entity_host_count FROM documents LEFT JOIN f ON document_id = doc_id")
def entity_features(spark, d):
    return features.entity_features(nlp_entities(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), ["number", "host"])


@query(
    """WITH l AS (SELECT l_orderkey AS document_id, l_returnflag AS ns, CASE WHEN l_quantity >= 5 THEN l_partkey % 3 END AS id, CASE WHEN l_quantity < 5 THEN 'unmatched' WHEN l_linenumber > 4 THEN 'ambiguous' ELSE 'matched' END AS status FROM lineitem),
f AS (SELECT document_id, count(DISTINCT id) FILTER (ns = 'A') AS a, count(DISTINCT id) FILTER (ns = 'N') AS n, count(*) FILTER (status = 'matched') AS m, count(*) FILTER (status = 'unmatched') AS u FROM l GROUP BY document_id)
SELECT o_orderkey AS document_id, coalesce(a, 0) AS link_a_count, coalesce(n, 0) AS link_n_count, coalesce(m, 0) AS link_matched_count, coalesce(u, 0) AS link_unmatched_count FROM orders LEFT JOIN f ON document_id = o_orderkey"""
)
def link_features(spark, d):
    status = F.when(F.col("l_quantity") < 5, "unmatched").when(F.col("l_linenumber") > 4, "ambiguous").otherwise("matched")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("entity_namespace"), F.when(F.col("l_quantity") >= 5, F.col("l_partkey") % 3).alias("canonical_id"), status.alias("status"))
    return features.link_features(li, table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id")), ["A", "N"], ["matched", "unmatched"])


@query("SELECT l_orderkey AS document_id FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1")
def identity_conflicts(spark, d):
    return features.single_identity(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "document_id"), ["l_returnflag", "l_linestatus"])[1]


@query("WITH i AS (SELECT l_orderkey, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1) SELECT l_orderkey AS document_id FROM i JOIN orders ON o_orderkey = l_orderkey WHERE f <> CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END")
def identity_reconciliation(spark, d):
    left = features.single_identity(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "document_id").select("document_id", "l_returnflag"), ["l_returnflag"])[0]
    right = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("l_returnflag"))
    return features.identity_mismatches(left, right, ["l_returnflag"])


@query(f"WITH {_STATE_SQL} SELECT count(*) FILTER (record_key NOT IN (SELECT record_key FROM st)) AS inserted, count(*) FILTER (record_key IN (SELECT record_key FROM st)) AS updated FROM cur")
def incremental_counts(spark, d):
    cur, st = _state(spark, d)
    return incremental.merge_counts(st, cur, ["record_key"])


@query("SELECT o_orderkey AS id, o_orderstatus AS status, NULL::DOUBLE AS total FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def append_log_widened(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return incremental.append_log(old, o.where("o_orderkey % 2 = 1").select(F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("id")))


@query(
    f"""WITH {_STATE_SQL}, u AS (SELECT record_key FROM cur JOIN st USING (record_key) WHERE cur.input_fingerprint = st.input_fingerprint)
SELECT record_key AS parent, record_key || '/' || i AS child, CASE WHEN record_key IN (FROM u) THEN 'kept' ELSE 'made' END AS origin FROM cur, (VALUES (0), (1)) x(i)"""
)
def transform_children(spark, d):
    cur, st = _state(spark, d)
    made = lambda p, origin: p.select(F.col("record_key").alias("parent"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("parent", F.concat_ws("/", "parent", F.col("i").cast("string")).alias("child"), F.lit(origin).alias("origin"))
    return incremental.transform_children(cur, st, made(st, "kept"), lambda p: made(p, "made"), "parent")[0]


@query(
    """WITH m AS (SELECT vec_id AS entity_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 3 <> 0), r AS (SELECT 'L' || label AS entity_namespace, vec_id AS canonical_id, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 30 = 0),
s AS (SELECT entity_id, entity_namespace, canonical_id, round(list_cosine_similarity(a, b), 9) AS score FROM m, r WHERE list_cosine_similarity(a, b) >= 0.2), k AS (SELECT *, max(score) OVER (PARTITION BY entity_id, entity_namespace) AS top FROM s)
SELECT entity_id, entity_namespace, canonical_id, score, CASE WHEN count(*) OVER (PARTITION BY entity_id, entity_namespace) > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM k WHERE score >= top - 0.05::DOUBLE"""
)
def entity_links_vector(spark, d):
    e = table(spark, d, "embeddings")
    refs = e.where("vec_id % 30 = 0").select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("entity_namespace"), F.col("vec_id").alias("canonical_id"), "embedding")
    return nlp.vector_links(e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("entity_id"), "embedding"), refs, 0.2, 0.05)


@query()
def chunk_model(spark, d):
    docs = table(spark, d, "documents").withColumn("block", tx.metadata_block(["lang", "source"]))
    return providers.chunk_model(docs, 800, 80, metadata="block")


@query()
def embed_model(spark, d):
    return providers.embed_model(table(spark, d, "benchmark"), providers.Deterministic(), 16, id_col="item_id")


_ANSWER = {"type": "object", "properties": {"topic": {"type": "string", "enum": ["prose", "code", "junk"]}, "year": {"type": "integer"}, "score": {"type": "number"}, "public": {"type": "boolean"}, "note": {"type": "string"}}}


@query()
def llm_model(spark, d):
    return providers.llm_model(table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"), providers.Deterministic(), _ANSWER)


@query()
def llm_model_many(spark, d):
    return providers.llm_model(table(spark, d, "benchmark"), providers.Deterministic(), {"type": "object", "properties": {"items": {"type": "array", "items": _ANSWER}}}, id_col="item_id", many="items")


@query("SELECT event_id, (ts - INTERVAL 2 HOUR) AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 3 = 0) UNION ALL SELECT event_id, date_trunc('day', ts) FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2")
def iso_times(spark, d):
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("no time")
    return table(spark, d, "events").select("event_id", tm.iso_utc(text).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::BIGINT / 3.6e9::DOUBLE, 2) AS hours, date_trunc('hour', ts) AS hour, CASE WHEN user_id >= 10 AND user_id < 80 THEN user_id - (user_id - 10) % 20 END AS bucket FROM events")
def time_partitions(spark, d):
    return table(spark, d, "events").select("event_id", tm.hours_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts")).alias("hours"), tm.partition_of(F.col("ts"), "hour").cast("timestamp_ntz").alias("hour"), tm.range_bucket(F.col("user_id"), 10, 80, 20).alias("bucket"))


@query("WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 > 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 > 0) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only FROM a FULL JOIN b ON a.k = b.k")
def match_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return relational.match_counts(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 5 > 0"), ["o_orderkey"])


@query(f"WITH {_BM25_SQL} SELECT query_id, b.doc_id AS id, rank, lang, source FROM b LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 > 0) d ON d.doc_id = b.doc_id")
def hit_enrichment(spark, d):
    return relational.enriched(_bm25(spark, d).select("query_id", F.col("doc_id").alias("id"), "rank"), table(spark, d, "documents").where("doc_id % 4 > 0"), "doc_id", ["lang", "source"])


@query("SELECT lower(p_name) AS term, p_type AS category, count(DISTINCT p_size) AS weights FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1")
def lexicon_conflicts(spark, d):
    return nlp.lexicon_conflicts(table(spark, d, "part").select(F.upper("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_size").alias("weight")))


@query(f"WITH {_TOKENS_SQL}, f AS (SELECT document_id, count(*) AS n, count(*) FILTER (lemma IN ({', '.join(repr(a) for a, _, _ in _LEXICON)})) AS h FROM t GROUP BY document_id) SELECT doc_id AS document_id, coalesce(n, 0) AS token_count, coalesce(h, 0) AS hits, CASE WHEN n > 0 THEN round(h / n, 9) END AS coverage FROM documents LEFT JOIN f ON document_id = doc_id")
def tone_coverage(spark, d):
    lex = spark.createDataFrame(list(_LEXICON), "term string, category string, weight double")
    return nlp.tone_coverage(_sentences(spark, d), lex, table(spark, d, "documents").select(F.col("doc_id").alias("document_id")))


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm, round(u[2], 6) AS second FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3 + 1) AS v FROM embeddings))")
def l2_normalised(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", ml.l2_normalised(F.transform("embedding", lambda x: x.cast("double") * 3 + 1)).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.get("u", F.lit(1)), 6).alias("second"))


@query(f"WITH {_TERMS_SQL}, {_VOCAB_SQL.replace('LIMIT 1000', 'LIMIT 50')} SELECT row_id, list_transform(range(0, 50), lambda i: coalesce(element_at(map_from_entries(list((term_index, count::DOUBLE))), i)[1], 0.0::DOUBLE))::VARCHAR AS vector FROM c JOIN v USING (term) GROUP BY row_id")
def feature_matrix(spark, d):
    c = ml.terms(table(spark, d, "documents"))
    m = ml.pivoted(c, ml.vocabulary(c, 2, 1.0, 50))
    return m.select("row_id", F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("string")), ", "), F.lit("]")).alias("vector"))


@query(
    """WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS row_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id)
SELECT row_id, max(score) AS best FROM s GROUP BY row_id"""
)
def nearest_neighbours(spark, d):
    return ml.neighbours(table(spark, d, "embeddings"), 5).groupBy("row_id").agg(F.round(F.max("score"), 6).alias("best"))


@query(f"WITH p AS ({ORACLE['naive_bayes_predict']}) SELECT row_id, label, probability, label = quality::VARCHAR AS correct FROM p LEFT JOIN labels ON doc_id = row_id")
def naive_bayes_scored(spark, d):
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("label"))
    return ml.scored_predictions(naive_bayes_predict(spark, d), truth)
