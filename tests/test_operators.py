"""Edge cases of single operators, with expectations worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions import time as tm
from docspark.operators import dedup, features, incremental, ml, nlp, providers, quality, relational, retrieval
from docspark.plans import sql_models
from docspark.plans.sql_models import ModelGraph, build, compile_sql, refs, single_select
from docspark.plans.versioned import VersionedTable
from docspark.sources import files
from docspark.streaming import events


def test_text_stats_of_blank_text(spark):
    d = spark.createDataFrame([("",), ("   ",), ("One. Two!\n\nThree",)], "t string")
    got = d.select(*(c.alias(k) for k, c in tx.text_stats(F.col("t")).items())).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0), (3, 0, 0, 0), (16, 3, 3, 2)]


def test_split_recursive():
    text = "alpha beta. " * 50 + "\n\n" + "gamma delta " * 50
    parts = tx.split_recursive(text, 100)
    cut = lambda t, *a: [t[x:y] for x, y in tx.split_recursive(t, *a)]
    assert " ".join(cut(text, 100)).split() == text.split() and all(b - a <= 100 for a, b in parts)
    assert all(a == a.strip() for a in cut(text, 100))
    assert cut("aaaa bbbb cccc", 10) == ["aaaa bbbb", "cccc"] and cut("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and cut("  \n ", 3) == []
    # An overlap above the chunk carries all of it.
    assert cut("one two\n\nthree four five six", 24, 12) == ["one two", "one two\n\nthree four five six"]
    # The overlap snaps to the word end nearest to it, between half and twice of it.
    assert cut("aaa bbb ccc ddd eee fff", 16, 6) == ["aaa bbb ccc ddd", "ccc ddd eee fff"]
    assert cut("x" * 30, 20, 4) == ["x" * 20, "x" * 14]


def test_metadata_block(spark):
    d = spark.createDataFrame([("a", 1), (None, 2), (None, None)], "t string, n int")
    assert [r[0] for r in d.select(tx.metadata_block(["t", "n"])).collect()] == ["t: a\nn: 1\n---\n", "n: 2\n---\n", ""]


def test_clean_encoding(spark):
    d = spark.createDataFrame([("cafÃ©",), ("plain\x00",), (None,), ("déjà",)], "t string")
    assert [r[0] for r in d.select(tx.clean_encoding("t")).collect()] == ["café", "plain", None, "déjà"]


def test_keyphrases_do_not_cross_stop_words(spark):
    toks = nlp.token_table(spark.createDataFrame([(1, "the growth is strong")], "doc_id long, text string"))
    assert {r.phrase for r in nlp.keyphrases(toks, 5, 2).collect()} == {"growth", "strong"}
    three = nlp.keyphrases(nlp.token_table(spark.createDataFrame([(1, "rate of return")], "doc_id long, text string")), 5, 3)
    assert {r.phrase for r in three.collect()} == {"rate", "return", "rate of return"}


def test_tone_negation_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, "not weak"), (2, "weak"), (4, "")], "doc_id long, text string")
    lex = spark.createDataFrame([("weak", "negative", 1.0)], "term string, category string, weight double")
    got = {r.document_id: r for r in nlp.document_tone(nlp.token_table(docs), lex, docs.select(F.col("doc_id").alias("document_id"))).collect()}
    assert got[1].negative_score == -0.5 and got[2].negative_score == 1.0
    assert got[4].token_count == 0 and got[4].status == "insufficient_text" and got[4].negative_score is None


def test_alias_linking(spark):
    m = spark.createDataFrame([("a", "Mercury"), ("b", "THE  fed"), ("c", "Acme Widgets"), ("d", "Apple Inc.")], "entity_id string, entity_text string")
    a = spark.createDataFrame([("Mercury", "ticker", "MCY"), ("Mercury", "ticker", "MERC"), ("The Fed", "org", "FED"), ("Apple Inc.", "cik", "320193"), ("Apple Inc.", "ticker", "AAPL")], "alias string, entity_namespace string, canonical_id string")
    got = sorted((r.entity_id, r.canonical_id or "", r.status, r.method or "") for r in nlp.link_aliases(m, a, tx.fold_alias).collect())
    assert got == [("a", "MCY", "ambiguous", "exact"), ("a", "MERC", "ambiguous", "exact"), ("b", "FED", "matched", "normalized"), ("c", "", "unmatched", ""), ("d", "320193", "matched", "exact"), ("d", "AAPL", "matched", "exact")]


def test_sentence_pairs_and_rules(spark):
    m = spark.createDataFrame([(1, 0, i, i + 1, f"e{i}", "x") for i in range(3)], "document_id long, sentence_index long, start long, end long, entity_id string, label string")
    pairs = nlp.cooccurrences(m)
    assert pairs.count() == 3
    rules = spark.createDataFrame([("x", "x", "near")], "source_label string, target_label string, relation string")
    assert nlp.rule_relations(pairs, rules).count() == 6


def test_drift_extremes(spark):
    a, b = spark.range(100).selectExpr("double(id) v"), spark.range(100).selectExpr("double(id + 1000) v")
    assert quality.drift(a, b, "v", "ks", 0.5).first().measure == 1.0
    assert quality.drift(a, a, "v", "psi", 0.1).first().measure == 0.0
    c, d = spark.createDataFrame([("x",)] * 10, "v string"), spark.createDataFrame([("x",)] * 5 + [("y",)] * 5, "v string")
    assert quality.drift(c, d, "v", "chi2", 5.0, numeric=False).first().measure > 1e12  # a new category
    assert quality.drift(c, d, "v", "psi", 5.0, numeric=False).first().measure == round(-0.5 * math.log(0.500001 / 1.000001) + 0.5 * math.log(0.500001 / 1e-6), 6)
    flat = spark.range(10).selectExpr("1.0D v")
    assert quality.drift(flat, b, "v", "js", 0.1).first().measure == 1.0


def test_checks_by_hand(spark):
    vec = spark.createDataFrame([([3.0, 4.0],), (None,), ([5.0, 12.0],), ([0.0, 0.0],), ([1.0],), ([1.0, float("nan")],)], "v array<double>")
    assert quality.embedding_valid(vec.limit(2), "v").first().failures == 0
    assert quality.embedding_valid(vec, "v", 2, 1.0, 10.0).first().failures == 4
    assert quality.embedding_valid(vec, "v", 2, most_zero=0.5).first().failures == 2 and quality.embedding_valid(vec, "v", 2).first().failures == 3
    some = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert quality.cardinality(some, "v", ratio=True).first().measure == 0.5
    said = spark.createDataFrame([("  Due ", "amount due"), ("", "x"), (" ", "x"), ("no", "yes"), (None, "x")], "v string, s string")
    assert quality.grounded_in(said, "v", "s").first().failures == 1


def test_tfidf_and_coherence_by_hand(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "z", 7), (2, "a", 1)], "row_id long, term string, count long")
    vocab = spark.createDataFrame([("a", 2, 0), ("b", 1, 1)], "term string, df long, term_index long")
    got = {(r.row_id, r.term): (r.tf, r.idf) for r in ml.tfidf(counts, vocab, 2).collect()}
    assert got == {(1, "a"): (round(2 / 3, 9), 1.0), (1, "b"): (round(1 / 3, 9), round(math.log(1.5) + 1, 9)), (2, "a"): (1.0, 1.0)}
    top = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "cluster int, rank int, term string")
    assert ml.coherence(top, counts).first().umass == round(math.log(2 / 3), 6)


def test_hits_and_limits(spark):
    assert [retrieval.candidate_limit(n) for n in (1, 20, 1000)] == [50, 80, 1000]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, v array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "row_id long, v array<double>")
    assert [(r.query_id, r.row_id) for r in retrieval.vector_topk(q, rows, 1).collect()] == [(1, 1)]
    assert retrieval.vector_topk(q, rows, 5, exclude_self=True).count() == 1


def test_outlier_rate_needs_four_values(spark):
    assert quality.outlier_rate(spark.createDataFrame([(1.0,), (2.0,), (900.0,)], "v double"), "v", 0.0).first().failures == 0


def test_fuzzy_grounding(spark):
    d = spark.createDataFrame([("total due", "The total du is 5"), ("absent", "nothing here"), (None, "x")], "v string, s string")
    assert [r[0] for r in d.select(quality.fuzzy_grounded()("v", "s")).collect()] == [True, False, None]


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, base), (2, base + " tail"), (3, "something else entirely here now"), (4, ""), (5, base)], "doc_id long, text string")
    assert {r.doc_id: r.duplicate_group for r in dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: 1}
    assert {r.doc_id: r.duplicate_group for r in dedup.exact_groups(docs).collect()} == {1: 1, 2: None, 3: None, 4: None, 5: 1}


def test_near_duplicates_against_brute_force(spark):
    """Chains of links, and a bucket's least id unlike the others that share the bucket."""
    words = [f"w{i}" for i in range(300)]
    texts = {20 + i: " ".join(words[8 * i : 8 * i + 150]) for i in range(12)}
    shared = " ".join(f"s{i}" for i in range(70))
    texts |= {1: shared + " " + " ".join(f"a{i}" for i in range(40))}
    texts |= {2 + j: shared + " " + " ".join(f"b{i}" for i in range(40)) + f" end{j}" for j in range(4)}
    texts |= {10: "Too  SHORT", 11: "too short", 12: "", 13: None}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    group = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            group[a] = min([group[b] for b in texts if like(a, b) >= 0.8] + [group[a]])
    want = {i: g if list(group.values()).count(g) > 1 else None for i, g in group.items()}
    assert want[31] == 20 and want[5] == 2 and want[1] is None and want[11] == 10
    for kind in ("long", "string"):
        docs = spark.createDataFrame(list(texts.items()) * 2 + [(None, texts[2])], "doc_id long, text string").withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 2, "0") if kind == "string" else F.col("doc_id"))
        number = lambda x: None if x is None else int(x)
        got = [(number(r.doc_id), number(r.duplicate_group)) for r in dedup.near_duplicates(docs).collect()]
        assert sorted(got, key=str) == sorted([*want.items()] * 2 + [(None, None)], key=str)


def test_retrieval_metrics_of_empty_and_unlabelled(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (3, 9, 1)], "query_id long, id long, rank long")
    gold = spark.createDataFrame([(1, 8), (2, 5)], "query_id long, id long")
    got = {r.query_id: r for r in retrieval.retrieval_metrics(hits, gold, 10).collect()}
    assert (got[1].precision, got[1].recall, got[1].mrr) == (0.5, 1.0, 0.5)
    assert got[2].precision == 0.0 and got[3].precision is None


def test_vector_search_is_exact(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "row_id long, v array<double>")
    q = spark.createDataFrame([(100, [5.0, 1.0])], "query_id long, v array<double>")
    assert [r.row_id for r in retrieval.vector_topk(q, rows, 3, "l2").orderBy("rank").collect()] == [5, 4, 6]


def test_hashing_is_signed(spark):
    c = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "row_id long, term string, count long")
    assert sum(abs(r.value) for r in ml.hashed(c, 1 << 20).collect()) == 3


def test_predicates_reject_bad_values():
    with pytest.raises(ValueError):
        relational.predicate([("a", "in", [1, "x"])])
    with pytest.raises(ValueError):
        relational.predicate([("a", "lt", float("nan"))])


def test_governed_search_fails_closed(spark):
    rows = spark.range(5)
    assert retrieval.filtered(rows, [], None).count() == 0
    assert retrieval.filtered(rows, [("id", "ge", 3)], [("id", "lt", 5)]).count() == 2


def test_schema_plan():
    have = [("a", "int")]
    assert incremental.plan_schema(have, [("a", "int"), ("b", "string")], "append_new_columns") == ["b"]
    with pytest.raises(ValueError):
        incremental.plan_schema(have, [("a", "int"), ("b", "string")], "fail")
    with pytest.raises(ValueError):
        incremental.plan_schema(have, [("a", "string")], "ignore")


def test_sql_models_and_graph():
    sql = "SELECT * FROM {{ ref('a') }} {% if is_incremental() %}WHERE x > 1{% endif %}; -- end"
    assert refs(sql) == ["a"] and compile_sql(single_select(sql), {"a": "t"}).strip() == "SELECT * FROM t"
    with pytest.raises(ValueError):
        single_select("DELETE FROM a")
    g = ModelGraph({"b": {"a"}, "c": {"b"}, "d": {"a"}}, {"d": {"x"}})
    assert g.select(["b+"]) == ["b", "c"] and g.select(["+c"], ["tag:x"]) == ["a", "b", "c"]
    assert build(g, lambda n: n != "b") == {"a": "success", "b": "error", "d": "success", "c": "skipped"}


def test_versioned_table_swaps(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(3))
    t.replace(incremental.upsert(t.read(), spark.range(2, 5), ["id"]))
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2, 3, 4]


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.md").write_text("---\ntitle: T\ntags: [x]\n---\nBody text\n")
    (tmp_path / "in" / "m.eml").write_bytes(b"Subject: S\r\nFrom: a@b.c\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\n\r\nHi there\r\n")
    d = files.scan_folder(spark, str(tmp_path / "in"), "src", "*.md").select("source_path", "document_id", files.markdown(F.col("content").cast("string")).alias("m")).first()
    assert d.source_path == "sub/a.md" and d.m.front["title"] == "T" and d.m.word_count == 2 and d.document_id == files.document_id("src", "sub/a.md")
    m = files.scan_folder(spark, str(tmp_path / "in"), "src", "*.eml").select(files.mail("content").alias("m")).first().m
    assert m.subject == "S" and m.date.startswith("2024-01-01T10:00") and m.body.strip() == "Hi there"
    page = spark.createDataFrame([("<title>T</title><script>x</script><h1>Head</h1><p>One</p><table><tr><td>a</td><td>b</td></tr></table>",), (None,)], "h string").select(files.html_document("h").alias("d")).collect()
    assert page[0].d.text == "Head\nOne\na b" and page[0].d.tables == [[["a", "b"]]] and page[0].d.sections[0].heading == "Head" and page[1].d.text == ""


def test_stream_matches_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    seen = []
    q = events.watch(spark, str(tmp_path / "in"), src.schema, lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == src.count()


def test_deterministic_provider():
    p = providers.Deterministic("m")
    digest = lambda place, n: hashlib.blake2b(f"m\0text\0{place}".encode(), digest_size=n).digest()
    number = lambda place: int.from_bytes(digest(place, 8), "big")
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"enum": ["x", "y", "z"]}, "c": {"type": "array", "items": {"type": "boolean"}}, "d": {}, "e": {"type": "number"}}}
    got = p.complete("text", schema)
    assert got["a"] == number(".a") % 1000 and got["b"] == "xyz"[number(".b") % 3] and got["c"] == [bool(number(f".c[{i}]") & 1) for i in (0, 1)]
    assert got["d"] == "det-" + digest(".d", 8).hex()[:8] and got["e"] == round(number(".e") % 100000 / 100, 2)
    (v,) = p.embed(["text"], 40)
    raw = [b / 127.5 - 1 for b in (digest("0", 32) + digest("1", 32))[:40]]
    assert math.isclose(sum(x * x for x in v), 1) and math.isclose(v[33] / v[0], raw[33] / raw[0])


def test_chunk_and_embed_models(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "b: 1\n---\n"), (2, "", ""), (3, None, None)], "doc_id long, text string, block string")
    chunks = providers.chunk_model(docs, 22, 0, metadata="block").orderBy("chunk_index").collect()
    assert [(c.document_id, c.chunk_index, c.start, c.text) for c in chunks] == [("1", 0, 0, "b: 1\n---\none two"), ("1", 1, 8, "b: 1\n---\nthree four"), ("1", 2, 19, "b: 1\n---\nfive six")]
    assert chunks[1].chunk_id == hashlib.blake2b(f"1|1|{chunks[1].text}".encode(), digest_size=16).hexdigest()
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "chunk_id string, text string")
    first = providers.embed_model(rows, providers.Deterministic(), 4)
    marked = first.withColumn("embedding", F.when(F.col("id") == "a", F.array(F.lit(9.0))).otherwise(F.col("embedding"))).where("id = 'a'")
    again = {r.id: r.embedding for r in providers.embed_model(rows, providers.Deterministic(), 4, marked).collect()}
    assert again["a"] == [9.0] and set(again) == {"a", "b"}
    other = {r.id: r.embedding for r in providers.embed_model(rows, providers.Deterministic("m2"), 4, marked).collect()}
    assert other["a"] != [9.0]
    assert providers.one_space(first, marked) == first.first().config_hash
    with pytest.raises(ValueError):
        providers.one_space(first, providers.embed_model(rows, providers.Deterministic("m2"), 4))


def test_llm_model_and_budget(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "gamma")], "doc_id long, text string")
    item = {"type": "object", "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}
    one = {r.row_id: r for r in providers.llm_model(rows, providers.Deterministic(), item, prompt="p ").collect()}
    want = providers.Deterministic().complete("p alpha beta", item)
    assert set(one) == {"1", "3"} and (one["1"].n, one["1"].tags) == (want["n"], want["tags"])
    many = providers.llm_model(rows, providers.Deterministic(), {"type": "object", "properties": {"items": {"type": "array", "items": item}}}, many="items").collect()
    assert sorted(r.row_id for r in many) == ["1__0", "1__1", "3__0", "3__1"]
    assert providers.check_budget(rows, documents=2, size=15, tokens=3) == {"documents": 2, "bytes": 15, "tokens": 3}
    with pytest.raises(ValueError):
        providers.check_budget(rows, tokens=2)


def test_refusals(spark):
    links = spark.createDataFrame([("m1", "matched"), ("m2", "ambiguous")], "entity_id string, status string")
    assert nlp.refuse_ambiguous(links.limit(1)).count() == 1
    with pytest.raises(ValueError, match="m2"):
        nlp.refuse_ambiguous(links)
    pairs = spark.createDataFrame([(1,), (1,), (2,)], "document_id long")
    assert nlp.capped_pairs(pairs, 2).count() == 3
    with pytest.raises(ValueError, match="document 1"):
        nlp.capped_pairs(pairs, 1)
    with pytest.raises(ValueError):
        incremental.append_log(pairs, links.select(F.col("entity_id").alias("document_id")))
    with pytest.raises(ValueError, match="'2'"):
        features.require_none(pairs.where("document_id = 2"), "disagree")
    a = spark.createDataFrame([("x", 1), ("y", None), ("x", 1)], "alias string, id int")
    same = nlp.reference_fingerprint(a.orderBy("alias", ascending=False).limit(2), ["alias", "id"]).first()
    assert nlp.reference_fingerprint(a, ["alias", "id"]).first() == same and same.rows == 2


def test_model_templates_and_manifests(spark):
    made = sql_models.expand("m_{{ a }}_{{ b }}", "SELECT '{{ a }}' AS x, {{ b }} AS y FROM {{ ref('t') }}", {"a": ["p", "q"], "b": ["1", "2"]})
    assert list(made) == ["m_p_1", "m_p_2", "m_q_1", "m_q_2"] and made["m_q_1"] == "SELECT 'q' AS x, 1 AS y FROM {{ ref('t') }}"
    with pytest.raises(ValueError):
        sql_models.expand("same", "SELECT {{ a }}", {"a": ["1", "2"]})
    assert sql_models.dry_run(spark, made["m_p_2"], {"t": spark.range(1)}) == [("x", "string"), ("y", "int")]
    before = sql_models.manifest({"a": "SELECT 1", "b": "SELECT * FROM {{ ref('a') }}", "c": "SELECT 2"}, {"b": ["nightly"]})
    after = sql_models.manifest({"a": "SELECT  1", "b": "SELECT * FROM {{ ref('a') }} LIMIT 1", "d": "SELECT 3"})
    assert before["b"]["refs"] == ["a"] and before["b"]["tags"] == ["nightly"]
    assert sql_models.modified(before, after) == {"new": ["d"], "changed": ["b"], "removed": ["c"]}
    assert sql_models.code_version(sql_models.expand) != sql_models.code_version(sql_models.manifest)


def test_spans_and_nested_values(spark):
    assert [tm.seconds_of(x) for x in ("90 minutes", "1 week", "2days")] == [5400, 604_800, 172_800]
    for bad in ("0 days", "a day", "3 moons"):
        with pytest.raises(ValueError):
            tm.seconds_of(bad)
    d = spark.createDataFrame([(1, [1, 2], {"a": 1})], "id long, xs array<int>, m map<string,int>")
    assert tuple(relational.scalar_text(d).first()) == (1, "[1,2]", '{"a":1}')
    twice = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated keys"):
        relational.match_counts(twice, twice, ["k"]).collect()


@pytest.mark.parametrize("threshold", [0.2, 0.0, -0.5])
def test_vector_links_equal_the_cosine_of_every_pair(spark, monkeypatch, threshold):
    odd = [[], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 1.0], [1e-200, 0.0, 1e-200], [1.0, 2.0], [0.5, 0.5, 0.5], None]
    usual = [[math.sin(i * 7.1), math.cos(i * 3.3), math.sin(i + 0.5)] for i in range(60)]
    m = spark.createDataFrame([(2**53 + i, v) for i, v in enumerate(odd + usual)] + [(None, usual[0]), (2**53 + 20, usual[3])], "entity_id long, embedding array<double>")
    a = spark.createDataFrame([((None, "x", "y", "z")[i % 4], 2**53 + i, v) for i, v in enumerate(usual[::2] + odd + usual[::3])], "entity_namespace string, canonical_id long, embedding array<double>")
    monkeypatch.setattr(nlp, "REFERENCE_VALUES", 80)
    monkeypatch.setattr(nlp, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(nlp, "OPEN_AT_ONCE", 7)
    for mentions in (m, m.where("entity_id between pow(2, 53) + 9 and pow(2, 53) + 30")):
        score = retrieval.cosine(F.col("embedding"), F.col("v"))
        pairs = mentions.where("embedding is not null").crossJoin(a.where("embedding is not null").withColumnRenamed("embedding", "v")).withColumn("score", score).where(F.col("score") >= threshold)
        pairs = pairs.groupBy("entity_id", "entity_namespace", "canonical_id").agg(F.round(F.max("score"), 9).alias("score"))
        want = nlp.resolve_candidates(pairs, 0.05)
        got = nlp.vector_links(mentions, a, threshold, 0.05)
        assert got.dtypes == want.dtypes and "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    assert nlp.vector_links(m, a.limit(0), threshold).count() == 0 and nlp.vector_links(m.limit(0), a, threshold).count() == 0
