"""The training-data operators against brute force, and on nulls, empty and repeated rows and empty tables."""

import collections
import datetime
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import common, decontaminate, jaccard_join, language_id, mixing, pii, quality_rules, queries, secret_scan, substring_dedup, toxicity, warc
from docspark.operators import set_tiles
from docspark.plans.storage import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: An id that a float can't hold.
BIG = 2**53 + 1
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "no id here", "en", "a", 10), (3, "x" * 300_000 + " end", "en", "a", 5), (4, "same text twice", "en", "a", 15), (4, "same text twice", "en", "a", 15), (5, "\U0001f600 é \t\n", "fr", "b", 6)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with ones that operators make."""
    return spark.createDataFrame(ODD, DOCS).withColumn("words", F.lit(1)).withColumn("h", F.lit("h")).withColumn("size", F.lit(2)).withColumn("found", F.lit(3))


def components(texts, k, percent):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = WORDS.findall((t or "").translate(up))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up_ = {i: i for i in sets}

    def find(x):
        while up_[x] != x:
            x = up_[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up_[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_join_against_brute_force(documents, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(documents, k, percent).collect()}
    assert got == components([(r.doc_id, r.text) for r in documents.collect()], k, percent)


def test_jaccard_join_chains_and_odd_rows(spark, odd):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):  # copies with 0 to 5 edits: links form chains around the original
        w = list(base)
        for p in rng.choice(150, i % 6, replace=False):
            w[p] = f"x{i}_{p}"
        texts.append((i + 10, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == components(texts, 4, 85)
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(odd).collect())
    assert rows == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5)]
    assert jaccard_join.jaccard_join(odd.limit(0)).count() == 0


def test_jaccard_join_of_equal_sets_and_exact_ids(spark):
    rows = [(BIG, "one two three four five"), (None, "one two three four five"), (BIG + 2, "ONE two three four five"), (5, "one two three four six"), (6, "six four three"), (6, "other words of one id"), (4, "other words of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_join(docs, 4, 100).collect()}
    assert got == {(BIG, 2): BIG, (None, 2): None, (BIG + 2, 2): BIG, (5, 2): 5, (6, 1): 4, (6, 2): 4, (4, 2): 4}
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.jaccard_join(docs, 4, 0)


def test_divide_skip():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(25)]
        index = jaccard_join.Inverted(sets)
        open_ = rng.random(25) < 0.8
        count = {m: len(np.intersect1d(sets[0], sets[m])) for m in range(25) if open_[m]}
        for t in (1, 3, 6):
            for aside in (None, 0, 2, 11):
                assert index.divide_skip(index.ranks[0], t, open_, aside) == {m: c for m, c in count.items() if c >= t}


def test_tiles_join_what_links():
    """The search decides: the forest connects what brute force connects, and a search that misses members changes it."""
    rng = np.random.default_rng(5)
    base = [np.arange(i * 1000, i * 1000 + 100) for i in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(base[i % 4], 100 - i % 14, replace=False), rng.integers(10**6, 10**9, i % 14)])).astype(np.uint64) for i in range(80)]

    class Deaf(jaccard_join.Inverted):
        def divide_skip(self, *_):
            return {}

    def parts(links):
        up = list(range(80))
        for a, b in links:
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        return [up.index(u) for u in up]

    every = [(a, b) for a, b in itertools.combinations(range(80), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    for index in (jaccard_join.Inverted, set_tiles.Scan):
        links = set_tiles.forest(sets, list(range(80)), [False] * 80, 85, index)
        assert set(map(frozenset, links)) <= set(map(frozenset, every)) and parts(links) == parts(every) and len(links) < 80
    assert set_tiles.forest(sets, list(range(80)), [False] * 80, 85, Deaf) == []
    asked = set_tiles.forest(sets, list(range(80)), [i == 8 for i in range(80)], 85, jaccard_join.Inverted)
    assert {b for _, b in asked} == {b if a == 8 else a for a, b in every if 8 in (a, b)}


def test_open_members_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    for _ in range(20):
        label, n = rng.integers(0, 6, 40), rng.integers(50, 70, 40)
        bits = rng.integers(0, 2**8, (40, 8)) * (rng.random((40, 8)) < 0.2)
        apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=np.int64)
        ok = (label[:, None] != label) & (100 * np.minimum(n[:, None], n) >= 85 * np.maximum(n[:, None], n)) & (185 * apart <= 15 * (n[:, None] + n))
        m, own, other = jaccard_join.unresolved(label, n, bits, 85)
        assert set(m.tolist()) == set(np.flatnonzero(ok.any(1)).tolist()) and (own != other).all() and len(m) <= 46
        reach = lambda pairs: [min(x) for x in _closure(6, pairs)]
        assert reach(zip(own.tolist(), other.tolist(), strict=True)) == reach([(label[a], label[b]) for a, b in zip(*np.nonzero(ok), strict=True)])


def _closure(n, pairs):
    of = [{i} for i in range(n)]
    for a, b in pairs:
        both = of[a] | of[b]
        for x in both:
            of[x] = both
    return of


def test_language_id_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs, common.fold(F.col("doc_id"), 4) != 2)
    held = language_id.identify(docs, net).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where((common.fold(F.col("doc_id"), 4) == 2) & (F.col("n_chars") > 60))
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    got = language_id.identify(odd, net).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.lang_pred for r in got}[1] == "und"
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    big = spark.createDataFrame([(BIG, "la casa es de los que"), (None, "the house of them")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in language_id.identify(big, net).collect()} == {BIG, None}


def test_language_id_against_a_naive_convolution():
    rng = np.random.default_rng(8)
    net = language_id.ByteNet(["a", "b", "c"])
    texts = [bytes(rng.integers(97, 120, n).astype(np.uint8)) for n in (0, 1, 2, 5, 253, 254, 255, 256, 257, 700, 2000)]

    def naive(data):
        total = np.zeros(3)
        padded = data.ljust(-(-max(len(data), 1) // 256) * 256) + b"   "
        for at in range(0, len(padded) - 3, 256):
            pooled = [max(sum(t[k][padded[p + k]][f] for k in range(len(t))) for p in range(at, at + 256)) for t in net.tables for f in range(language_id.FILTERS)]
            z = np.maximum(pooled, 0) @ net.out + net.bias
            total += max(1, min(256, len(data) - at)) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return total / total.sum()

    batch = language_id.predict(net, net.pairs(), texts)
    for i, t in enumerate(texts):
        assert np.allclose(batch[i], naive(t), atol=1e-5) and np.allclose(batch[i], language_id.predict(net, net.pairs(), [t])[0], atol=1e-6)


def test_secret_scan(spark, odd):
    texts = ['a token = "abcdefgh12" b', "secret=token:abcdefgh", "x AKIA" + "A" * 12 + " y " + "0a" * 20, "PASSWD: short", "ghp_" + "z" * 36, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[0])], "doc_id long, text string")
    out, ledger = secret_scan.secret_scan(docs)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in [*enumerate(texts), (9, texts[0])]:
        spans = []
        for k, (name, p, g, least, _) in enumerate(secret_scan.RULES[:3]):
            spans += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, t or "") if len(m.group(g)) >= least]
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
    assert got[4].spans == "forge:0:40" and got[9].spans == got[0].spans
    again, fresh = secret_scan.secret_scan(docs.union(spark.createDataFrame([(7, "new")], docs.schema)), ledger)
    assert fresh.count() == 1 and again.count() == len(texts) + 2
    assert secret_scan.secret_scan(odd)[0].count() == len(ODD) and secret_scan.secret_scan(odd.limit(0))[0].count() == 0


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, common.fold(F.col("doc_id"), 3) != 1)
    weights = np.zeros((len(model.ids), len(model.term)))
    weights[model.index.ids, np.repeat(np.arange(len(model.term)), np.diff(model.index.cuts[:: model.index.blocks]))] = model.index.weights
    assert np.allclose((weights**2).sum(1), 1)
    for r in docs.limit(200).collect():
        terms, w = model.vector(toxicity.term_counts(r.text))
        q = np.zeros(len(model.term))
        q[terms] = w
        best = np.sort(weights @ q)[::-1][: toxicity.K]
        near = model.index.search(terms, w, toxicity.K)
        assert np.allclose([s for s, _ in near], best[best > 0])
        vote = (sum(model.labels[i] / (1.05 - min(s, 1)) for s, i in near) + model.prior) / (sum(1 / (1.05 - min(s, 1)) for s, _ in near) + 1)
        assert np.isclose(model.vote(near), vote)
    rows, raw = toxicity.score(docs, model).join(labels, "doc_id"), np.array(model.steps)
    assert (np.diff(raw) >= 0).all() and model.share < 0.3
    held = rows.where(common.fold(F.col("doc_id"), 3) == 1).toPandas()
    assert held[held.predicted == 1].toxic.mean() > 0.8 and held[held.toxic == 1].predicted.mean() > 0.5
    assert toxicity.score(odd, model).count() == len(ODD)
    big = spark.createDataFrame([(BIG, "you idiot"), (None, "a")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in toxicity.score(big, model).collect()} == {BIG, None}
    empty = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.0}
    twice = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    few = toxicity.fit(spark.createDataFrame([(i, f"words of {i}") for i in range(1, 5)], "doc_id long, text string"), twice, F.lit(True))
    assert sorted(zip(few.ids, few.labels, strict=True)) == [(1, 1), (2, 0)]


def test_toxicity_of_near_copies_and_rare_words():
    """A near copy of one example finds it, whatever its words; rare words that go with label 1 are marked."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [" ".join(word() for _ in range(30)) for _ in range(600)]
    examples = [(i, toxicity.term_counts(t + (" vile" if i < 25 else "")), int(i < 300)) for i, t in enumerate(texts)]
    model = toxicity.Model(examples, {}, 600)
    assert model.score(toxicity.term_counts("a vile remark"))[0] > 0.7
    assert model.score(toxicity.term_counts(texts[100] + " more"))[1][0] == 100
    assert "vile" in toxicity.marked_words([e[1] for e in examples], [e[2] for e in examples])


def test_substring_dedup_resists_shifts(spark, odd):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    rows, planted = [], set()
    for i in range(40):
        passage = words(60)
        rows += [(3 * i, words(30 + i) + " " + passage + " " + words(40)), (3 * i + 1, words(i) + passage + words(9)), (3 * i + 2, words(120))]
        planted |= {3 * i, 3 * i + 1}
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= planted and len(got) >= len(planted) - 2
    text = dict(rows)
    for i, r in got.items():
        other = text[i + 1 if i % 3 == 0 else i - 1].encode()
        assert all(text[i].encode()[s.start : s.end] in other for s in r.spans)
    assert [r.doc_id for r in substring_dedup.substring_dedup(odd).collect()] == [] and substring_dedup.substring_dedup(odd.limit(0)).count() == 0


def test_substring_dedup_against_brute_force(spark):
    """Chunks counted by their bytes in plain Python; texts of all lengths, in pieces or whole."""
    rng = np.random.default_rng(7)
    make = lambda n: bytes(rng.choice(list(b"abcdefghijklmno  "), n).astype(np.uint8)).decode()
    shared = [make(n) for n in (40, 95, 96, 200, 330, 5000)]
    rows = [(i, make(int(rng.integers(0, 400))) + shared[i % 6] + make(int(rng.integers(0, 300)))) for i in range(60)]
    rows += [(100 + i, "a short text of few bytes") for i in range(3)] + [(110, "x" * 9000), (111, "y" + "x" * 7000), (112, "only once"), (113, ""), (None, shared[5])]

    def cuts(data):
        h, out = 0, []
        for i, b in enumerate(data):
            h = (sum(int(substring_dedup._GEAR[data[i - k]]) << k for k in range(min(16, i + 1)))) & 0xFFFF
            if h < 65536 // substring_dedup.MEAN:
                out.append(i + 1)
        return sorted({0, *out, len(data)})

    def chunked(data):
        if len(data) < 96:
            return [(0, len(data))] if data else []
        c = cuts(data)
        ends = [next((e for e in c if e >= a + 96), a + 4096) for a in c]
        return [(a, min(e, a + 4096)) for a, e in zip(c, ends, strict=True) if min(e, a + 4096) <= len(data)]

    where, of = collections.defaultdict(set), {i: t.encode() for i, t in rows if i is not None}
    for i, data in of.items():
        for a, b in chunked(data):
            where[data[a:b]].add(i)
    want = {}
    for i, data in of.items():
        spans = []
        for a, b in sorted((a, b) for a, b in chunked(data) if len(where[data[a:b]]) > 1):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        if spans:
            want[i] = [tuple(x) for x in spans]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("start", F.lit(2))
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == want and {100, 101, 102, 110, 111} <= set(got) and 112 not in got
    whole, pieced = (sorted(map(tuple, substring_dedup.chunk_rows(docs, slab=n).collect())) for n in (1 << 20, 700))
    assert whole == pieced


def test_decontamination(spark, odd):
    item = [f"word{i}" for i in range(30)]
    swapped = [w if i % 9 else f"other{i}" for i, w in enumerate(item)]
    filler = lambda a: " ".join(f"f{a}x{i}" for i in range(40))
    docs = [(1, filler(1) + " " + " ".join(item) + ". " + filler(2)), (2, filler(3) + " " + " ".join(swapped) + " " + filler(4)), (3, filler(5)), (4, " ".join(item[:5]) + " " + filler(6)), (5, None), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, None), (10, "too short")], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7)}
    assert decontaminate.decontaminate(odd, bench).count() == 0 and decontaminate.decontaminate(odd, bench.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    """Random items with random substitutions: every window of 14 words that agrees in 11 is found, with its best count."""
    rng = np.random.default_rng(11)
    items = {i: [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(15, 40)))] for i in range(25)}
    docs = {}
    for i in range(120):
        item, share = items[i % 25], rng.choice([0, 0.1, 0.2, 0.25, 0.4])
        docs[i] = [f"f{x}" for x in rng.integers(0, 10**6, 20)] + [f"s{rng.integers(10**6)}" if rng.random() < share else w for w in item] + [f"w{x}" for x in rng.integers(0, 400, 20)]
    want = {}
    for (d, a), (i, b) in itertools.product(docs.items(), items.items()):
        for shift in range(-len(b) + 14, len(a) - 13):
            same = [a[j + shift] == b[j] if 0 <= j + shift < len(a) else None for j in range(len(b))]
            sums = [sum(same[j : j + 14]) for j in range(len(b) - 13) if None not in same[j : j + 14]]
            if sums and max(sums) >= 11:
                want[d, i] = max(want.get((d, i), 0), max(sums))
    got = decontaminate.decontaminate(*(spark.createDataFrame([(i, " ".join(w)) for i, w in x.items()], f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in got} == want and len(want) > 60


def test_decontamination_of_whole_items(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r.doc_id for r in decontaminate.decontaminate(documents, bench).collect()}
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    items = [" ".join(words(r.text)) for r in bench.collect()]
    assert {r.doc_id for r in documents.collect() if any(i in " ".join(words(r.text)) for i in items)} <= got


def test_decontamination_keeps_its_bitmaps_out_of_the_plans_texts(spark, documents):
    """The driver makes these texts again and again while a query runs."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = decontaminate.decontaminate(documents, bench)._jdf.queryExecution()
    assert len(plan.executedPlan().toString()) < 200_000 and len(plan.optimizedPlan().toString()) < 200_000


def test_constant_keeps_every_long(spark):
    longs = [0, 1, -1, 2**63 - 1, -(2**63), 1 << 40]
    assert spark.range(1).select(decontaminate._constant(spark, longs)).first()[0] == longs


def test_decontamination_finds_every_accepted_substitution(spark):
    """All placings of the most substitutions that the rule accepts, in items of 1 to 14 words and a lone passage of 14."""
    rng = np.random.default_rng(3)
    items = {n: [f"i{n}w{j}" for j in range(n)] for n in (*range(1, 15), 40)}
    docs, want = [], set()
    for n, item in items.items():
        part = item[:14]
        places = list(itertools.combinations(range(len(part)), len(part) // 4))
        for gone in places:
            docs.append((len(docs), " ".join(["before"] * 15 + [f"x{rng.integers(1e9)}" if j in gone else w for j, w in enumerate(part)] + ["after"] * 15)))
            want.add((len(docs) - 1, n))
        if len(part) > 1:  # one more is too many
            docs.append((len(docs), " ".join(["before"] * 15 + part[len(part) // 4 + 1 :] + ["after"] * 15)))
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_pii(spark, odd):
    text = "mail ann.b7@mail9.example.com, +1 (017) 555-7713, card 4485275742308327, ip 97.51.17.173, on 2021-02-28; not 999.1.2.3, 2021-02-30"
    d = spark.createDataFrame([(1, text), (2, "again 97.51.17.173 and ann.b7@mail9.example.com"), (3, "clean text 12"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(d, "k").collect()}
    for secret in ("ann.b7@", "555-7713", "4485275742308327", "97.51.17.173", "2021-02-28"):
        assert secret not in got[1]
    assert "999.1.2.3" in got[1] and "2021-02-30" in got[1] and got[3] == "clean text 12" and got[4] is None
    ip, mail = re.search(r"ip ([\d.]+)", got[1]).group(1), re.search(r"mail (\S+?),", got[1]).group(1)
    assert got[2] == f"again {ip} and {mail}" and re.fullmatch(r"[a-z]{3}\.[a-z]\d@mail9\.example\.com", mail)
    card = re.search(r"card (\d+)", got[1]).group(1)
    assert len(card) == 16 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(card)) % 10 == 0
    assert pii.pseudonymise(odd, "k").count() == len(ODD)


def feistel(key, kind, left, right, m_left, m_right):
    """The pair one step on in the dealt order, in plain Python."""

    def turn(i, other, modulus):
        return int(hashlib.sha256(f"{key}/{kind}/{m_left}/{m_right}/{i}/{other}".encode()).hexdigest()[:14], 16) % modulus

    for i in range(1, pii.ROUNDS + 1):
        left, right = ((left + turn(i, right, m_left)) % m_left, right) if i % 2 else (left, (right + turn(i, left, m_right)) % m_right)
    right = (right + 1) % m_right
    for i in range(pii.ROUNDS, 0, -1):
        left, right = ((left - turn(i, right, m_left)) % m_left, right) if i % 2 else (left, (right - turn(i, left, m_right)) % m_right)
    return left, right


def digits(key, kind, s):
    a = len(s) // 2
    left, right = feistel(key, kind, int(s[:a] or 0), int(s[a:]), 10**a, 10 ** (len(s) - a))
    return (f"{left:0{a}d}" if a else "") + f"{right:0{len(s) - a}d}"


def luhn(body):
    return -sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))) % 10


def test_pii_against_plain_python(spark):
    rng = np.random.default_rng(4)
    day0 = datetime.date(1, 1, 1)
    rows, want = [], []
    for _ in range(150):
        ssn = "".join(map(str, rng.integers(0, 10, 9)))
        ok = lambda d: not re.search(r"^(000|666|9..)|^...00|0000$", d)
        shape = lambda d: f"{d[:3]}-{d[3:5]}-{d[5:]}"
        now = ssn
        while ok(ssn):
            now = digits("k", "ssn", now)
            if ok(now):
                break
        rows.append(shape(ssn)), want.append(shape(now))
        body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        check = luhn(body)
        new = digits("k", "card", body)
        rows.append(body + str(check)), want.append(new + str(luhn(new)))
        rows.append(body + str((check + 1) % 10)), want.append(rows[-1])
        o = rng.integers(0, 256, 4).tolist()
        left, right = feistel("k", "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        rows.append(".".join(map(str, o))), want.append(f"{left // 256}.{left % 256}.{right // 256}.{right % 256}")
        n = int(rng.integers(600_000, 760_000))

        def moved(n):
            block = n // 40_000 * 40_000
            left, right = feistel("k", "date", (n - block) // 200, n % 200, 200, 200)
            return block + left * 200 + right

        date = lambda n: day0 + datetime.timedelta(n)
        rows.append(date(n).isoformat()), want.append(date(moved(n)).isoformat())
        rows.append(date(n).strftime("%m/%d/%Y")), want.append(date(moved(n)).strftime("%m/%d/%Y"))
        if date(n).day > 12:
            at = moved(n)
            while date(at).day <= 12:
                at = moved(at)
            rows.append(date(n).strftime("%d/%m/%Y")), want.append(date(at).strftime("%d/%m/%Y"))
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [r.text for r in pii.pseudonymise(d, "k").orderBy("doc_id").collect()] == want
    assert all(a != b for a, b in zip(rows, want, strict=True) if not re.fullmatch(r"\d{16}|(000|666|9..).*|...-00-.*|.*-0000", a))


def test_pii_permutes(spark):
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.format_string("%03d-%02d-%04d", F.col("id") % 10 + 1, F.lit(7), F.col("id") + 1).alias("text"))
    assert pii.pseudonymise(d, "k").select("text").distinct().count() == 1000
    days = spark.range(2000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymise(days, "k").select(F.to_date("text").alias("x")).where("x is not null").distinct().count() == 2000
    mails = spark.createDataFrame([(1, "J.Doe@x.org"), (2, "j.doe@x.org"), (None, "j.dof@x.org")], "doc_id long, text string").withColumn("n_pii", F.lit(5)).withColumn("found", F.lit(6))
    got = [r.text for r in pii.pseudonymise(mails, "k").collect()]
    assert got[0].lower() == got[1] != got[2] and re.fullmatch(r"[A-Z]\.[A-Z][a-z]{2}@x\.org", got[0])
    assert {(r.n_pii, r.found) for r in pii.pseudonymise(mails, "k").collect()} == {(5, 6)}


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "small"), (4, "u4", "small"), (5, None, None), (6, "u\r\n6", "x\r\nWARC/1.1\r\n\r\n" + "y" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert got[i].html == (None if i == 1 else html or "")
    assert warc.rewritten(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_warc_odd_rows(spark):
    big, long = "z" * 1000, "longer text with WARC/1.1\r\nWARC-Type: in it\r\n\r\n" * 60_000
    rows = [(BIG, "a", big), (None, "b", big), (BIG - 1, None, big), (7, "c", long), (7, "c", long), (3, "d", long), (4, "e", "z" * 999), (5, "f", "z" * 999), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("x")).withColumn("value", F.lit(1)).withColumn("k", F.lit(2)).coalesce(1)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.rewritten(pages).collect()), key=str)
    n = len(long)
    assert got == sorted([(BIG, 1000, "response", None), (None, 1000, "response", None), (BIG - 1, 1000, "revisit", BIG), (7, n, "response", None), (7, n, "response", None), (3, n, "revisit", 7), (4, 999, "response", None), (5, 999, "response", None), (None, 0, "response", None)], key=str)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path)
    html = sorted((r.html or "") for r in warc.read_archives(spark, path, payloads=True).collect())
    assert html == sorted([big, big, "", long, long, "", "z" * 999, "z" * 999, ""])


def test_warc_shuffles_headers_alone(spark):
    plan = warc.revisits(spark.read.parquet(f"{SF}/pages.parquet"))
    assert "html" not in plan.columns


def test_quality_rules(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for r in docs.collect():
        w = WORDS.findall(r.text)
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {p for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        lines = [x for x in r.text.split("\n") if WORDS.search(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (g.base_failed and g.kept)
    passing = docs.join(quality_rules.features(docs).withColumn("votes", quality_rules.votes()).where("exists(votes, v -> v = 0)").select("doc_id"), "doc_id", "left_anti")
    assert {r.doc_id for r in passing.collect()} != {i for i, g in got.items() if g.kept}  # it isn't all-must-pass
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert np.mean([got[i].kept for i, q in labels.items() if q == 0]) < 0.1 and np.mean([got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed]) > 0.97
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs).collect()) == sorted(i for i, g in got.items() if g.kept)
    assert quality_rules.quality_rules(odd).count() == len(ODD) and quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def em(patterns, counts, rounds):
    """The same estimates in numpy: (likelihood, share of good, rates for bad, rates for good)."""
    bad, good = patterns == 0, patterns == 2
    ends = []
    for q in (np.where(bad.any(1), 0.2, 0.95), (good.sum(1) + 0.5) / (bad.sum(1) + good.sum(1) + 1), np.where(bad.sum(1) >= good.sum(1), 0.1, 0.9)):
        for i in range(rounds + 1):
            g = (counts * q).sum()
            share = (g + 1) / (counts.sum() + 2)
            bb, bg, gb, gg = (((counts * x)[:, None] * v).sum(0) for x in (1 - q, q) for v in (bad, good))
            m = (bb + gb + 1) / (bb + gb + bg + gg + 2)
            sb, sg = np.maximum((bb + 1) / (bb + bg + 2), m), np.minimum((gb + 1) / (gb + gg + 2), m)
            odds = np.log(share / (1 - share)) + (bad * np.log(sg / sb)).sum(1) + (good * np.log((1 - sg) / (1 - sb))).sum(1)
            if i < rounds:
                q = 1 / (1 + np.exp(-odds))
        own = np.log(1 - share) + (bad * np.log(sb)).sum(1) + (good * np.log(1 - sb)).sum(1)
        ends.append(((counts * (own + np.log1p(np.exp(odds)))).sum(), share, sb, sg))
    return max(ends, key=lambda e: e[0])


def test_quality_em_recovers_planted_rates(spark):
    rng = np.random.default_rng(12)
    sb, sg, speaks = np.array([0.8, 0.6, 0.7, 0.3, 0.5]), np.array([0.05, 0.1, 0.02, 0.25, 0.5]), np.array([0.9, 1, 0.7, 1, 1])
    good = rng.random(30_000) < 0.8
    votes = np.where(rng.random((30_000, 5)) < np.where(good[:, None], sg, sb), 0, 2)
    votes = np.where(rng.random((30_000, 5)) < speaks, votes, 1)
    got = quality_rules.fitted(spark.createDataFrame([(v,) for v in votes.tolist()], "votes array<int>"), rules=5).first()
    assert abs(1 / (1 + np.exp(-got.prior)) - 0.8) < 0.03
    assert np.allclose([r.bad for r in got.rules], sb, atol=0.06) and np.allclose([r.good for r in got.rules], sg, atol=0.03)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    likelihood, share, b, g = em(patterns, counts.astype(float), quality_rules.ROUNDS)
    assert np.isclose(got.likelihood, likelihood) and np.isclose(got.prior, np.log(share / (1 - share)))
    assert np.allclose([r.bad for r in got.rules], b) and np.allclose([r.good for r in got.rules], g)


def test_mixing_of_equal_ids(spark):
    """Null ids and repeated rows are documents of their own, cut one after another."""
    rows = [(None, "w " * (i % 7), "a") for i in range(300)] + [(5, "w w w", "a")] * 200 + [(i, "w " * 4, "b") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9)).withColumn("key", F.lit(1))
    got = mixing.mix_sources(d).toPandas()
    assert len(got) == 600 and sorted(got["size"]) == sorted(len((t or "").split()) for _, t, _ in rows)
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.target - by.taken).abs() <= 1).all() and (got.taken <= 2 * got["size"]).all()
    assert mixing.mix_sources(d.repartition(5)).exceptAll(mixing.mix_sources(d)).count() == 0


def test_mixing(spark, odd):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 30)), "en", None if i % 50 == 0 else f"s{int(rng.zipf(2)) % 7}", 0) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(d).toPandas()
    size = got["size"].sum()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * size) < 1e-6 * size and (by.target <= 2 * by["size"] + 1e-9).all()
    assert ((by.target - by.taken).abs() <= 1).all() and (got.taken <= 2 * got["size"]).all()
    free = by[by.target < 2 * by["size"] - 1e-9]
    order = sorted((s for s in by.index if isinstance(s, str))) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    level = [t / weight[s if isinstance(s, str) else None] for s, t in free.target.items()]
    assert np.ptp(level) < 1e-6 * max(level)
    assert mixing.mix_sources(d.repartition(7)).exceptAll(mixing.mix_sources(d)).count() == 0
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(odd.limit(0)).count() == 0


def test_pipeline_against_its_operators(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, documents, SF).cache()
    good = {r.doc_id for r in quality_rules.quality_rules(documents).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    single = stages["near_duplicates"](spark, kept, SF)
    want = components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    last = corpus_pipeline.run(spark, SF)
    assert 0 < last.count() <= single.count()


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    for c in ("words", "h", "n_pii", "component_id", "kept", "row", "votes", "item_id"):
        docs = docs.withColumn(c, F.lit(7))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert out.columns == docs.columns and out.count() <= len(ODD), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(ODD)


def test_registered(spark):
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES] == list(range(1, 11))
