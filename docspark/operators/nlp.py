"""Token tables, keyphrases, tone, document features, entity linking and relations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from docspark.functions.text import STOP_WORDS, tokens


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(document_id, token_index, sentence_index, token_text, lemma, is_stop, is_alpha): sentences end at [.!?] before blanks or the end."""
    # Tokens are numbered inside the row, so nothing is shuffled.
    sentence = lambda s, i: F.transform(tokens(s, lower=False), lambda w: F.struct(i.cast("long").alias("i"), w.alias("w")))
    t = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.flatten(F.transform(F.split(text_col, r"(?<=[.!?])\s+"), sentence))).alias("at", "t"))
    return t.select(
        "document_id", F.col("at").cast("long").alias("token_index"), F.col("t.i").alias("sentence_index"), F.col("t.w").alias("token_text"),
        F.lower("t.w").alias("lemma"), F.lower("t.w").isin(*STOP_WORDS).alias("is_stop"), F.col("t.w").rlike(r"^\p{L}+$").alias("is_alpha"),
    )


def entity_table(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a match of a label's pattern: (document_id, label, entity_index, entity_text)."""
    found = F.array(*(F.struct(F.lit(k).alias("label"), F.regexp_extract_all(text_col, F.lit(p), F.lit(0)).alias("hits")) for k, p in patterns.items()))
    e = docs.select(F.col(id_col).alias("document_id"), F.explode(found).alias("f"))
    return e.select("document_id", "f.label", F.posexplode("f.hits").alias("entity_index", "entity_text"))


def keyphrases(toks: DataFrame, top_k: int = 5, max_n: int = 2) -> DataFrame:
    """Best phrases of 1..max_n tokens of a sentence by share of the document's candidates.

    A candidate starts and ends with a token that is no stop word; ties go to the lesser phrase.
    """
    w = Window.partitionBy("document_id", "sentence_index").orderBy("token_index")
    t = toks.select("document_id", "sentence_index", "token_index", "lemma", "is_stop")
    grams = [F.when(~F.col("is_stop"), F.col("lemma")).alias("g1")]
    words = [F.col("lemma")]
    for n in range(2, max_n + 1):
        words.append(F.lead("lemma", n - 1).over(w))
        ok = ~F.col("is_stop") & F.coalesce(~F.lead("is_stop", n - 1).over(w), F.lit(False)) & (F.lead("token_index", n - 1).over(w) == F.col("token_index") + n - 1)
        grams.append(F.when(ok, F.concat_ws(" ", *words)).alias(f"g{n}"))
    t = t.select("document_id", *grams)
    c = t.select("document_id", F.explode(F.array(*t.columns[1:])).alias("phrase")).where("phrase is not null").groupBy("document_id", "phrase").agg(F.count("*").alias("count"))
    c = c.withColumn("score", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("document_id")), 9))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "phrase"))
    return c.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top_k)


def document_tone(toks: DataFrame, lexicon: DataFrame, documents: DataFrame, negators: tuple[str, ...] = ("not", "no", "never"), look_back: int = 3) -> DataFrame:
    """Hits and score of each category of lexicon(term, category, weight), which Spark broadcasts if it is small.

    A term with a negator among the `look_back` tokens before it in its sentence counts with its sign turned. Scores are
    weights a token; documents without tokens have null scores and status insufficient_text.
    """
    w = Window.partitionBy("document_id", "sentence_index").orderBy("token_index").rowsBetween(-look_back, -1)
    t = toks.withColumn("sign", F.when(F.max(F.col("lemma").isin(*negators).cast("int")).over(w) == 1, -1).otherwise(1))
    n = toks.groupBy("document_id").agg(F.count("*").alias("token_count"))
    hits = t.join(lexicon, t["lemma"] == lexicon["term"]).groupBy("document_id", "category").agg(F.count("*").alias("hits"), F.sum(F.col("weight") * F.col("sign")).alias("weight"))
    cats = [r[0] for r in lexicon.select("category").distinct().orderBy("category").collect()]
    wide = hits.groupBy("document_id").agg(*(a for c in cats for a in (F.sum(F.when(F.col("category") == c, F.col("hits"))).alias(f"{c}_hits"), F.sum(F.when(F.col("category") == c, F.col("weight"))).alias(f"{c}_weight"))))
    d = documents.select("document_id").join(n, "document_id", "left").join(wide, "document_id", "left").withColumn("token_count", F.coalesce("token_count", F.lit(0)))
    cols = [c for k in cats for c in (F.coalesce(f"{k}_hits", F.lit(0)).alias(f"{k}_hits"), F.when(F.col("token_count") > 0, F.round(F.coalesce(f"{k}_weight", F.lit(0.0)) / F.col("token_count"), 9)).alias(f"{k}_score"))]
    return d.select("document_id", "token_count", *cols, F.when(F.col("token_count") > 0, "ok").otherwise("insufficient_text").alias("status"))


def document_features(toks: DataFrame, documents: DataFrame) -> DataFrame:
    """Token counts, distinct lemmas and sentences, and null-safe ratios for each document."""
    f = toks.groupBy("document_id").agg(
        F.count("*").alias("token_count"), (F.countDistinct("lemma") + F.max(F.col("lemma").isNull().cast("int"))).cast("long").alias("unique_lemmas"),
        F.countDistinct("sentence_index").alias("sentence_count"), F.sum(F.col("is_stop").cast("long")).alias("stop_count"), F.sum(F.col("is_alpha").cast("long")).alias("alpha_count"),
    )
    d = documents.select("document_id").join(f, "document_id", "left").fillna(0, ["token_count", "unique_lemmas", "stop_count", "alpha_count"])
    ratio = lambda a: F.when(F.col("token_count") > 0, F.round(F.col(a) / F.col("token_count"), 9))
    return d.withColumn("stop_ratio", ratio("stop_count")).withColumn("lexical_diversity", ratio("unique_lemmas"))


def link_aliases(mentions: DataFrame, aliases: DataFrame, normalise) -> DataFrame:
    """mentions(entity_id, entity_text) to aliases(alias, entity_namespace, canonical_id): exact before normalised, a namespace at a time."""
    exact = mentions.join(aliases, F.col("entity_text") == F.col("alias")).select("entity_id", "entity_text", "entity_namespace", "canonical_id", F.lit("exact").alias("method")).distinct()
    norm = mentions.withColumn("k", normalise(F.col("entity_text"))).join(aliases.withColumn("k", normalise(F.col("alias"))), "k")
    norm = norm.select("entity_id", "entity_text", "entity_namespace", "canonical_id", F.lit("normalized").alias("method")).distinct()
    found = exact.unionByName(norm.join(exact.select("entity_id", "entity_namespace").distinct(), ["entity_id", "entity_namespace"], "left_anti").select(exact.columns))
    n = F.count("*").over(Window.partitionBy("entity_id", "entity_namespace"))
    found = found.withColumn("status", F.when(n > 1, "ambiguous").otherwise("matched"))
    return mentions.select("entity_id", "entity_text").join(found.drop("entity_text"), "entity_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))


def fuzzy_links(left: DataFrame, right: DataFrame, grams, threshold: float) -> DataFrame:
    """(left_id, right_id, score): Dice of gram sets of left(left_id, text) and right(right_id, text), by equi-joins on grams."""
    a = left.select("left_id", grams(F.col("text")).alias("g"))
    b = right.select("right_id", grams(F.col("text")).alias("h"))
    x = a.select("left_id", F.size("g").alias("n"), F.explode("g").alias("k")).join(b.select("right_id", F.size("h").alias("m"), F.explode("h").alias("k")), "k")
    s = x.groupBy("left_id", "right_id").agg((2 * F.count("*") / (F.max("n") + F.max("m"))).alias("score"))
    return s.where(F.col("score") >= threshold).withColumn("score", F.round("score", 9))


def resolve_candidates(scored: DataFrame, margin: float) -> DataFrame:
    """Candidates within `margin` of the best of their mention and namespace; more than one is ambiguous."""
    w = Window.partitionBy("entity_id", "entity_namespace")
    kept = scored.withColumn("top", F.max("score").over(w)).where(F.col("score") >= F.col("top") - margin).drop("top")
    return kept.withColumn("status", F.when(F.count("*").over(w) > 1, "ambiguous").otherwise("matched"))


def cooccurrences(mentions: DataFrame, max_gap: int | None = None) -> DataFrame:
    """Undirected pairs of mentions of one sentence, or at most `max_gap` characters apart in one document."""
    keys = ["document_id", "sentence_index"] if max_gap is None else ["document_id"]
    a, b = mentions.alias("a"), mentions.alias("b")
    if max_gap is not None:
        # A mention meets those of its own stretch of the document and of the next one, not all of the document. It starts at most
        # max_gap behind the end of the other, so stretches are as long as that and the longest mention.
        width = mentions.agg(F.max(F.col("end") - F.col("start")) + max_gap + 1).scalar()
        placed = mentions.withColumn("__width", width).withColumn("__s", F.floor(F.col("start") / F.col("__width"))).drop("__width")
        keys = [*keys, "__s"]
        a, b = placed.withColumn("__s", F.explode(F.array("__s", F.col("__s") + 1))).alias("a"), placed.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.struct("a.start", "a.entity_id") < F.struct("b.start", "b.entity_id")]
    if max_gap is not None:
        cond.append(F.col("b.start") - F.col("a.end") <= max_gap)
    return a.join(b, cond).select("a.document_id", F.col("a.entity_id").alias("source_id"), F.col("b.entity_id").alias("target_id"), F.col("a.label").alias("source_label"), F.col("b.label").alias("target_label"))


def rule_relations(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Directed relations of pairs by rules(source_label, target_label, relation), tried in both orientations."""
    turned = pairs.select("document_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("target_label").alias("source_label"), F.col("source_label").alias("target_label"))
    return pairs.select(turned.columns).unionByName(turned).join(rules, ["source_label", "target_label"])


def asserted_relations(claims: DataFrame, candidates: DataFrame, types: list[str], threshold: float) -> DataFrame:
    """claims(source_id, target_id, relation, confidence) on candidate pairs and listed types: best confidence a type; several types are ambiguous."""
    c = claims.where(F.col("relation").isin(*types)).join(candidates.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_semi")
    c = c.groupBy("source_id", "target_id", "relation").agg(F.max("confidence").alias("confidence"))
    many = F.count("*").over(Window.partitionBy("source_id", "target_id")) > 1
    return c.withColumn("status", F.when(many, "ambiguous").when(F.col("confidence") >= threshold, "asserted").otherwise("no_relation"))


def concept_edges(pairs: DataFrame, a: str, b: str, weight: Column | None = None) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("source"), F.greatest(a, b).alias("target")).agg((F.count("*") if weight is None else F.sum(weight)).alias("weight"))


def concepts(links: DataFrame, top_n: int) -> DataFrame:
    """links(canonical_id, document_id, status, score): frequency, documents, any ambiguity and best score; the top_n."""
    c = links.where("canonical_id is not null").groupBy("canonical_id").agg(F.count("*").alias("frequency"), F.countDistinct("document_id").alias("documents"), F.bool_or(F.col("status") == "ambiguous").alias("ambiguous"), F.max("score").alias("score"))
    return c.orderBy(F.desc("frequency"), "canonical_id").limit(top_n)


def _squares(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of squares of each vector, added up in its order."""
    length, out = np.diff(starts), np.zeros(len(starts) - 1)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        v = values[starts[at][:, None] + np.arange(n)]
        out[at] = _dots(v, v)
    return out


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out = out + x[:, d] * y[:, d]
    return out


class _Vectors:
    """Vectors one after another: values, starts, and which have a null element; groups of one length, scaled to norm 1."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, null: np.ndarray):
        self.null, self.length = null, np.diff(starts)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_squares(values, starts))
            self.groups = {}
            for n in np.unique(self.length).tolist():
                at = np.flatnonzero(self.length == n)
                v = values[starts[at][:, None] + np.arange(n)]
                # What double precision can't scale is NaN, which no bound leaves out.
                norm = self.norm[at]
                unit = np.where(((norm >= 1e-100) & (norm <= 1e100))[:, None], v / norm[:, None], np.nan)
                unit[null[at] | (norm == 0)] = 0.0
                self.groups[n] = (at, v, unit)
        self.zero = null | (self.norm == 0)


def _vector_pairs(m: _Vectors, r: _Vectors, spaces: np.ndarray, threshold: float, margin: float):
    """(members of m, members of r, cosines) of at least the threshold and, within a mention, this block and a namespace, within the margin of
    the best. Products of matrices bound the cosines; what they leave open is added up in the order of the elements."""
    near = 1e-8  # above all rounding here, and that of scores to nine digits
    none = np.empty((0, 0))
    for n, (m_at, m_v, m_unit) in m.groups.items():
        for k, (r_at, r_v, r_unit) in r.groups.items():
            if k != n and threshold > 0:
                continue  # no cosine; 0 beside a vector without a norm
            order = np.argsort(spaces[r_at], kind="stable")
            to, v, unit = r_at[order], r_v[order], (r_unit[order].T if k == n else none)
            cuts = np.flatnonzero(np.diff(spaces[to], prepend=-1))
            widths = np.diff(cuts, append=len(to))
            step = max(1, PAIRS_AT_ONCE // len(to))
            for begin in range(0, len(m_at), step):
                own = slice(begin, begin + step)
                with np.errstate(all="ignore"):
                    if k == n:
                        rough = m_unit[own] @ unit
                        best = np.repeat(np.fmax.reduceat(rough, cuts, axis=1), widths, axis=1)
                        open_ = ~(rough < np.fmax(threshold, best - margin) - near)
                    else:
                        open_ = np.zeros((len(m_at[own]), len(to)), bool)
                    if threshold <= 0:
                        open_ |= m.zero[m_at[own]][:, None] | r.zero[to][None]
                    i, j = np.nonzero(open_)
                    for part in range(0, len(i), OPEN_AT_ONCE):
                        x, y = i[part : part + OPEN_AT_ONCE], j[part : part + OPEN_AT_ONCE]
                        a, b = m_at[own][x], to[y]
                        norm, null = m.norm[a] * r.norm[b], m.null[a] | r.null[b]
                        zero = null | (norm <= 0)
                        score = _dots(m_v[own][x], v[y]) / norm if k == n else np.full(len(x), -np.inf)
                        score[zero] = 0.0
                        kept = ~(score < threshold) & (zero | (k == n))  # a NaN is above all, as in Spark
                        yield a[kept], b[kept], score[kept]


#: Values of references that go to the executors at once, cosines in a matrix, and cosines added up at once.
REFERENCE_VALUES, PAIRS_AT_ONCE, OPEN_AT_ONCE = 1 << 21, 1 << 21, 1 << 15


def vector_links(mentions: DataFrame, aliases: DataFrame, threshold: float, margin: float = 0.0) -> DataFrame:
    """mentions(entity_id, embedding) to the aliases(entity_namespace, canonical_id, embedding) of cosine at least `threshold`: per namespace the
    best and what lies within `margin` of it. Aliases are a reference set and go to the executors in blocks of REFERENCE_VALUES; mentions are read
    where they lie, and of each block only what its own best leaves open is shuffled."""
    kinds = {"entity_id": mentions.schema["entity_id"].dataType, "entity_namespace": aliases.schema["entity_namespace"].dataType, "canonical_id": aliases.schema["canonical_id"].dataType}
    schema = StructType([*(StructField(k, v) for k, v in kinds.items()), StructField("score", DoubleType())])
    types = {k: to_arrow_type(v) for k, v in kinds.items()}
    vector = F.col("embedding").cast("array<double>").alias("v")
    rows = mentions.where("embedding is not null").select("entity_id", vector)
    columns = [*types, "score"]

    def against(names: list, ids: list, vectors: list[np.ndarray], nulls: list[bool]) -> DataFrame:
        starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int64)
        block = (names, ids, np.concatenate([np.zeros(0), *vectors]), starts, np.array(nulls, bool))
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            names, ids, values, starts, null = shared.value
            if not ids:
                return
            refs = _Vectors(values, starts, null)
            number: dict = {}
            spaces = np.array([number.setdefault(x, len(number)) for x in names])
            names, ids = pa.array(names, types["entity_namespace"]), pa.array(ids, types["canonical_id"])
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(1)
                lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at, inner = np.concatenate([[0], np.cumsum(lengths)]), v.flatten()
                gone = np.concatenate([[0], np.cumsum(inner.is_null().to_numpy(zero_copy_only=False))])
                own = _Vectors(inner.to_numpy(zero_copy_only=False).astype(float), at, gone[at[1:]] > gone[at[:-1]])
                for a, b, score in _vector_pairs(own, refs, spaces, threshold, margin):
                    a, b = pa.array(a), pa.array(b)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(a), names.take(b), ids.take(b), pa.array(score)], names=columns)

        return rows.mapInArrow(run, schema)

    scored, names, ids, vectors, nulls, held = None, [], [], [], [], 0
    for name, key, v in aliases.where("embedding is not null").select("entity_namespace", "canonical_id", vector).toLocalIterator():
        names.append(name)
        ids.append(key)
        vectors.append(np.array(v, float))  # None becomes NaN
        nulls.append(None in v)
        held += len(v) + 1
        if held >= REFERENCE_VALUES:
            part = against(names, ids, vectors, nulls)
            scored, names, ids, vectors, nulls, held = part if scored is None else scored.union(part), [], [], [], [], 0
    if ids or scored is None:
        part = against(names, ids, vectors, nulls)
        scored = part if scored is None else scored.union(part)
    best = scored.groupBy("entity_id", "entity_namespace", "canonical_id").agg(F.round(F.max("score"), 9).alias("score"))
    return resolve_candidates(best, margin)


def refuse_ambiguous(links: DataFrame) -> DataFrame:
    """links, unless a mention is ambiguous: then an error that names five of them at most."""
    some = sorted(str(r[0]) for r in links.where("status = 'ambiguous'").select("entity_id").distinct().limit(5).collect())
    if some:
        raise ValueError(f"ambiguous mentions: {some}")
    return links


def capped_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """pairs, unless a document has more than `most`: then an error, so that none is dropped unseen."""
    over = pairs.groupBy("document_id").count().where(F.col("count") > most).limit(1).collect()
    if over:
        raise ValueError(f"document {over[0][0]} has {over[0][1]} pairs; at most {most} are allowed")
    return pairs


def reference_fingerprint(aliases: DataFrame, columns: list[str]) -> DataFrame:
    """One row (fingerprint, rows) of a reference set, whatever its order and repeats: digests of rows summed up in two ways."""
    h = aliases.select(*columns).distinct().select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", i, 15), 16, 10).cast("decimal(38,0)")
    return h.agg(F.sha2(F.concat_ws("/", F.sum(part(1)), F.sum(part(16)), F.count("*")), 256).alias("fingerprint"), F.count("*").alias("rows"))


def lexicon_conflicts(lexicon: DataFrame) -> DataFrame:
    """(term, category, weights) of lexicon(term, category, weight) whose term has several weights in a category, whatever its case."""
    g = lexicon.groupBy(F.lower("term").alias("term"), "category").agg(F.count_distinct("weight").alias("weights"))
    return g.where("weights > 1")


def tone_coverage(toks: DataFrame, lexicon: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, token_count, hits, coverage): the share of a document's tokens that the lexicon has; null without tokens."""
    known = lexicon.select(F.col("term").alias("__term")).distinct()
    t = toks.join(known, F.col("lemma") == F.col("__term"), "left").groupBy("document_id").agg(F.count("*").alias("token_count"), F.count("__term").alias("hits"))
    d = documents.select("document_id").join(t, "document_id", "left").fillna(0, ["token_count", "hits"])
    return d.withColumn("coverage", F.when(F.col("token_count") > 0, F.round(F.col("hits") / F.col("token_count"), 9)))
