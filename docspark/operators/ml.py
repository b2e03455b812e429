"""Bag-of-words features, naive Bayes, clusters and topics, as expressions and pyspark.ml."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import STOP_WORDS, let, tokens


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop: bool = True, n: int = 1) -> DataFrame:
    """(row_id, term, count) of word n-grams after stop words are dropped."""
    words = F.filter(tokens(F.col(text_col)), lambda t: ~t.isin(*STOP_WORDS)) if stop else tokens(F.col(text_col))

    def cut(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    grams = words if n == 1 else let(words, cut)
    return docs.select(F.col(id_col).alias("row_id"), F.explode(grams).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("count"))


def char_ngrams(text: Column, n: int, within_words: bool = False) -> Column:
    """Character n-grams of the text, or of each word between blanks."""
    cut = lambda s: F.transform(F.when(F.length(s) >= n, F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(s, i, F.lit(n)))
    return F.flatten(F.transform(tokens(text), lambda w: cut(F.concat(F.lit(" "), w, F.lit(" "))))) if within_words else cut(F.lower(text))


def vocabulary(counts: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, n_docs: int | None = None) -> DataFrame:
    """(term, df, term_index): terms by falling df, then term; the chosen ones are numbered in alphabetical order."""
    v = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    if max_df < 1.0:
        v = v.where(F.col("df") <= max_df * F.lit(n_docs))
    if max_features is not None:
        v = v.orderBy(F.desc("df"), "term").limit(max_features)
    return v.withColumn("term_index", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """tf = count / tokens of the row that are in the vocabulary, idf = ln((1 + n) / (1 + df)) + 1."""
    total = F.sum("count").over(Window.partitionBy("row_id"))
    f = counts.join(vocab, "term").withColumn("tf", F.col("count") / total)
    f = f.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    return f.select("row_id", "term", "term_index", "count", F.round("tf", 9).alias("tf"), F.round("idf", 9).alias("idf"), F.round(F.col("tf") * F.col("idf"), 9).alias("tfidf"))


def hashed(counts: DataFrame, buckets: int) -> DataFrame:
    """(row_id, hash_bucket, value): signed feature hashing by blake2b, 8 bytes for the bucket and one bit for the sign."""

    @F.pandas_udf("struct<bucket:long,sign:int>")
    def place(term: pd.Series) -> pd.DataFrame:
        d = [hashlib.blake2b(t.encode(), digest_size=9).digest() for t in term]
        return pd.DataFrame({"bucket": [int.from_bytes(x[:8], "big") % buckets for x in d], "sign": [1 if x[8] & 1 else -1 for x in d]})

    return counts.withColumn("p", place("term")).groupBy("row_id", F.col("p.bucket").alias("hash_bucket")).agg(F.sum(F.col("count") * F.col("p.sign")).alias("value"))


def naive_bayes(train: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """train(row_id, label, term, count) -> priors(label, log_prior, blank) and likelihoods(label, term, log_likelihood).

    prior (c + a) / (n + a k), likelihood (t + a) / (T + a V); `blank` is the likelihood of a term the label never has.
    """
    docs = train.select("row_id", "label").distinct().groupBy("label").agg(F.count("*").alias("c"))
    every = Window.partitionBy()
    size = train.agg(F.countDistinct("term")).scalar()
    totals = train.groupBy("label").agg(F.sum("count").alias("total"))
    priors = docs.withColumn("log_prior", F.log((F.col("c") + alpha) / (F.sum("c").over(every) + alpha * F.count("*").over(every)))).join(totals, "label").withColumn("size", size)
    priors = priors.withColumn("blank", F.log(alpha / (F.col("total") + alpha * F.col("size"))))
    like = train.groupBy("label", "term").agg(F.sum("count").alias("t")).join(priors.select("label", "total", "size"), "label")
    return priors.select("label", "log_prior", "blank"), like.select("label", "term", F.log((F.col("t") + alpha) / (F.col("total") + alpha * F.col("size"))).alias("log_likelihood"))


def naive_bayes_predict(rows: DataFrame, priors: DataFrame, likelihoods: DataFrame, known: DataFrame) -> DataFrame:
    """rows(row_id, term, count) -> (row_id, label, probability), the best label of each row.

    The labels are a handful: each row gets them from the prior table, and terms add the difference from `blank`.
    """
    seen = rows.join(known.select("term").distinct(), "term")
    n = seen.groupBy("row_id").agg(F.sum("count").alias("n"))
    labels = priors.agg(F.collect_list(F.struct("label", "log_prior", "blank")).alias("l"))
    base = rows.select("row_id").distinct().join(n, "row_id", "left").withColumn("l", labels.scalar()).select("row_id", F.coalesce("n", F.lit(0)).alias("n"), F.explode("l").alias("x"))
    base = base.select("row_id", F.col("x.label").alias("label"), (F.col("x.log_prior") + F.col("n") * F.col("x.blank")).alias("base"))
    add = seen.join(likelihoods, "term").join(priors.select("label", "blank"), "label").groupBy("row_id", "label").agg(F.sum(F.col("count") * (F.col("log_likelihood") - F.col("blank"))).alias("more"))
    s = base.join(add, ["row_id", "label"], "left").withColumn("score", F.col("base") + F.coalesce("more", F.lit(0.0)))
    w = Window.partitionBy("row_id")
    p = s.withColumn("top", F.max("score").over(w)).withColumn("e", F.exp(F.col("score") - F.col("top"))).withColumn("probability", F.col("e") / F.sum("e").over(w))
    return p.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "label"))).where("r = 1").select("row_id", "label", F.round("probability", 6).alias("probability"))


def ctfidf(counts: DataFrame, clusters: DataFrame, top: int = 10) -> DataFrame:
    """Class-based TF-IDF: term shares in a cluster times ln(1 + mean cluster size / corpus count); ranks from 0."""
    g = counts.join(clusters, "row_id").groupBy("cluster", "term").agg(F.sum("count").alias("n"))
    size = F.sum("n").over(Window.partitionBy("cluster"))
    g = g.withColumn("tf", F.col("n") / size).withColumn("all", F.sum("n").over(Window.partitionBy("term")))
    mean = g.agg(F.sum("n") / F.countDistinct("cluster")).scalar()
    g = g.withColumn("score", F.round(F.col("tf") * F.log(1 + mean / F.col("all")), 9))
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "term")) - 1
    return g.withColumn("rank", r.cast("long")).where(F.col("rank") < top).select("cluster", "rank", "term", "score")


def coherence(top: DataFrame, counts: DataFrame, group: str = "cluster") -> DataFrame:
    """UMass coherence: mean of ln((D(a, b) + 1) / (D(a) + 1)) over the pairs of a group's top terms, a ranked before b.

    `top` holds a bounded number of ranked terms a group; D counts the documents of `counts` that have the terms.
    """
    seen = counts.join(top.select("term").distinct(), "term").select("row_id", "term").distinct()
    df = seen.groupBy("term").agg(F.count("*").alias("df"))
    first, second = (top.select(group, F.col("rank").alias(f"{p}_rank"), F.col("term").alias(p)) for p in ("a", "b"))
    pairs = first.join(second, group).where("a_rank < b_rank").select(group, "a", "b")
    both = pairs.select("a", "b").distinct().join(seen.withColumnRenamed("term", "a"), "a").join(seen.withColumnRenamed("term", "b"), ["row_id", "b"])
    both = both.groupBy("a", "b").agg(F.count("*").alias("both"))
    scored = pairs.join(both, ["a", "b"], "left").join(df.withColumnRenamed("term", "a"), "a")
    return scored.groupBy(group).agg(F.count("*").alias("pairs"), F.round(F.avg(F.log((F.coalesce("both", F.lit(0)) + 1) / (F.col("df") + 1))), 6).alias("umass"))


def inertia(clustered: DataFrame) -> DataFrame:
    """(cluster, size, inertia) of rows with a cluster and a distance to its centroid."""
    return clustered.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.sum(F.col("distance") * F.col("distance")), 6).alias("inertia"))


def centroids(vectors: DataFrame, cluster: str = "label", column: str = "embedding") -> DataFrame:
    """(cluster, center): the mean of each dimension over a cluster's vectors, summed partially before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vectors.select(F.col(cluster).alias("cluster"), array_to_vector(column).alias("v")).groupBy("cluster").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("center"))


def distances(vectors: DataFrame, centers: DataFrame, cluster: str = "label", column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance): Euclidean distance of each vector to its cluster's centroid."""
    apart = F.zip_with(column, "center", lambda x, y: (x - y) * (x - y))
    rows = vectors.select(id_col, F.col(cluster).alias("cluster"), column).join(centers, "cluster")
    return rows.select(id_col, "cluster", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda a, b: a + b)).alias("distance"))


def silhouette(vectors: DataFrame, cluster: str = "label", column: str = "embedding") -> DataFrame:
    """(cluster, size, silhouette): mean silhouette by squared Euclidean distance. Sums of the vectors and of their squares of
    each cluster give the mean distance of a row to each cluster, so no two rows are paired; clusters of one row score 0."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(cluster).alias("cluster"), F.col(column).alias("e"), square(column).alias("q"))
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("q").alias("q"), vector_to_array(Summarizer.mean(array_to_vector("e"))).alias("m"))
    every = sums.agg(F.collect_list(F.struct("cluster", "n", "q", "m"))).scalar()  # one entry a cluster
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = rows.withColumn("all", every).select("cluster", F.transform("all", lambda c: F.struct(c["cluster"].alias("of"), c["n"].alias("n"), (F.col("q") + c["q"] - 2 * dot("e", c["m"])).alias("d"))).alias("to"))
    own = F.get(F.filter("to", lambda c: c["of"] == F.col("cluster")), F.lit(0))
    a, b = own["d"] * own["n"] / (own["n"] - 1), F.array_min(F.transform(F.filter("to", lambda c: c["of"] != F.col("cluster")), lambda c: c["d"]))
    value = F.when(own["n"] > 1, (b - a) / F.greatest(a, b)).otherwise(0.0)
    return apart.select("cluster", value.alias("s")).groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("s"), 6).alias("silhouette"))


def dbscan(vectors: DataFrame, eps: float, min_samples: int = 5, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, cluster): density clusters by Euclidean distance, exactly; cluster is the least id of a core row reached, null for noise.

    Rows go to the executors in blocks and each batch finds its neighbours in a block; only pairs within eps leave it. Core rows
    have at least `min_samples` rows within eps, themselves included; a border row joins the least cluster that reaches it.
    """
    from docspark.operators.components import components
    from docspark.operators.retrieval import within

    near = within(vectors.select(F.col(id_col).alias("query_id"), F.col(column).alias("v")), vectors.select(F.col(id_col).alias("row_id"), F.col(column).alias("v")), eps)
    core = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(F.col("query_id").alias("core"))
    edges = near.join(core, F.col("query_id") == F.col("core")).select(F.col("core").alias("a"), F.col("row_id").alias("b"))
    both = edges.join(core, F.col("b") == F.col("core"), "left_semi")
    group = core.join(components(both), F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("group"))
    of = edges.join(group, F.col("a") == F.col("core")).groupBy("b").agg(F.min("group").alias("reached"))
    of = of.join(group, F.col("b") == F.col("core"), "left").select("b", F.coalesce("group", "reached").alias("cluster"))
    return vectors.select(id_col).join(of, F.col(id_col) == F.col("b"), "left").select(id_col, "cluster")


def kmeans(vectors: DataFrame, k: int, seed: int = 7, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, cluster, distance to the centroid)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(id_col, array_to_vector(column).alias("features"))
    model = KMeans(k=k, seed=seed).fit(v)
    centers = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    d = model.transform(v).select(id_col, F.col("prediction").alias("cluster"), vector_to_array("features").alias("v")).join(F.broadcast(centers), "cluster")
    return d.select(id_col, "cluster", F.sqrt(F.aggregate(F.zip_with("v", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)).alias("distance"))


def representatives(clustered: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    r = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", id_col)) - 1
    return clustered.withColumn("rank", r.cast("long")).where(F.col("rank") < n)


def lda_topics(counts: DataFrame, vocab: DataFrame, k: int, top: int = 10, seed: int = 7) -> DataFrame:
    """(topic, rank, term, weight) of pyspark.ml LDA over a vocabulary of bounded size (max_features)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel

    words = [r.term for r in vocab.orderBy("term_index").select("term").collect()]  # as many as max_features
    repeated = F.flatten(F.collect_list(F.array_repeat("term", F.col("count").cast("int"))))
    rows = counts.join(vocab, "term").groupBy("row_id").agg(repeated.alias("words"))
    pairs = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="features").transform(rows)
    model = LDA(k=k, seed=seed, maxIter=10).fit(pairs.select("row_id", "features"))
    t = model.describeTopics(top).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "z"))
    return t.select("topic", "rank", F.col("z.termIndices").cast("long").alias("term_index"), F.col("z.termWeights").alias("weight")).join(vocab.select("term", "term_index"), "term_index").select("topic", "rank", "term", "weight")


def l2_normalised(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double"))))


def pivoted(features: DataFrame, vocab: DataFrame, value: str = "count") -> DataFrame:
    """(row_id, vector): long features as one dense array a row, in the order of term_index; the vocabulary is of bounded size."""
    size = vocab.agg(F.count("*").cast("int")).scalar()
    cells = features.select("row_id", "term", value).join(vocab.select("term", "term_index"), "term").groupBy("row_id")
    cells = cells.agg(F.map_from_entries(F.collect_list(F.struct("term_index", F.col(value).cast("double").alias("x")))).alias("m"))
    cells = cells.withColumn("size", size.cast("long"))
    return cells.select("row_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def neighbours(vectors: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(row_id, neighbour_id, score, rank): the k nearest other rows of every row by cosine."""
    from docspark.operators.retrieval import vector_topk

    got = vector_topk(vectors.select(F.col(id_col).alias("query_id"), F.col(column).alias("v")), vectors.select(F.col(id_col).alias("row_id"), F.col(column).alias("v")), k, exclude_self=True)
    return got.select(F.col("query_id").alias("row_id"), F.col("row_id").alias("neighbour_id"), "score", "rank")


def scored_predictions(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """predicted(row_id, label, ...) with whether it equals expected(row_id, label); null where nothing is expected."""
    e = expected.select(F.col("row_id").alias("__id"), F.col("label").alias("__label"))
    return predicted.join(e, F.col("row_id") == F.col("__id"), "left").withColumn("correct", F.col("label") == F.col("__label")).drop("__id", "__label")
