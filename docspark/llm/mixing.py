"""Mixing sources to target weights (operator 10).

Rows of one id, source and size are one entry with a count, so that no id, not even null, fills a range. Each entry gets a
hash-random key. Within its source, keys are cut into equal ranges of about RANGE entries, so no group holds a source whole; words
are added up by range, ranges are summed in order, and a window inside each range completes the prefix sum. Every source
is cut at its exact budget: whole epochs first, then the entries in key order, the last document in part. What a table of sources
needs to give their targets is one row a source, which one task reads.

Sizes of null texts are 0; texts may have any length. A null source is a source of its own, last in order. Null ids are
allowed. Repeated rows are separate documents one after another. Ties of keys go by id, then size. Other columns are ignored,
whatever their names. No rows give no rows; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.plans.storage import written

from .common import WORD, column

WEIGHTS = (3, 1, 2)
#: Entries in a range of keys, on average.
RANGE = 2_000


def budgets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources(source, source_size, n) with each source's weight and target; one row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    s = sources.withColumn("weight", w).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    # Sources are full in the order of their ratio; the level is the first that its own source holds.
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(up), F.lit(0))) / F.sum("weight").over(on))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", "n", F.least(most * F.col("source_size"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row."""
    d = docs.select(
        column(docs, "doc_id", "long").alias("doc_id"),
        column(docs, "source", "string").alias("source"),
        F.coalesce(F.regexp_count(column(docs, "text", "string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    d = d.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    d = written(d.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/" + seed)), 256).substr(1, 16)), "sizes")
    whole = F.col("size") * F.col("copies")
    sources = budgets(d.groupBy("source").agg(F.sum(whole).alias("source_size"), F.count("*").alias("n"))).withColumn("ranges", F.ceil(F.col("n") / RANGE))
    d = d.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "n")
    d = d.withColumn("range", F.floor(F.conv(F.col("key").substr(1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2.0**32)))
    sums = d.groupBy("source", "range").agg(F.sum(whole).alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("range").alias("in"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.col("base") + F.coalesce(F.sum(whole).over(within), F.lit(0)))
    budget = F.floor("target").cast("long")
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    left = budget - F.col("epochs") * F.col("source_size") - F.col("ahead") - F.col("copy") * F.col("size")
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken"))
