"""Named data-quality tests. Each returns a one-row plan (test, failures, measure)."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.plans.storage import written


def _row(df: DataFrame, test: str, failures: Column, measure: Column | None = None) -> DataFrame:
    """One row: failures (bigint) and measure (double, rounded)."""
    return df.agg(failures.cast("long").alias("failures"), F.round((failures if measure is None else measure).cast("double"), 6).alias("measure")).select(F.lit(test).alias("test"), "failures", "measure")


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


def _bounded(test: str, df: DataFrame, value: Column, least: float | None, most: float | None) -> DataFrame:
    low = F.lit(False) if least is None else value < least
    high = F.lit(False) if most is None else value > most
    return _row(df, test, F.when(F.coalesce(low | high, F.lit(False)), 1).otherwise(0), value)


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return _row(df, "not_null", reduce(lambda a, b: a + b, (_count(F.col(c).isNull()) for c in columns)))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of more than one row; nulls are a value."""
    return _row(df.groupBy(*columns).agg(F.count("*").alias("n")), "unique", _count(F.col("n") > 1))


def min_rows(df: DataFrame, n: int = 1) -> DataFrame:
    return _row(df, "min_rows", F.when(F.count("*") < n, 1).otherwise(0), F.count("*"))


def custom(df: DataFrame, test: Callable[[DataFrame], Column], name: str = "python") -> DataFrame:
    """A test given as a function from a DataFrame to a condition that marks failing rows."""
    return _row(df, name, _count(test(df)))


def matches_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return _row(df, "matches_regex", _count(~F.col(column).rlike(pattern)))


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return _row(df, "accepted_values", _count(~F.col(column).isin(*values)))


def accepted_range(df: DataFrame, column: str, least: float | None = None, most: float | None = None) -> DataFrame:
    low = F.lit(False) if least is None else F.col(column) < least
    return _row(df, "accepted_range", _count(low | (F.lit(False) if most is None else F.col(column) > most)))


def min_metric(metrics: DataFrame, name: str, least: float, label: str | None = None) -> DataFrame:
    """The value of a metric (of a label) at its latest evaluated_at."""
    m = metrics.where((F.col("metric") == name) & (F.lit(True) if label is None else F.col("label") == label))
    value = F.max_by("value", "evaluated_at")
    return _row(m, "min_metric", F.when(F.coalesce(value >= least, F.lit(False)), 0).otherwise(1), value)


def null_rate(df: DataFrame, column: str, most: float) -> DataFrame:
    rate = F.coalesce(F.avg(F.col(column).isNull().cast("int")), F.lit(0.0))
    return _row(df, "null_rate", F.when(rate > most, 1).otherwise(0), rate)


def grounded_in(df: DataFrame, column: str, source: str) -> DataFrame:
    """Values, without blanks around them, that the source text does not contain, whatever the case; nulls and blank values pass."""
    value = F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
    return _row(df, "grounded_in", _count((value != "") & ~F.contains(F.lower(source), value)))


def fuzzy_grounded(least: float = 0.85):
    """Column function (value, source) -> whether some window of the source of the value's length is similar enough."""
    @F.pandas_udf("boolean")
    def near(value: pd.Series, source: pd.Series) -> pd.Series:
        def one(v, s):
            if v is None or s is None:
                return None
            v, s = v.lower(), s.lower()
            if v in s:
                return True
            match = difflib.SequenceMatcher(None, "", v, autojunk=False)
            for i in range(0, max(1, len(s) - len(v) + 1), max(1, len(v) // 4)):
                match.set_seq1(s[i : i + len(v)])
                if match.quick_ratio() >= least and match.ratio() >= least:
                    return True
            return False

        return pd.Series([one(v, s) for v, s in zip(value, source, strict=True)])

    return near


def relationships(child: DataFrame, column: str, parent: DataFrame, to: str) -> DataFrame:
    orphans = child.where(F.col(column).isNotNull()).join(parent.select(F.col(to).alias(column)).where(F.col(column).isNotNull()), column, "left_anti")
    return _row(orphans, "relationships", F.count("*"))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def embedding_valid(df: DataFrame, column: str, dim: int | None = None, least_norm: float | None = None, most_norm: float | None = None, most_zero: float = 0.0) -> DataFrame:
    """Vectors of a wrong dimension, with entries that aren't finite, or with a norm out of bounds; and zero vectors, if their share is above
    `most_zero`. Null vectors are skipped."""
    v = F.col(column)
    wrong = F.lit(False) if dim is None else F.size(v) != dim
    wrong = wrong | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low = F.lit(False) if least_norm is None else F.col("norm") < least_norm
    high = F.lit(False) if most_norm is None else F.col("norm") > most_norm
    d = df.where(v.isNotNull()).select(wrong.alias("wrong"), _norm(v).alias("norm"))
    bad, zero = F.col("wrong") | low | high, ~F.col("wrong") & (F.col("norm") == 0)
    zeros = F.when(_count(zero) > most_zero * F.count("*"), _count(zero & ~bad)).otherwise(0)
    return _row(d, "embedding_valid", _count(bad) + zeros)


def _vectors(df: DataFrame, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.where(F.col(column).isNotNull()).select(array_to_vector(column).alias("v"))


def embedding_variance(df: DataFrame, column: str, least: float) -> DataFrame:
    """The mean population variance of the dimensions, summed up row by row."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    s = _vectors(df, column).agg(vector_to_array(Summarizer.variance(F.col("v"))).alias("v"), F.count("*").alias("n"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v") * (F.col("n") - 1) / F.col("n")
    return _bounded("embedding_variance", s.select(mean.alias("mean")), F.max("mean"), least, None)


def embedding_duplicates(df: DataFrame, column: str, most: float) -> DataFrame:
    g = df.groupBy(column).agg(F.count("*").alias("n"))
    return _bounded("embedding_duplicates", g, F.sum(F.col("n") - 1) / F.sum("n"), None, most)


def embedding_outliers(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """Rows farther from the centroid than the mean distance plus z standard deviations."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    center = _vectors(df, column).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("c")).scalar()
    apart = F.aggregate(F.zip_with(column, "c", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    dist = df.where(F.col(column).isNotNull()).withColumn("c", center).select(F.sqrt(apart).alias("d"))
    limit = dist.agg(F.avg("d") + z * F.stddev_pop("d")).scalar()
    return _row(dist.withColumn("limit", limit), "embedding_outliers", _count(F.col("d") > F.col("limit")))


_STATS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "stddev": F.stddev_pop, "median": lambda c: F.percentile(c, F.lit(0.5))}


def column_stat(df: DataFrame, column: str, stat: str, least: float | None = None, most: float | None = None, q: float = 0.5) -> DataFrame:
    value = F.percentile(column, F.lit(q)) if stat == "quantile" else _STATS[stat](F.col(column))
    return _bounded("column_stat", df, value.cast("double"), least, most)


def cardinality(df: DataFrame, column: str, least: float | None = None, most: float | None = None, ratio: bool = False) -> DataFrame:
    """Distinct values that aren't null; with `ratio`, divided by all rows."""
    n = F.countDistinct(column)
    return _bounded("cardinality", df, (n / F.count("*") if ratio else n).cast("double"), least, most)


def outlier_rate(df: DataFrame, column: str, most: float, method: str = "iqr", k: float | None = None) -> DataFrame:
    """Share of values outside the quartiles by k ranges (iqr, k = 1.5) or k standard deviations from the mean (zscore, k = 3). Fewer than 4 values pass."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    if method == "iqr":
        k = 1.5 if k is None else k
        q = v.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select(F.struct((F.col("q")[0] - k * (F.col("q")[1] - F.col("q")[0])).alias("lo"), (F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("hi")))
    else:
        k = 3.0 if k is None else k
        q = v.agg(F.struct((F.avg("v") - k * F.stddev_pop("v")).alias("lo"), (F.avg("v") + k * F.stddev_pop("v")).alias("hi")))
    d = v.withColumn("b", q.scalar())
    rate = F.when(F.count("*") >= 4, F.avg(((F.col("v") < F.col("b.lo")) | (F.col("v") > F.col("b.hi"))).cast("int"))).otherwise(0.0)
    return _bounded("outlier_rate", d, rate, None, most)


def _shares(df: DataFrame, bin_: Column, name: str) -> DataFrame:
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias(name))


def drift(baseline: DataFrame, current: DataFrame, column: str, method: str, most: float, bins: int = 10, numeric: bool = True) -> DataFrame:
    """psi, js (bits) and chi2 over bins at the baseline's quantiles (or categories), ks over the values."""
    b, c = (d.where(F.col(column).isNotNull()).select(F.col(column).alias("v")) for d in (baseline, current))
    if method == "ks":
        both = b.select(F.col("v").cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(c.select(F.col("v").cast("double"), F.lit(0), F.lit(1)))
        g = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        # Ranges of values are summed up, the sums of the ranges (one row a partition) in order, then values inside each range.
        g = written(g.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
        parts = g.groupBy("part").agg(F.sum("x").alias("px"), F.sum("y").alias("py"))
        every, before = Window.partitionBy(), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        parts = parts.select("part", ahead("px").alias("ax"), ahead("py").alias("ay"), F.sum("px").over(every).alias("tx"), F.sum("py").over(every).alias("ty"))
        w = Window.partitionBy("part").orderBy("v")
        gap = g.join(F.broadcast(parts), "part").select(F.abs((F.col("ax") + F.sum("x").over(w)) / F.col("tx") - (F.col("ay") + F.sum("y").over(w)) / F.col("ty")).alias("d"))
        return _bounded("drift_ks", gap, F.max("d"), None, most)
    if numeric:
        edges = [float(x) for x in b.agg(F.percentile(F.col("v").cast("double"), F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("e")).first().e or []]
        edges = sorted(set(edges))
        if len(edges) == 1:  # constant baseline: below, at, above
            place = F.when(F.col("v") < edges[0], 0).when(F.col("v") > edges[0], 2).otherwise(1)
            labels = [0, 1, 2]
        else:
            place = reduce(lambda a, e: a + (F.col("v") > e).cast("int"), edges, F.lit(0))
            labels = list(range(len(edges) + 1))
        frame = baseline.sparkSession.createDataFrame([(i,) for i in labels], "bin int")
        j = frame.join(_shares(b, place, "nb"), "bin", "left").join(_shares(c, place, "nc"), "bin", "left").fillna(0)
    else:
        j = _shares(b, F.col("v"), "nb").join(_shares(c, F.col("v"), "nc"), "bin", "full").fillna(0, ["nb", "nc"])
    every = Window.partitionBy()
    j = j.withColumn("tb", F.sum("nb").over(every)).withColumn("tc", F.sum("nc").over(every)).withColumn("p", F.col("nb") / F.col("tb")).withColumn("q", F.col("nc") / F.col("tc"))
    if method == "psi":
        value = F.sum((F.col("q") - F.col("p")) * F.log((F.col("q") + 1e-6) / (F.col("p") + 1e-6)))
    elif method == "js":
        m = (F.col("p") + F.col("q")) / 2
        half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
        value = F.sum((half("p") + half("q")) / 2)
    else:
        value = F.max("tc") * F.sum((F.col("q") - F.col("p")) ** 2 / (F.col("p") + 1e-12))  # a new category fails hard
    return _bounded(f"drift_{method}", j, value, None, most)


def golden(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Rows of either side that the other lacks or that differ by more than the tolerance."""
    a, e = actual.withColumn("__a", F.lit(1)), expected.withColumn("__e", F.lit(1))
    j = a.join(e.select(*keys, "__e", *(F.col(c).alias(f"__{c}") for c in columns)), keys, "full")

    def differs(c: str) -> Column:
        x, y = F.col(c), F.col(f"__{c}")
        if dict(actual.dtypes)[c] in ("double", "float", "int", "bigint"):
            return ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    wrong = reduce(lambda x, y: x | y, (differs(c) for c in columns), F.col("__a").isNull() | F.col("__e").isNull())
    return _row(j, "golden", _count(wrong), F.count("*"))


def judged(df: DataFrame, judge: Callable[[Column], Column], column: str, least: float, sample: int, seed: int = 7) -> DataFrame:
    """Pass rate of a judge over a seeded sample of rows (a sampling test: its size is the feature)."""
    s = df.orderBy(F.xxhash64(column, F.lit(seed)), column).limit(sample)
    return _bounded("llm_judge", s, F.coalesce(F.avg(judge(F.col(column)).cast("int")), F.lit(1.0)), least, None)


def with_severity(results: DataFrame, severity: str = "error") -> DataFrame:
    return results.withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("warn" if severity == "warn" else "fail"))


def report(tests: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tests)


def enum_tests(fields: dict[str, list[str]], explicit: dict[str, list[str]]) -> tuple[dict[str, list[str]], list[str]]:
    """Accepted values that enum fields imply, and the fields whose explicit list differs."""
    return {k: v for k, v in fields.items() if k not in explicit}, sorted(k for k, v in fields.items() if k in explicit and set(v) != set(explicit[k]))
