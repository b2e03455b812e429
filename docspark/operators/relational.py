"""Typed predicates, as-of filters, intervals, cursors and change detection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}


def predicate(parts: list[tuple[str, str, object]]) -> Column:
    """AND of (column, op, value); op is eq ne lt le gt ge in not_in is_null is_not_null or contains."""

    def one(column: str, op: str, value: object) -> Column:
        c = F.col(column)
        if op in ("in", "not_in"):
            if not value or len({type(v) for v in value}) > 1:
                raise ValueError("a list of one type is needed")
            return c.isin(*value) if op == "in" else ~c.isin(*value)
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError("numbers must be finite")
        if op == "is_null":
            return c.isNull()
        if op == "is_not_null":
            return c.isNotNull()
        if op == "contains":
            return F.array_contains(c, value)
        return getattr(c, _OPS[op])(F.lit(value))

    return reduce(lambda a, b: a & b, (one(*p) for p in parts), F.lit(True))


def active_as_of(df: DataFrame, valid_at, recorded_at, unknown: bool = False) -> DataFrame:
    """Rows valid and recorded at the given times; intervals are half-open, null ends are open."""
    v, r = F.lit(valid_at), F.lit(recorded_at)
    start = (F.col("valid_from") <= v) | (F.col("valid_from").isNull() if unknown else F.lit(False))
    valid = start & (F.col("valid_to").isNull() | (v < F.col("valid_to")))
    return df.where(valid & (F.col("recorded_from") <= r) & (F.col("recorded_to").isNull() | (r < F.col("recorded_to"))))


def overlapping(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows whose interval begins before the one before it (of the same key) ends; an open interval must be last."""
    w = Window.partitionBy(key).orderBy(start, F.col(end).asc_nulls_last())
    first = F.row_number().over(w) == 1
    return df.withColumn("__first", first).withColumn("__end", F.lag(end).over(w)).where(~F.col("__first") & (F.col("__end").isNull() | (F.col("__end") > F.col(start)))).drop("__first", "__end")


def page_after(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next `limit` rows in the order of the keys."""
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, after, strict=True))))
    return df.orderBy(*keys).limit(limit)


def changed(columns: list[str], left: str = "l", right: str = "r") -> Column:
    """Null-safe: whether any column differs."""
    return ~reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def check_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows with a null key, and rows beyond the first of their key."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(~null, F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"))


def publishable(now) -> Column:
    """Fail closed: status active, some access group, and not past expires_at."""
    ok = (F.col("status") == "active") & (F.size("access_groups") > 0) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    return F.coalesce(ok, F.lit(False))


def freshness(at: Column, now: Column, warn_hours: float, error_hours: float) -> Column:
    age = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 3600
    return F.when(at.isNull(), "unknown").when(age > error_hours, "error").when(age > warn_hours, "warn").otherwise("pass")


def match_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row (matched, left_only, right_only) of the keys of two tables; repeated keys on either side are an error when the plan runs."""
    once = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    j = once(left, "__l").join(once(right, "__r"), keys, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    several = F.greatest(F.max(F.coalesce("__l", F.lit(0))), F.max(F.coalesce("__r", F.lit(0)))) > 1
    out = j.agg(n(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("matched"), n(F.col("__r").isNull()).alias("left_only"), n(F.col("__l").isNull()).alias("right_only"), several.alias("__several"))
    return out.select(F.when(F.col("__several"), F.raise_error(F.lit("repeated keys")).cast("long")).otherwise(F.col("matched")).alias("matched"), "left_only", "right_only")


def enriched(hits: DataFrame, rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """hits(id, ...) with columns of the rows they point at; hits without a row stay, with nulls."""
    r = rows.select(F.col(id_col).alias("__id"), *columns)
    return hits.join(r, F.col("id") == F.col("__id"), "left").drop("__id")


def scalar_text(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON text and other columns as they are."""
    nested = ("array", "map", "struct")
    return df.select(*(F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in df.dtypes))
