"""State-based incremental runs: classify, remove, upsert, replace children, widen schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def classify(current: DataFrame, state: DataFrame, key: str = "record_key") -> DataFrame:
    """current and state (record_key, input_fingerprint, code_version) -> current with status new, changed or unchanged."""
    s = state.select(F.col(key).alias("__k"), F.col("input_fingerprint").alias("__f"), F.col("code_version").alias("__v"))
    same = F.col("input_fingerprint").eqNullSafe(F.col("__f")) & F.col("code_version").eqNullSafe(F.col("__v"))
    return current.join(s, F.col(key) == F.col("__k"), "left").withColumn("status", F.when(F.col("__k").isNull(), "new").when(same, "unchanged").otherwise("changed")).drop("__k", "__f", "__v")


def removed(current: DataFrame, state: DataFrame, key: str = "record_key") -> DataFrame:
    return state.join(current.select(key), key, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], when_changed: list[str] | None = None) -> DataFrame:
    """target with rows of the same keys replaced; with `when_changed`, only rows that differ in these columns replace."""
    if when_changed:
        old = target.select(*keys, *(F.col(c).alias(f"__{c}") for c in when_changed), F.lit(1).alias("__old"))
        same = F.col("__old").isNotNull() & reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in when_changed))
        rows = rows.join(old, keys, "left").where(~same).select(rows.columns)
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_children(children: DataFrame, fresh: DataFrame, changed_parents: DataFrame, parent: str) -> DataFrame:
    """Children of changed or removed parents give way to the fresh ones."""
    return children.join(changed_parents.select(parent).distinct(), parent, "left_anti").unionByName(fresh, allowMissingColumns=True)


def plan_schema(target: list[tuple[str, str]], rows: list[tuple[str, str]], policy: str = "fail") -> list[str]:
    """Columns to add under on_schema_change fail, ignore or append_new_columns; raises where the policy forbids a change."""
    have, come = dict(target), dict(rows)
    added = [c for c in come if c not in have]
    clash = [c for c in come if c in have and come[c] != have[c]]
    if clash or policy == "fail" and (added or set(have) - set(come)):
        raise ValueError(f"schema changed: added {added}, types {clash}, missing {sorted(set(have) - set(come))}")
    return added if policy == "append_new_columns" else []


def removed_rows(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """target without the rows of the given keys."""
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def reuse_vectors(rows: DataFrame, known: DataFrame, embed) -> DataFrame:
    """rows(id, text_hash, config_hash, text): vectors of unchanged rows are joined in, the others are embedded."""
    keys = ["id", "text_hash", "config_hash"]
    old = rows.join(known.select(*keys, "embedding"), keys)
    new = rows.join(known.select(*keys), keys, "left_anti").withColumn("embedding", embed(F.col("text")))
    return old.unionByName(new)


def merge_counts(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row (inserted, updated) of what an upsert of rows into target would do."""
    known = target.select(*keys).distinct().withColumn("__known", F.lit(1))
    return rows.join(known, keys, "left").agg(F.sum(F.col("__known").isNull().cast("long")).alias("inserted"), F.sum(F.col("__known").isNotNull().cast("long")).alias("updated"))


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log with rows appended by name; new columns widen it, columns that rows lack are null, and a changed type is refused."""
    have = dict(log.dtypes)
    clash = sorted(c for c, kind in rows.dtypes if c in have and have[c] != kind)
    if clash:
        raise ValueError(f"a log keeps its types: {clash}")
    return log.unionByName(rows, allowMissingColumns=True)


def transform_children(parents: DataFrame, state: DataFrame, children: DataFrame, make, parent: str) -> tuple[DataFrame, DataFrame]:
    """(children, state) after a run: parents (record_key, input_fingerprint, code_version, ...) that are new or changed are made
    anew by `make`, the children of those and of removed parents give way, and the state names what the children come from."""
    todo = classify(parents, state).where("status <> 'unchanged'").drop("status")
    gone = removed(parents, state).select("record_key").union(todo.select("record_key")).select(F.col("record_key").alias(parent))
    kept = ["record_key", "input_fingerprint", "code_version"]
    return replace_children(children, make(todo), gone, parent), parents.select(*kept)
