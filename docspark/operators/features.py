"""Features of documents from their entity and link rows, and checks of the identity that such rows carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _how_many(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def _onto(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row a document of `documents`; documents without rows get zeros."""
    return documents.select("document_id").join(found, "document_id", "left").fillna(0, found.columns[1:])


def pos_features(toks: DataFrame, documents: DataFrame, tags: list[str]) -> DataFrame:
    """Tokens of each part of speech (column pos) and their share of all tokens; null shares without tokens."""
    f = toks.groupBy("document_id").agg(F.count("*").alias("token_count"), *(_how_many(F.col("pos") == t).alias(f"pos_{t.lower()}_count") for t in tags))
    ratio = lambda t: F.when(F.col("token_count") > 0, F.round(F.col(f"pos_{t.lower()}_count") / F.col("token_count"), 9)).alias(f"pos_{t.lower()}_ratio")
    return _onto(documents, f).select("*", *(ratio(t) for t in tags))


def entity_features(entities: DataFrame, documents: DataFrame, labels: list[str]) -> DataFrame:
    """Entities of each document, in all and of each label."""
    f = entities.groupBy("document_id").agg(F.count("*").alias("entity_count"), *(_how_many(F.col("label") == x).alias(f"entity_{x.lower()}_count") for x in labels))
    return _onto(documents, f)


def link_features(links: DataFrame, documents: DataFrame, namespaces: list[str], statuses: list[str]) -> DataFrame:
    """Distinct canonical ids of each namespace, so an ambiguous mention counts each of its ids and an unmatched one none; and rows of each status."""
    ids = (F.count_distinct(F.when(F.col("entity_namespace") == n, F.col("canonical_id"))).alias(f"link_{n.lower()}_count") for n in namespaces)
    f = links.groupBy("document_id").agg(*ids, *(_how_many(F.col("status") == s).alias(f"link_{s.lower()}_count") for s in statuses))
    return _onto(documents, f)


def single_identity(rows: DataFrame, columns: list[str], id_col: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(one identity row a document, ids of documents whose rows disagree); nulls are a value."""
    parts = [F.struct(F.col(c).alias(c)) for c in columns]
    g = rows.groupBy(id_col).agg(*(F.min(p).getField(c).alias(c) for p, c in zip(parts, columns, strict=True)), reduce(lambda a, b: a | b, (F.count_distinct(p) > 1 for p in parts)).alias("__several"))
    return g.where("not __several").drop("__several"), g.where("__several").select(id_col)


def identity_mismatches(left: DataFrame, right: DataFrame, columns: list[str], id_col: str = "document_id") -> DataFrame:
    """Ids of documents whose identity differs between two tables of one identity row each."""
    r = right.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{c}") for c in columns))
    differs = reduce(lambda a, b: a | b, (F.col(c) != F.col(f"__{c}") for c in columns))
    return left.join(r, F.col(id_col) == F.col("__id")).where(differs).select(id_col)


def require_none(bad: DataFrame, message: str) -> None:
    """Raise if `bad` has rows, naming five of them at most."""
    some = sorted(str(r[0]) for r in bad.limit(5).collect())
    if some:
        raise ValueError(f"{message}: {some}")
