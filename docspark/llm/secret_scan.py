"""Secret scans over an incremental blob ledger (operator 3).

Every version of a document is addressed by the SHA-256 of its text. The ledger holds one row for
each pair of blob and rule version that was scanned; only unseen pairs are
scanned, each blob once however many paths hold it, and findings are joined back to all paths.

Null texts are the empty blob. Rows with null ids are versions like others. Repeated
rows each come back. Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.plans.storage import written

from .common import column

#: Kind, pattern, capture group whose length counts, least length, whether it is a base kind.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    ("hex", r"[0-9a-f]{32,}", 0, 32, True),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, False),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36, False),
)
RULE_VERSION = "1"
LEDGER = "blob string, rule_version string, spans array<struct<start:int,kind:int,end:int>>"


def find_spans(blobs: DataFrame) -> DataFrame:
    """blobs(blob, text) -> the LEDGER columns but rule_version, for blobs with findings.

    Matches and the gaps between them alternate, so positions are running sums of lengths.
    """
    some = F.lit(False)
    for _, pattern, *_ in RULES:
        some = some | F.col("text").rlike(pattern)
    rows = F.array(*(
        F.struct(
            F.lit(i).alias("kind"),
            F.lit(least).alias("least"),
            F.arrays_zip(
                F.split("text", pattern, -1).alias("gap"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
            ).alias("parts"),
        )
        for i, (_, pattern, group, least, _) in enumerate(RULES)
    ))
    each = blobs.where(some).dropDuplicates(["blob"]).select("blob", F.explode(rows).alias("r")).select("blob", "r.kind", "r.least", F.posexplode("r.parts").alias("i", "p"))
    each = each.select("blob", "kind", "least", "i", F.length("p.gap").alias("gap"), F.length("p.hit").alias("hit"), F.length("p.value").alias("value"))
    order = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(order)
    each = each.withColumn("end", end.cast("int")).where("hit is not null and value >= least")
    return each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("hit")).alias("start"), "kind", "end"))).alias("spans"))


def joined(spans: Column, base: bool) -> Column:
    """kind:start:end of the spans by start, then kind, joined by commas."""
    names = F.array(*(F.lit(r[0]) for r in RULES))
    n_base = sum(r[4] for r in RULES)
    kept = F.filter(spans, lambda s: s["kind"] < n_base) if base else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of versions(doc_id, text, blob) that `ledger` lacks; returns its new rows."""
    todo = versions.groupBy("blob").agg(F.min("doc_id").alias("first"))
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    todo = todo.withColumnRenamed("blob", "unseen")
    # By id and blob: one blob may be most of the rows, but its rows are spread by id.
    chosen = versions.join(todo.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("unseen")))
    found = find_spans(chosen)
    return todo.select(F.col("unseen").alias("blob")).join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("spans"))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings by row of docs, new ledger rows)."""
    versions = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    versions = versions.withColumn("blob", F.sha2(F.col("text"), 256))
    paths = written(versions.select("doc_id", "blob"), "paths")
    new = written(update_ledger(versions, ledger, rule_version), "ledger")
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == rule_version))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = joined(F.col("spans"), True)
    out = paths.join(known.select("blob", "spans"), "blob").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans"), False).alias("spans"),
    )
    return out, new
