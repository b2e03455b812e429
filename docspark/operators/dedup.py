"""Exact and near-duplicate groups of texts."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.hashing import doc_word_hashes, mix, shingle_set
from docspark.operators.components import components
from docspark.operators.set_tiles import linked, node_of, packed
from docspark.plans.storage import written

#: Permutations of a signature, and its bands: two sets of similarity 0.8 share a band in all but 5 of 100,000 cases.
PERMUTATIONS, BANDS, ROWS = 128, 25, 5
_U = np.uint64
_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, duplicate_group): the least id with the same text; null where there is no other."""
    h = docs.select(id_col, F.sha2(text_col, 256).alias("h"))
    g = h.groupBy("h").agg(F.min(id_col).alias("g"), F.count("*").alias("n")).where("n > 1").select("h", "g")
    return h.join(g, "h", "left").select(id_col, F.col("g").alias("duplicate_group"))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, (sets, PERMUTATIONS): all sets at once, a permutation at a time."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(mix(flat * f), starts) for f in _FACTORS], 1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of the bands of signatures."""
    key = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(signature), BANDS))
    for r in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + signature[:, r : BANDS * ROWS : ROWS])
    return key.view(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, duplicate_group): texts link whose sets of k-word shingles have a Jaccard similarity of at least
    `threshold`, in whole percent; groups are the connected components of all links, under their least id.

    MinHash bands bring candidates together, and exact set similarity in tiles verifies them: first equal sets become one
    class, then classes that share a band are searched against each other. Every row comes back, once for each time it came in;
    those alike to no other have a null group. Rows without id, and texts without words, are alike to none.
    """
    percent = 100 * Fraction(str(threshold))
    if percent.denominator != 1 or not 0 < percent <= 100:
        raise ValueError(f"threshold must be in whole percent above 0 and at most 1: {threshold}")
    kind = docs.schema[id_col].dataType
    key = F.col(id_col).cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    d = docs.select(key.alias("doc_id"), F.col(id_col).alias("id"), F.lower(text_col).alias("text"))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # signatures of a few texts at once bound what is held
                part = pdf.iloc[at : at + 256]
                sets = [shingle_set(w, k) for w in doc_word_hashes(part["text"].tolist())]
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    keys = band_keys(signatures([sets[i] for i in some])).tolist()
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(np.int64)[some], "node": [node_of(sets[i]) for i in some], "n": [len(sets[i]) for i in some], "bands": keys})

    known = written(d.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id long, node long, n long, bands array<long>"), "signatures")
    classes = known.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    lists = classes.select("node", F.explode("bands").alias("band"))
    first = lists.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
    group = components(lists.join(first, "band").select("a", F.col("node").alias("b")).distinct())
    members = group.join(classes.select("node", "n"), "node").select(F.col("component").alias("group"), "node", "n", F.col("node").alias("label"), F.lit(False).alias("asks"))
    members = written(members, "members")
    texts = packed(d, members.select("node").join(classes.select("node", "least_id"), "node"))
    same = known.select("doc_id", "node").distinct()
    # Rows of equal sets are linked through their class, classes through the links found.
    links = linked(members, texts, k, int(percent)) if percent < 100 else members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    reach = components(links.select("a", "b")).select("node", "component")
    of = same.join(reach, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    named = d.select("doc_id", "id").distinct().join(of, "doc_id")
    least = named.groupBy("component").agg(F.min("id").alias("duplicate_group"), F.count_distinct("id").alias("c")).where("c > 1").drop("c")
    found = named.join(least, "component").groupBy("id").agg(F.min("duplicate_group").alias("duplicate_group"))
    return docs.select(F.col(id_col)).join(found.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left").select(id_col, "duplicate_group")
