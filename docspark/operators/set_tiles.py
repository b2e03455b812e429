"""Exact set similarity inside groups of texts, dealt into tiles of bounded size.

A group is whatever a caller brought together. Its members are dealt by hash into parts of about TILE
shingles, and a tile holds two parts, so that no task gathers a group, whatever its size; a text is sent once to
each tile that reads it, not with each pair. A tile returns links that connect what its
pairs connect: at most one a member, never all pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.hashing import bits_for, bitmap_of, doc_word_hashes, in_bitmap, shingle_set
from docspark.plans.storage import written

#: Shingles of a part.
TILE = 1 << 19


def node_of(s: np.ndarray) -> int:
    """The key of a set: equal sets have equal keys."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m elements that link: ceil(p (n + m) / (100 + p))."""
    return -(-percent * (n + m) // (100 + percent))


class Scan:
    """Overlaps with a query set by looking up the elements of all open members in it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])

    def linked(self, q: int, open_: np.ndarray, percent: int) -> list[int]:
        query, n = self.sets[q], len(self.sets[q])
        out = []
        for m in np.flatnonzero(open_).tolist():
            at = np.searchsorted(query, self.sets[m])
            at[at == n] = 0
            if int((query[at] == self.sets[m]).sum()) >= needed(n, int(self.sizes[m]), percent):
                out.append(m)
        return out


def forest(sets: list[np.ndarray], labels: list[int], asks: list[bool], percent: int, index_of: Callable = Scan) -> list[tuple[int, int]]:
    """Links (positions) that connect every two sets that link and have different labels; equal labels are connected already.

    If some sets ask, only they are compared with the others; else every two sets of different labels are.
    """
    label = np.unique(np.array(labels), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    count = np.bincount(label)
    if any(asks):
        order = [i for i, x in enumerate(asks) if x]
    else:
        order = np.flatnonzero(label != count.argmax()).tolist()
        order.sort(key=lambda i: (-count[label[i]], -sizes[i]))
    if not order:
        return []
    index = index_of(sets)
    reached, done, links = label.copy(), np.zeros(len(sets), bool), []
    for q in order:
        open_ = (reached != reached[q]) & ~done & (100 * np.minimum(sizes, sizes[q]) >= percent * np.maximum(sizes, sizes[q]))
        done[q] = True
        if not open_.any():
            continue
        for m in index.linked(q, open_, percent):
            if reached[m] != reached[q]:
                links.append((q, m))
                reached[reached == reached[m]] = reached[q]
    return links


def packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed): the compressed text of each row of wanted(node, least_id) from docs(doc_id, text).

    A bitmap of the wanted ids, sized by their number and 32 MB at most, keeps other texts out of the shuffle.
    """
    wanted = written(wanted.distinct(), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "least_id", bits_for(wanted.count())))

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for pdf in batches:
            pdf = pdf[in_bitmap(pdf["doc_id"].to_numpy(np.int64), bits)]
            data = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in pdf["text"].tolist()]
            yield pd.DataFrame({"least_id": pdf["doc_id"].to_numpy(), "packed": pd.Series(data, dtype=object)})

    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "least_id long, packed binary").join(wanted, "least_id").select("node", "packed")


def dealt(members: DataFrame) -> DataFrame:
    """members(group, node, n, label, asks) with the tiles (i, j) that read each: a group of `parts` parts has a
    member in `parts` tiles. A group in which some ask has the asking ones in every part, and one tile a part."""
    parts = members.groupBy("group").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("parts"), F.max("asks").alias("some"))
    d = members.join(parts, "group").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    d = d.withColumn("q", F.explode(F.when(F.col("some") & ~F.col("asks"), F.array("p")).otherwise(every)))
    return d.select("group", F.when(F.col("some"), F.col("q")).otherwise(F.least("p", "q")).alias("i"), F.when(F.col("some"), F.col("q")).otherwise(F.greatest("p", "q")).alias("j"), "node", "label", "asks")


def linked(members: DataFrame, texts: DataFrame, k: int, percent: int, index_of: Callable = Scan) -> DataFrame:
    """(a, b): links that connect the members(group, node, n, label, asks) of each group; texts: (node, packed)."""

    def run(batches):
        tile, nodes, sets, labels, asks = None, [], [], [], []

        def flush():
            found = forest(sets, labels, asks, percent, index_of) if len(sets) > 1 else []
            return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[i] for _, i in found]}, dtype="int64")

        for pdf in batches:
            words = doc_word_hashes(zlib.decompress(x).decode("utf-8", "surrogatepass") for x in pdf["packed"].tolist())
            for group, i, j, node, label, ask, w in zip(*(pdf[c].tolist() for c in ("group", "i", "j", "node", "label", "asks")), words, strict=True):
                if (group, i, j) != tile:
                    if len(sets) > 1:
                        yield flush()
                    tile, nodes, sets, labels, asks = (group, i, j), [], [], [], []
                s = shingle_set(w, k)
                if node_of(s) == node and not (nodes and nodes[-1] == node):  # else another text under the same id, or the same again
                    nodes.append(node)
                    sets.append(s)
                    labels.append(label)
                    asks.append(ask)
        yield flush()

    tile = ["group", "i", "j"]
    return dealt(members).join(texts, "node").repartition(*tile).sortWithinPartitions(*tile, "node").mapInPandas(run, "a long, b long")
