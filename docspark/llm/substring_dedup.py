"""Substring dedup by content-defined chunking (operator 5).

A gear hash rolls over the bytes of each text; a cut falls where its value is small. It depends on the last
16 bytes alone, so an insertion moves cuts only next to it. Every cut starts a chunk, which ends at the first cut at
least `least` bytes on, or after MOST bytes; both ends depend on the content, so equal passages hold equal chunks wherever
they stand. A text of fewer than `least` bytes is one chunk. Chunks are counted by digest (96 bits) with partial
aggregation; those found in two or more documents are joined back, and overlapping ones are merged into spans.

A third of all rows may share a chunk: counting combines on the map side, and the join back has one row a
digest on its small side, so Spark can split the other. A bitmap, sized by the repeated digests and 32 MB at most, keeps
most unrepeated chunks out of that join. Long texts are read in pieces of SLAB bytes that overlap by a longest chunk.

Null ids and null or empty texts give no rows. Rows of one id are one document: what only they
share is not repeated; copies of one text all have it as a span. Spans are byte offsets into the UTF-8 text. Other columns
are ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.hashing import BYTE, bitmap_of, bits_for, in_bitmap, mix, power_tables
from docspark.plans.storage import written

from .common import column

_U = np.uint64
#: Least and longest length of a chunk in bytes.
LEAST, MOST = 96, 4096
#: Mean distance of cuts in bytes.
MEAN = 16
_GEAR = (mix(np.arange(256, dtype=_U) + _U(5)) & _U(0xFFFF)).astype(np.uint16)
_GEAR[0] = 0
_REACH = 16
_SLAB = 2 << 20


def gear(raw: np.ndarray) -> np.ndarray:
    """16-bit gear hash at every byte: sum of gear[b[i - k]] << k over the last 16 bytes."""
    h = _GEAR[raw]
    for w in (1, 2, 4, 8):
        h[w:] += h[:-w] << w
    return h


def pieces(i: int, data: bytes, slab: int, most: int):
    """(text, offset, bytes, first start, end of starts) of the overlapping pieces of a text."""
    for at in range(0, len(data), slab):
        offset = max(0, at - _REACH)
        yield i, offset, data[offset : at + slab + most], at, min(len(data), at + slab)


def chunks(parts: list[tuple[int, int, bytes, int, int]], sizes: list[int], least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, ...]:
    """(text, start, end, digest, check) of every chunk that starts in the pieces of texts of the given sizes."""
    data = np.frombuffer(bytes(_REACH).join([*(p[2] for p in parts), b""]), np.uint8)
    if not len(data):
        return (np.empty(0, np.int64),) * 5
    lengths = np.array([len(p[2]) for p in parts], np.int64)
    text, offset, lo, hi = (np.array(x, np.int64) for x in zip(*((p[0], p[1], p[3], p[4]) for p in parts), strict=True))
    begin = np.concatenate([[0], np.cumsum(lengths + _REACH)[:-1]])
    shift = offset - begin
    total = np.array(sizes, np.int64)[text]
    cut = np.flatnonzero(gear(data) < 65536 // MEAN) + 1
    owner = np.searchsorted(begin, cut - 1, "right") - 1
    inside = cut <= (begin + lengths)[owner]
    cut, owner = cut[inside], owner[inside]
    # Texts begin and end with a cut.
    first, last = np.flatnonzero(offset == 0), np.flatnonzero(offset + lengths == total)
    cut = np.concatenate([cut, begin[first], (begin + lengths)[last]])
    owner = np.concatenate([owner, first, last])
    order = np.lexsort((cut, owner))
    cut, owner = cut[order], owner[order]
    new = np.ones(len(cut), bool)
    new[1:] = (cut[1:] != cut[:-1]) | (owner[1:] != owner[:-1])
    cut, owner = cut[new], owner[new]
    to = np.minimum(np.searchsorted(cut, cut + least), len(cut) - 1)
    # The first cut that is far enough on; after MOST bytes, or where the piece holds none, the chunk ends anyway.
    end = np.where((cut[to] >= cut + least) & (owner[to] == owner), cut[to], cut + most)
    end = np.minimum(end, cut + most)
    at = cut + shift[owner]
    short = (total[owner] < least) & (at == 0)
    end = np.where(short, cut + total[owner], end)
    ok = (at >= lo[owner]) & (at < hi[owner]) & (end <= (begin + lengths)[owner]) & ((end - cut >= least) | short)
    start, end, owner = cut[ok], end[ok], owner[ok]
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE[data] * up[: len(data)], dtype=_U, out=sums[1:])
    one = (sums[end] - sums[start]) * down[start]
    np.cumsum(BYTE[data ^ np.uint8(0xA5)] * up[: len(data)], dtype=_U, out=sums[1:])
    two = mix((sums[end] - sums[start]) * down[start])
    digest = mix(one + (end - start).astype(_U)).view(np.int64)
    return text[owner], start + shift[owner], end + shift[owner], digest, (two >> _U(33)).astype(np.int64)


def chunk_rows(docs: DataFrame, bitmap: bytes | None = None, least: int = LEAST, slab: int = _SLAB) -> DataFrame:
    """(doc_id, start, end, digest, check); with a bitmap, only chunks whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches):
        bits = None if shared is None else np.frombuffer(shared.value, np.uint8)

        def made(ids: list[int], parts: list, sizes: list[int]):
            owner, start, end, digest, check = chunks(parts, sizes, least)
            if bits is not None:
                keep = in_bitmap(digest, bits)
                owner, start, end, digest, check = (x[keep] for x in (owner, start, end, digest, check))
            for at in range(0, len(owner), 200_000):
                part = slice(at, at + 200_000)
                yield pd.DataFrame({"doc_id": np.array(ids, np.int64)[owner[part]], "start": start[part], "end": end[part], "digest": digest[part], "check": check[part].astype(np.int32)})

        for pdf in batches:
            ids, parts, sizes, held = [], [], [], 0
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                data = t.encode("utf-8", "replace")
                ids.append(i)
                sizes.append(len(data))
                for piece in pieces(len(ids) - 1, data, slab, MOST):
                    parts.append(piece)
                    held += len(piece[2])
                    if held >= slab:
                        yield from made(ids, parts, sizes)
                        parts, held = [], 0
            if parts:
                yield from made(ids, parts, sizes)

    d = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).where("doc_id is not null and text <> ''")
    return d.mapInPandas(run, "doc_id long, start long, end long, digest long, check int")


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end): the merged spans of each document that also stand in another one."""
    seen = chunk_rows(docs, None, least).groupBy("digest", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    twice = written(seen.select("digest", "check"), "digests")
    of = chunk_rows(docs, bitmap_of(twice, "digest", bits_for(twice.count())), least).join(twice, ["digest", "check"]).select("doc_id", "start", "end").distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    fresh = F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    numbered = of.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")


def substring_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_spans, repeated_bytes, longest, spans) of the documents that repeat something."""
    return repeated(docs, least).groupBy("doc_id").agg(
        F.count("*").alias("n_spans"),
        F.sum(F.col("end") - F.col("start")).alias("repeated_bytes"),
        F.max(F.col("end") - F.col("start")).alias("longest"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
