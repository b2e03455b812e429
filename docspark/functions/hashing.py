"""Hashes of words and shingles in numpy, and bitmaps over hashed columns."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text hashed at once; longer texts are cut at whitespace.
PIECE = 1 << 19

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)


def bitmap_of(df: DataFrame, name: str, bits: int) -> bytes:
    """The low bits of a bigint column as a bitmap of 2**bits bits: its size does not grow with the rows."""
    words = df.groupBy(F.shiftright(F.col(name).bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(`{name}` & 63 AS INT))")).alias("b"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for w, b in words.toLocalIterator():  # at most 2**(bits - 6) rows
        bitmap[w] = b
    return bitmap.tobytes()


def bits_for(rows: int, least: int = 16, most: int = 28) -> int:
    """log2 of the bits of a bitmap of which `rows` values set about a sixteenth; 32 MB at most."""
    return min(most, max(least, math.ceil(math.log2(16 * rows + 1))))


def in_bitmap(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the bit of each value is set in a bitmap (as bytes) of bitmap_of."""
    slot = values & (8 * len(bitmap) - 1)
    return (bitmap[slot >> 3] >> (slot & 7)) & 1 == 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over the whole word."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_MULT))
_powers = np.ones(1, _U), np.ones(1, _U)
#: Longest power tables that are kept between calls.
_KEPT = 4 << 20


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    up, down = np.full(n, _MULT, _U), np.full(n, _INV, _U)
    up[0] = down[0] = 1
    made = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    if n <= _KEPT:
        _powers = made
    return made


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and 64-bit hashes of the words of `data`."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(BYTE[raw] * up[: len(raw)], dtype=_U, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def pieces(data: bytes, limit: int = PIECE):
    """Cut a long text at whitespace; a single word above the limit stays whole."""
    at = 0
    while len(data) - at > limit:
        cut = max(data.rfind(b" ", at, at + limit), data.rfind(b"\n", at, at + limit))
        if cut <= at:
            after = [p for p in (data.find(b" ", at + limit), data.find(b"\n", at + limit)) if p > 0]
            if not after:
                break
            cut = min(after)
        yield data[at:cut]
        at = cut
    yield data[at:]


def doc_word_hashes(texts: Iterable[str | None]):
    """Word hashes of each text, lower-casing A-Z; texts are hashed together up to PIECE bytes."""
    group: list[bytes] = []
    size = 0

    def flush():
        starts, hashes = hash_words(b" ".join(group))
        cuts = np.searchsorted(starts, np.cumsum([len(g) + 1 for g in group]))
        return np.split(hashes, cuts[:-1])

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(data) > PIECE:
            if group:
                yield from flush()
                group, size = [], 0
            yield np.concatenate([hash_words(p)[1] for p in pieces(data)])
            continue
        if group and size + len(data) > PIECE:
            yield from flush()
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield from flush()


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    width = min(n, k)
    total = np.full(n - width + 1, width, _U)
    for i in range(width):
        total = total * _U(_MULT) + words[i : n - width + 1 + i]
        total ^= total >> _U(29)
    return np.unique(mix(total))
