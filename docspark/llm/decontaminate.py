"""Benchmark decontamination by spaced-seed hashing (operator 6).

Words are runs of letters and digits, lower-cased. A mask reads some positions of a window and
ignores the others, so a window still matches after the word at an ignored position was
substituted. Masks are applied at every position of both sides:

1. The benchmark's pairs of neighbouring words, its triples of a pair and the next word that a mask reads, and its seeds
   set bits of bitmaps, sized by their number and 512 KB at most; all masks read two neighbours first. Only positions
   of a document that pass all three are exploded, so the large side makes rows only for likely hits.
2. These rows join the benchmark's seeds on the hash; Spark broadcasts the seeds if they are small.
3. A hit fixes an alignment. The hashes of the words around the hit travel with it on both sides; the
   hit counts when some `span` words in a row (the whole item where that is shorter) agree in
   at least `need` of their positions.

The masks are chosen by enumeration so that every placing of the substitutions that a full window may have
leaves one of them whole. Items of fewer words than a window are sought by a solid run of words, as long as
some run between their substitutions must be; without such items these runs cost nothing. So every overlap without
inserted or dropped words that step 3 accepts is found. Null or empty texts match nothing. Items of equal words
count as one, under the least item_id. Rows with null ids are ignored; repeated rows give one row, and the rows of one id are one
document. Texts may have any length. Extra columns are ignored, whatever their names. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.plans.storage import written

from .common import column

GAP = r"[^\p{L}\p{N}]+"
#: Positions that each mask reads: together they hit every window of SPAN words of which NEED agree.
MASKS = ((0, 1, 2, 4, 7, 8, 10), (0, 1, 3, 4, 5, 8, 9), (0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 1, 4, 9, 11, 12), (0, 1, 4, 9, 10, 11))
#: log2 of the bits of a bitmap, at least and at most. Fuller bitmaps let more rows reach the join, no fewer.
BITS = (14, 22)
SPAN, NEED = 14, 0.75


def _hashed(df: DataFrame, key: str) -> DataFrame:
    """(key, h): the word hashes of each row with an id and words."""
    d = df.select(column(df, key, "long").alias(key), F.lower(column(df, "text", "string")).alias("text")).where(f"{key} is not null and text is not null")
    return d.select(key, F.transform(F.array_remove(F.split("text", GAP), ""), lambda w: F.xxhash64(w)).alias("h"))


def _constant(spark: SparkSession, longs: list[int]) -> Column:
    """An array of longs as a constant of short text. Built from functions, its elements would stand in every text of the plan
    that the driver makes, once for each use."""
    jvm = spark.sparkContext._jvm
    array = spark.sparkContext._gateway.new_array(jvm.long, len(longs))
    jvm.java.nio.ByteBuffer.wrap(b"".join(x.to_bytes(8, "big", signed=True) for x in longs)).asLongBuffer().get(array)
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    literal = catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(array), jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>"))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def _bitmap(hashes: DataFrame) -> tuple[Column, int]:
    """The column x of `hashes` as a bitmap (a constant of 2**(bits - 6) longs) and its bits."""
    bits = min(BITS[1], max(BITS[0], math.ceil(math.log2(32 * hashes.count() + 1))))
    slot = F.shiftright(F.col("x").bitwiseAND(F.lit((1 << bits) - 1)), 6)
    words = dict(map(tuple, hashes.groupBy(slot.cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(x & 63 AS INT))")).alias("b")).collect()))
    return _constant(hashes.sparkSession, [words.get(i, 0) for i in range(1 << (bits - 6))]), bits


def _has(bitmap: tuple[Column, int], x: Column) -> Column:
    longs, bits = bitmap
    slot = F.shiftright(x.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int")
    return F.getbit(F.get(longs, slot), x.bitwiseAND(F.lit(63)).cast("int")) == 1


def _pair(h: Column, i: Column) -> Column:
    """A hash of the words at i and i + 1."""
    return F.shiftleft(F.get(h, i), 1).bitwiseXOR(F.get(h, i + F.lit(1)))


def _triple(h: Column, i: Column, offset: int) -> Column:
    """A hash of the pair at i and the word at i + offset."""
    return F.shiftleft(_pair(h, i), 1).bitwiseXOR(F.get(h, i + F.lit(offset))).bitwiseXOR(F.lit(offset * 0x5DEECE66D))


def solid(words: int, need: float) -> tuple[int, ...]:
    """The longest run that agrees wherever the substitutions in an accepted window of `words` words fall."""
    same = math.ceil(need * words)
    return tuple(range(max(1, -(-same // (words - same + 1)))))


def _seed(h: Column, i: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(h, i + F.lit(o)) for o in mask))


def _positions(h: Column, mask: tuple[int, ...]) -> Column:
    last = F.size(h) - 1 - mask[-1]
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _around(h: Column, at: Column, reach: int) -> Column:
    """The hashes from `reach` before the position to `reach` after it, as far as there are any."""
    return F.slice(h, F.greatest(at - reach, F.lit(0)) + 1, at - F.greatest(at - reach, F.lit(0)) + reach + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, need: float = NEED) -> DataFrame:
    """(doc_id, item_id, matched, compared) of documents that overlap benchmark items."""
    masks = MASKS if (span, need) == (SPAN, NEED) else (solid(span, need),)
    reach = span + max(m[-1] for m in masks)
    items = _hashed(benchmark, "item_id").groupBy("h").agg(F.min("item_id").alias("item_id"))

    lengths = sorted(r.n for r in items.select(F.size("h").alias("n")).where(f"n > 0 and n < {span}").distinct().collect())  # fewer than span rows
    runs = {w: solid(w, need) for w in lengths}
    short = sorted(set(runs.values()))

    def made(mask: tuple[int, ...], sizes: Column) -> Column:
        return F.when(sizes, F.transform(_positions(F.col("h"), mask), lambda i: F.struct(i.alias("at"), _seed(F.col("h"), i, mask).alias("x"))))

    by_mask = [made(m, F.size("h") >= span) for m in masks] + [made(m, F.size("h").isin([w for w in lengths if runs[w] == m])) for m in short]
    seeds = items.select("item_id", "h", F.explode(F.flatten(F.filter(F.array(*by_mask), lambda x: x.isNotNull()))).alias("s")).select(
        "item_id", F.col("s.x").alias("seed"), F.least(F.size("h"), F.lit(span)).alias("w"), F.least("s.at", F.lit(reach)).alias("i_at"), _around(F.col("h"), F.col("s.at"), reach).alias("i_ctx")
    )
    seeds = written(seeds, "seeds")
    likely = _bitmap(seeds.select(F.col("seed").alias("x")).distinct())
    upto = lambda n: F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    pairs = _bitmap(items.select(F.explode(F.transform(upto(F.size("h") - 2), lambda i: _pair(F.col("h"), i))).alias("x")).distinct())
    known = dict.fromkeys((*masks, *short))
    thirds = sorted({m[2] for m in known if len(m) > 2 and m[:2] == (0, 1)})
    if thirds:
        third = lambda o: lambda i: _triple(F.col("h"), i, o)
        triples = _bitmap(items.select(F.explode(F.flatten(F.array(*(F.transform(upto(F.size("h") - 1 - o), third(o)) for o in thirds)))).alias("x")).distinct())
    d = _hashed(docs, "doc_id")
    d = d.withColumn("from", F.filter(upto(F.size("h") - 2), lambda i: _has(pairs, _pair(F.col("h"), i))))
    seen = lambda o: lambda i: _has(triples, _triple(F.col("h"), i, o))
    for o in thirds:
        d = d.withColumn(f"from{o}", F.filter("from", seen(o)))

    def passing(mask: tuple[int, ...]) -> Column:
        among = F.col("from" if len(mask) < 3 else f"from{mask[2]}") if mask[:2] == (0, 1) else upto(F.size("h") - 1 - mask[-1])
        last = F.size("h") - mask[-1]
        return F.transform(
            F.filter(among, lambda i: (i < last) & _has(likely, _seed(F.col("h"), i, mask))),
            lambda i: F.struct(_seed(F.col("h"), i, mask).alias("seed"), F.least(i, F.lit(reach)).alias("at"), _around(F.col("h"), i, reach).alias("ctx")),
        )

    hits = d.select("doc_id", F.explode_outer(F.flatten(F.array(*(passing(m) for m in known)))).alias("s")).select("doc_id", "s.*").join(seeds, "seed")
    # Lay the two contexts over each other: `before` words ahead of the hit on both sides, then all that both have.
    before = F.least("at", "i_at")
    lay = lambda c, at: F.slice(c, F.col(at) - before + 1, F.greatest(F.size(c) - F.col(at) + before, F.lit(0)))
    equal = F.zip_with(lay("ctx", "at"), lay("i_ctx", "i_at"), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))

    def most(same: Column) -> Column:
        """The greatest sum of w neighbours, in one pass."""

        def on(state: Column, i: Column) -> Column:
            total = state["sum"] + F.get(same, i) - F.when(i >= F.col("w"), F.get(same, i - F.col("w"))).otherwise(0)
            return F.struct(total.alias("sum"), F.when(i >= F.col("w") - 1, F.greatest(state["best"], total)).otherwise(state["best"]).alias("best"))

        return F.aggregate(upto(F.size(same) - 1), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best")), on)["best"]

    # A position past the end of one side is no agreement, and a window over it agrees in no more words than one that ends there.
    both = F.least(F.size(lay("ctx", "at")), F.size(lay("i_ctx", "i_at")))
    matched = F.when(both >= F.col("w"), F.get(F.transform(F.array(equal), most), F.lit(0))).otherwise(0)
    # Aggregated before they are filtered: a filter would move into the join and count every window again.
    best = hits.select("doc_id", "item_id", matched.alias("matched"), F.col("w").alias("compared")).groupBy("doc_id", "item_id")
    best = best.agg(F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared"))
    return best.where(F.col("matched") >= F.ceil(F.lit(need) * F.col("compared")))
