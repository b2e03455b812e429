"""N-gram Jaccard join by T-occurrence search (operator 1).

A document is its set of distinct word shingles. Two documents link when
100 * |A & B| >= percent * |A | B|.

1. Equal sets form one class; only classes are searched.
2. Routing. For a pair of sets of at most `hi` shingles, linked means that at most
   D = floor((100 - percent) / (100 + percent) * 2 * hi) shingles are in one set only. Shingles
   are dealt by hash over K > D segments, so at least K - D segments are equal
   in both. Each equal, non-empty segment is a shared routing key; a class with so many empty
   segments that this proves nothing also sends its empty segments. Where linked classes must share several
   keys, each leaves out as many, less one, of its most frequent keys (prefix filter over one
   order of all keys). No link is missed, and passages that many documents share bring few together.
3. T-occurrence search among what was routed together (`Inverted`): the sets of a tile are turned into inverted
   lists of their shingles. A query's longest lists are set aside, the others are merged with a heap (DivideSkip), and
   the members found often enough there are looked up in the long lists by binary search until
   they reach the needed overlap or can't. First one head of each routing key asks for what links with it;
   then the members of keys that still join different labels, grouped by what sizes and parity bitmaps (which
   bound |A ^ B| from below) leave open, are searched against each other. Tiles return connecting links, never all pairs.
4. Links give components. Links between texts that are already connected are not listed.

Rows with null id take part in no link and get a null component. Null and empty
texts have no shingles and stand alone. Repeated rows come back as often as they came in; if an id has several texts, they
are one document with the links of all. Texts may have any length. Other columns are ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.hashing import doc_word_hashes, mix, shingle_set
from docspark.operators.components import components
from docspark.operators.set_tiles import linked, needed, node_of, packed
from docspark.plans.storage import release, written

from .common import column

_U = np.uint64
#: 64-bit words of the parity bitmap: its Hamming distance never exceeds |A ^ B|.
BITMAP = 8
#: Members of a routing key that are compared by bitmap at once.
SIDE = 2048
#: Cost of the binary search in a long list against a step of the merge.
MU = 0.01


def merge_skip(lists: list[list[int]], t: int) -> dict[int, int]:
    """Members found in at least t of the sorted lists, with their counts: a heap merge that skips what can't reach t."""
    width = len(lists)
    if width < t:
        return {}
    at = [0] * width
    heap = [x[0] * width + i for i, x in enumerate(lists)]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while len(heap) >= t:
        top = heap[0] // width
        popped = []
        while heap and heap[0] // width == top:
            popped.append(heapq.heappop(heap) % width)
        if len(popped) >= t:
            found[top] = len(popped)
            for i in popped:
                at[i] += 1
        else:
            # A member below the next one in the heap is in t - 1 lists at most.
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap) % width)
            if not heap:
                break
            least = heap[0] // width
            for i in popped:
                at[i] = bisect_left(lists[i], least, at[i])
        for i in popped:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, lists[i][at[i]] * width + i)
    return found


class Inverted:
    """Inverted lists of the elements of some sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(self.count), self.sizes)
        values, rank = np.unique(np.concatenate(sets), return_inverse=True)
        self.ranks = np.split(rank, np.cumsum(self.sizes)[:-1])
        #: element * count + member, sorted: the lists one after another.
        self.keys = np.sort(rank * self.count + owner)
        self.members = self.keys % self.count
        self.starts = np.searchsorted(self.keys, np.arange(len(values) + 1) * self.count)

    def lists(self, ranks: np.ndarray, open_: np.ndarray) -> list[list[int]]:
        """The lists of some elements without members that aren't open; empty ones are left out."""
        begin, length = self.starts[ranks], self.starts[ranks + 1] - self.starts[ranks]
        of = np.repeat(np.arange(len(ranks)), length)
        members = self.members[np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)]
        keep = open_[members]
        of, members = of[keep], members[keep].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
        return [members[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def divide_skip(self, ranks: np.ndarray, t: int, open_: np.ndarray, long_lists: int | None = None) -> dict[int, int]:
        """Open members that have at least t of the elements, with how many.

        The `long_lists` longest lists (default: by the usual cost rule, at most t - 1) are set
        aside; the others are merged, members with t - long_lists hits there
        become candidates, and those are looked up in the long lists by binary search, the
        longest lists last, as long as they can reach t.
        """
        t = max(1, t)
        if len(ranks) < t:
            return {}
        length = self.starts[ranks + 1] - self.starts[ranks]
        order = np.argsort(length, kind="stable")
        if long_lists is None:
            long_lists = int(t / (MU * math.log2(int(length[order[-1]]) + 1) + 1))
        aside = max(0, min(long_lists, t - 1))
        short, long = ranks[order[: len(ranks) - aside]], ranks[order[len(ranks) - aside :]]
        found = merge_skip(self.lists(short, open_), t - aside)
        if not found or not aside:
            return found
        members, hits = np.array(list(found)), np.array(list(found.values()))
        step = max(64, (1 << 16) // len(members))
        for at in range(0, aside, step):
            probe = long[at : at + step, None] * self.count + members
            place = np.minimum(np.searchsorted(self.keys, probe.ravel()), len(self.keys) - 1)
            hits = hits + (self.keys[place] == probe.ravel()).reshape(probe.shape).sum(0)
            alive = hits + max(0, aside - at - step) >= t
            members, hits = members[alive], hits[alive]
            if not len(members):
                return {}
        return dict(zip(members.tolist(), hits.tolist(), strict=True))

    def linked(self, q: int, open_: np.ndarray, percent: int) -> list[int]:
        """The open members that link with member q."""
        n = int(self.sizes[q])
        t = needed(n, int(self.sizes[open_].min()), percent)
        found = self.divide_skip(self.ranks[q], t, open_)
        return [m for m, c in sorted(found.items()) if c >= needed(n, int(self.sizes[m]), percent)]


def _parity(s: np.ndarray) -> np.ndarray:
    bit = mix(s) & _U(64 * BITMAP - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node, b0..): set size, class key and parity bitmap of each row."""

    def run(batches):
        for pdf in batches:
            n, node, bits = [], [], []
            for words in doc_word_hashes(pdf["text"].tolist()):
                s = shingle_set(words, k)
                n.append(len(s))
                node.append(node_of(s))
                bits.append(_parity(s))
            bits = np.array(bits, np.int64).reshape(-1, BITMAP)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "node": node} | {f"b{i}": bits[:, i] for i in range(BITMAP)})

    # Ids pass as text: beside nulls pandas would make them floats.
    schema = "doc_id string, n long, node long, " + ", ".join(f"b{i} long" for i in range(BITMAP))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def segments(s: np.ndarray, level: int, percent: int) -> tuple[np.ndarray, int]:
    """Routing keys of a set at a size level, and how many of them every linked set of that level shares."""
    hi = int((100 / percent) ** (level + 1)) + 1
    d = (100 - percent) * 2 * hi // (100 + percent)
    k = d + 1 + max(2, d // 16)
    part = (mix(s ^ _U(level * 2654435761 + 1)) % _U(k)).astype(np.int64)
    sums, full = np.zeros(k, _U), np.zeros(k, bool)
    np.add.at(sums, part, mix(s + _U(977)))
    full[part] = True
    shared = int(full.sum()) - d  # of k - d equal segments, as many may be empty as this set has empty ones
    ids = np.arange(k, dtype=_U) if shared <= 0 else np.flatnonzero(full).astype(_U)
    return mix(sums[ids.astype(np.int64)] + mix(ids * _U(1000003) + _U(level))).view(np.int64), max(1, shared)


def routed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, node, level, shared): the routing keys of every class at its own size level and the next."""

    def run(batches):
        seen: set[int] = set()
        for pdf in batches:
            out, rows = [], 0
            for words in doc_word_hashes(pdf["text"].tolist()):
                s = shingle_set(words, k)
                if not len(s) or (key := node_of(s)) in seen:
                    continue
                seen.add(key)
                level = int(math.log(len(s)) / math.log(100 / percent))
                while (100 / percent) ** (level + 1) < len(s):
                    level += 1
                for x in (level, level + 1):
                    sig, shared = segments(s, x, percent)
                    out.append((sig, np.full(len(sig), key), np.full(len(sig), x), np.full(len(sig), shared)))
                    rows += len(sig)
                if rows > 200_000:
                    yield table(out)
                    out, rows = [], 0
            if out:
                yield table(out)

    def table(parts):
        return pd.DataFrame(dict(zip(("sig", "node", "level", "shared"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return docs.select("text").mapInPandas(run, "sig long, node long, level int, shared int")


def may_link(percent: int):
    """Whether sizes a_n, b_n and parity bitmaps a_b0.., b_b0.. allow a link."""
    apart = sum((F.bit_count(F.col(f"a_b{i}").bitwiseXOR(F.col(f"b_b{i}"))) for i in range(BITMAP)), F.lit(0))
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n")))


def close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to link, with the sizes."""
    side = lambda p: classes.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), *(F.col(f"b{i}").alias(f"{p}_b{i}") for i in range(BITMAP)))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(percent)).select("a", "b", "a_n", "b_n")


def unresolved(label: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, label, other label): members of one routing key with a member of another label that sizes and bitmaps
    allow to link. Every such member has a row, and the label pairs connect all that such pairs connect."""
    label_at = np.unique(label, return_inverse=True)[1]
    major = np.bincount(label_at).argmax()
    reached, partner = label_at.copy(), np.full(len(label), -1)
    more: list[tuple[int, int]] = []
    for q in np.flatnonzero(label_at != major).tolist():
        apart = np.bitwise_count(bits ^ bits[q]).sum(1, dtype=np.int64)
        open_ = (label_at != label_at[q]) & (100 * np.minimum(n, n[q]) >= percent * np.maximum(n, n[q])) & ((100 + percent) * apart <= (100 - percent) * (n + n[q]))
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        partner[others[partner[others] < 0]] = q
        if partner[q] < 0:
            partner[q] = others[0]
        for x in np.unique(reached[others]).tolist():
            if x != reached[q]:
                more.append((q, int(others[reached[others] == x][0])))
                reached[reached == x] = reached[q]
    at = np.flatnonzero(partner >= 0)
    member = np.concatenate([at, np.array([a for a, _ in more], np.int64)]).astype(np.int64)
    other = np.concatenate([partner[at], np.array([b for _, b in more], np.int64)]).astype(np.int64)
    return member, label[member], label[other]


def still_open(marked: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """marked(sig, node, label) -> (node, label, other): the members of keys of several labels that are not settled.

    Of keys with the same members, told by two hashes of them, one is kept. The members of a key are dealt into parts
    of about SIDE; a tile compares two parts and returns at most two rows a member.
    """
    bits = [f"b{i}" for i in range(BITMAP)]
    whole = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    mixed = marked.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), *whole).where("lo <> hi")
    mixed = mixed.groupBy("size", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("size") / SIDE).cast("int").alias("parts"))
    d = marked.join(mixed, "sig").join(classes.select("node", "n", *bits), "node").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    d = d.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q"))
    tile = ["sig", "i", "j"]
    names = [*tile, "node", "label", "n", *bits]

    def found(rows: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
        """Rows in the order of `names`; a tile lies between two cuts."""
        node, label, n, b = rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6:]
        out = []
        two = cuts[:-1][np.diff(cuts) == 2]
        if len(two):
            x, y = two, two + 1
            apart = np.bitwise_count(b[x] ^ b[y]).sum(1, dtype=np.int64)
            ok = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((100 + percent) * apart <= (100 - percent) * (n[x] + n[y]))
            x, y = x[ok], y[ok]
            out += [(node[x], label[x], label[y]), (node[y], label[y], label[x])]
        for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if to - at > 2:
                m, own, other = unresolved(label[at:to], n[at:to], b[at:to], percent)
                out.append((node[at:to][m], own, other))
        return pd.DataFrame(dict(zip(("node", "label", "other"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {"node": [], "label": [], "other": []}, dtype="int64").drop_duplicates()

    def run(batches):
        left = np.empty((0, len(names)), np.int64)
        for pdf in batches:
            rows = np.concatenate([left, pdf[names].to_numpy(np.int64)])
            cuts = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)]))
            left = rows[cuts[-1] :]  # the next batch may go on with the last tile
            if len(cuts) > 1:
                yield found(rows[: cuts[-1]], cuts)
        if len(left):
            yield found(left, np.array([0, len(left)]))

    return d.select(*names).repartition(*tile).sortWithinPartitions(*tile).mapInPandas(run, "node long, label long, other long").distinct()


def link_forest(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between classes that connect what all links connect."""
    spark = docs.sparkSession
    keyed = routed(docs, k, percent).repartition("sig")
    ends = keyed.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size"), F.max("level").alias("at"), F.max("shared").alias("most")).where("lo <> hi")
    # Linked classes share at least `shared` keys, so each may drop its shared - 1 most frequent ones: those of passages that many documents have.
    place = F.row_number().over(Window.partitionBy("node", "level").orderBy(F.desc("size"), "sig"))
    # `at` and `most` always hold; with them both uses of `keyed` read all its columns and so share one exchange.
    lists = keyed.join(ends.drop("lo", "hi"), "sig").where("greatest(level, at) <=> at and greatest(shared, most) <=> most").select(*keyed.columns, "size").distinct()
    lists = lists.withColumn("place", place).where("place >= shared")
    lists = written(lists.select("sig", "node", "size"), "lists")
    release(spark)
    # The class that shares most keys with others heads its lists: of copies with edits, the one nearest to all.
    degree = lists.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = lists.select("sig", "node").join(degree, "node").withColumn("rank", F.struct("degree", "node"))
    heads = ranked.groupBy("sig").agg(F.max("rank").alias("head"))
    nearest = ranked.select("sig", "node").join(heads, "sig").groupBy("node").agg(F.max("head")["node"].alias("a")).where("a <> node").select("a", F.col("node").alias("b"))

    def texts(of: DataFrame) -> DataFrame:
        return packed(docs, of.select("node").join(classes.select("node", "least_id"), "node"))

    first = written(close(nearest, classes, percent), "pairs")
    asking = first.select(F.col("a").alias("group"), F.col("a").alias("node"), F.col("a_n").alias("n"), F.lit(True).alias("asks")).distinct()
    stars = asking.unionByName(first.select(F.col("a").alias("group"), F.col("b").alias("node"), F.col("b_n").alias("n"), F.lit(False).alias("asks"))).withColumn("label", F.col("node"))
    linked_ = written(linked(stars, texts(stars), k, percent, Inverted), "links")
    release(spark)
    lists = lists.select("sig", "node")
    label = lists.select("node").distinct().join(linked_.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "node", "left").select("node", F.coalesce("to", "node").alias("label"))
    label = written(label.join(label.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
    rest = written(still_open(lists.join(label, "node"), classes, percent), "open")
    release(spark)
    group = components(rest, "label", "other").select(F.col("node").alias("label"), F.col("component").alias("group"))
    members = rest.select("node", "label").distinct().join(group, "label").join(classes.select("node", "n"), "node").withColumn("asks", F.lit(False))
    members = written(members, "members")
    out = written(linked_.union(linked(members, texts(members), k, percent, Inverted)), "links")
    release(spark)
    return out


def jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text)."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100: {percent}")
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    known = written(describe(docs, k), "sets")
    named = known.where("doc_id is not null and n > 0")
    bits = [f"b{i}" for i in range(BITMAP)]
    classes = named.groupBy("node").agg(F.min("doc_id").alias("least_id"), *(F.min(c).alias(c) for c in ("n", *bits)))
    same = named.select("doc_id", "node").distinct()
    several = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("c")).where("c > 1")
    # The texts of one id are connected by it.
    links = same.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    if percent < 100:  # else equal sets alone link
        links = links.union(link_forest(docs.where("doc_id is not null"), classes, k, percent))
    reach = components(links).join(classes.select(F.col("node"), "least_id"), "node")
    least = reach.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = reach.join(least, "component").select("node", "component_id")
    of = classes.select("node", "least_id").join(of, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    alone = known.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
