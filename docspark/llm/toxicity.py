"""Toxicity scores from nearest labelled examples (operator 4).

Examples are labelled rows. A document is the TF-IDF vector of its whole text over every word of the examples: a weight is
(1 + ln tf) * idf, with document frequencies counted over all documents, and BOOST times that for words that go with
label 1 among the examples (chi-squared against label 0). Its neighbours are the examples of greatest cosine, exactly: an
inverted index holds, for each word and each block of BLOCK examples, the greatest weight; the blocks of the greatest
bounds are searched first, and then the others whose bound can reach the K-th best. Votes weigh 1 / (distance + 0.05);
leave-one-out votes of the examples, weighted to the labels' true shares and made monotone by pooling, calibrate the score.

At most about PER_LABEL examples of each label are used, of at most EXAMPLE_BYTES bytes each (chosen by a hash of text and id, so copies
are chosen each on its own). Null and empty texts, and texts without a word of the examples, have no neighbours and score the share of
label 1. Of several labels of one id the greatest counts. Ties among neighbours go to the example that comes first in the index. Without examples every score
is 0. Every input row gives one row, repeated ones too; null ids stay null; texts may have any length; other columns are
ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column
from .language_id import sample_by

WORDS = re.compile(r"[^\W\d_]+")
PER_LABEL = 1500
EXAMPLE_BYTES = 100_000
#: Least chi-squared and number of label-1 examples of a word that goes with label 1, and the weight of such words.
LEAST_CHI2, LEAST_SEEN, BOOST = 20.0, 3, 4.0
K = 25
BLOCK = 256


def term_counts(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


def marked_words(counts: list[Counter], labels: list[int]) -> set[str]:
    """Words more frequent among label-1 examples than chance allows; the bar does not rise with their number."""
    n1 = sum(labels)
    n0 = len(labels) - n1
    with1, with0 = Counter(), Counter()
    for c, y in zip(counts, labels, strict=True):
        (with1 if y else with0).update(c.keys())
    out = set()
    for word, a in with1.items():
        b = with0[word]
        if a < LEAST_SEEN or a * n0 <= b * n1:
            continue
        rest = n0 + n1 - a - b
        chi2 = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / max(1, (a + b) * n1 * n0 * rest)
        if chi2 >= LEAST_CHI2:
            out.add(word)
    return out


class BlockMaxIndex:
    """Unit vectors as postings by term, with a greatest weight for each term and block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        """vectors: (terms, weights) of each example."""
        self.size = len(vectors)
        self.blocks = -(-max(self.size, 1) // BLOCK)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        owner = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        order = np.lexsort((owner, term))
        term, self.ids = term[order], owner[order].astype(np.int32)
        self.weights = np.concatenate([w for _, w in vectors])[order] if vectors else np.empty(0)
        self.tops = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.tops, (term, self.ids // BLOCK), self.weights)
        #: cuts[t * blocks + b]: where the postings of term t in block b begin.
        self.cuts = np.searchsorted(term * self.blocks + self.ids // BLOCK, np.arange(n_terms * self.blocks + 1)).astype(np.int32)

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Dot products with the examples of some blocks, zero elsewhere."""
        cell = (terms[:, None] * self.blocks + blocks).ravel()
        begin = self.cuts[cell]
        length = self.cuts[cell + 1] - begin
        of = np.repeat(np.arange(len(cell)), length)
        at = np.arange(len(of)) + np.repeat(begin - (np.cumsum(length) - length), length)
        return np.bincount(self.ids[at], np.repeat(weights, len(blocks))[of] * self.weights[at], self.size)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of greatest positive dot product, exactly."""
        if not len(terms) or not self.size:
            return []
        bounds = weights @ self.tops[terms]
        order = np.argsort(-bounds, kind="stable")
        first = max(1, -(-2 * k // BLOCK), self.blocks // 4)
        scores = self._scores(terms, weights, np.sort(order[:first]))
        if 0 <= without:
            scores[without] = 0
        least = np.partition(scores, -k)[-k] if self.size > k else 0.0
        rest = order[first:][bounds[order[first:]] > least]
        if len(rest):
            scores += self._scores(terms, weights, np.sort(rest))
            if 0 <= without:
                scores[without] = 0
        near = np.argpartition(-scores, k)[:k] if self.size > k else np.arange(self.size)
        near = near[np.lexsort((near, -scores[near]))]
        return [(s, i) for s, i in zip(scores[near].tolist(), near.tolist(), strict=True) if s > 0]


class Model:
    def __init__(self, examples: list[tuple[int, Counter, int]], seen: dict[str, int], n_docs: int, share: float | None = None):
        """examples: (doc_id, word counts, label); seen: documents with each word among n_docs; share: of label 1 among all labelled rows."""
        # Examples of one language, told by their most frequent word, are neighbours: blocks are alike and bounds tight.
        examples = sorted(examples, key=lambda e: (max(e[1].items(), key=lambda x: (x[1], x[0]))[0] if e[1] else "", e[2], e[0]))
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[2] for e in examples], float)
        self.prior = float(self.labels.mean()) if examples else 0.0
        self.share = self.prior if share is None else share
        marked = marked_words([e[1] for e in examples], [e[2] for e in examples])
        self.term = {w: i for i, w in enumerate(sorted({w for e in examples for w in e[1]}))}
        self.idf = np.array([(math.log((1 + n_docs) / (1 + seen.get(w, 0))) + 1) * (BOOST if w in marked else 1.0) for w in self.term])
        vectors = [self.vector(e[1]) for e in examples]
        self.index = BlockMaxIndex(vectors, len(self.term))
        weight = [(1 - self.share) / (1 - self.prior) if self.prior < 1 else 1.0, self.share / self.prior if self.prior else 1.0]
        raw = [(self.vote(self.index.search(*v, K, i)), y, weight[int(y)]) for i, (v, y) in enumerate(zip(vectors, self.labels, strict=True)) if len(v[0])]
        self.steps = pooled(raw)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of unit length."""
        terms = np.fromiter((self.term.get(w, -1) for w in counts), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))[terms >= 0]
        terms = terms[terms >= 0]
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        order = np.argsort(terms)
        terms, tf = terms[order], tf[order]
        weights = (1 + np.log(tf)) * self.idf[terms]
        return terms, weights / math.sqrt(weights @ weights)

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = [1 / (1 - min(s, 1.0) + 0.05) for s, _ in near]
        return (sum(x * self.labels[i] for x, (_, i) in zip(w, near, strict=True)) + self.prior) / (sum(w) + 1)

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, *self.steps)) if len(self.steps[0]) else raw

    def score(self, counts: Counter) -> tuple[float, list[int]]:
        """(score, ids of the nearest examples)."""
        near = self.index.search(*self.vector(counts), K)
        return (self.calibrated(self.vote(near)) if near else self.share), [self.ids[i] for _, i in near[:5]]


def pooled(rows: list[tuple[float, float, float]], least: int = 20) -> tuple[list[float], list[float]]:
    """Monotone fit of (raw vote, label, weight): blocks of at least `least` rows are pooled while they fall; a tenth of a pseudo-row of either label each."""
    blocks: list[list[float]] = []  # sums of raw, weighted labels, weights, rows
    for raw, y, w in sorted(rows):
        if blocks and blocks[-1][3] < least:
            blocks[-1] = [blocks[-1][0] + raw, blocks[-1][1] + y * w, blocks[-1][2] + w, blocks[-1][3] + 1]
        else:
            blocks.append([raw, y * w, w, 1])
        while len(blocks) > 1 and blocks[-1][3] >= least and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [a / n for a, _, _, n in blocks], [(y + 0.1) / (w + 0.2) for _, y, w, _ in blocks]


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, per_label: int = PER_LABEL) -> Model:
    """learn_from: a condition on doc_id. Word statistics are counted over all rows of docs."""
    d = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    y = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "toxic", "int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    d = d.withColumn("h", F.xxhash64("text"))
    usable = d.where(learn_from & F.col("text").isNotNull() & (F.octet_length("text") <= EXAMPLE_BYTES)).select("doc_id", "h").join(y, "doc_id")
    share = usable.agg(F.avg("y")).first()[0]
    ids = sample_by(usable, "y", per_label, ["doc_id", "h", "y"], ["h", "doc_id"], 2)
    # At most 4 * per_label ids: small enough to send to every executor, so that texts need not move.
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, h long, y int").distinct()
    chosen = sorted({tuple(r) for r in d.join(F.broadcast(wanted), ["doc_id", "h"]).select("doc_id", "text", "y").collect()})
    examples = [(i, term_counts(t), label) for i, t, label in chosen]
    known = docs.sparkSession.sparkContext.broadcast(frozenset(w for _, c, _ in examples for w in c))

    def count(batches):
        seen, n, words = Counter(), 0, known.value
        for pdf in batches:
            for text in pdf["text"]:
                n += 1
                seen.update(words.intersection(WORDS.findall((text or "").lower())))
        yield pd.DataFrame({"word": [None, *seen], "n": [n, *seen.values()]})

    rows = d.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the examples, which their bytes bound
    seen = {r.word: r.n for r in rows}
    return Model(examples, seen, seen.get(None, 0), share)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, evidence) of each row; evidence: ids of the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        repeated = lru_cache(maxsize=4096)(lambda t: m.score(term_counts(t)))
        for pdf in batches:
            got = [repeated(t) if t is None or len(t) < 10_000 else m.score(term_counts(t)) for t in pdf["text"].tolist()]
            s = np.array([g[0] for g in got], float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s.clip(0, 1), "predicted": (s >= threshold).astype("int32"), "evidence": [list(g[1]) for g in got]})

    # Ids pass as text: beside nulls pandas would make them floats.
    d = docs.select(column(docs, "doc_id", "long").cast("string").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return d.mapInPandas(run, "doc_id string, score double, predicted int, evidence array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))
