"""Language identification by a byte convolutional network (operator 2).

Filters of several widths run over the bytes, are max-pooled over windows of WINDOW bytes and feed a
softmax; the network is trained in numpy on labelled text. At prediction every window of the whole text
is scored, and a document's probabilities are the means over its windows, weighted by their bytes.

Training reads at most about PER_LANG documents of each of the LANGS most frequent languages (chosen by a hash of
text and id) and WINDOWS windows of each. A text's prediction depends on that text alone: filters at its end read blanks.
Null texts and texts without a letter get `und` and score 0, and so does
everything if there is no labelled text. Ties go to the language that sorts first. Long texts are read whole, SLAB
bytes at a time. Every input row gives one row, repeated ones too; null ids stay null; other columns are ignored, whatever
their names. No rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
PER_LANG = 1500
#: Languages that are learned at most: the most frequent ones.
LANGS = 500
WINDOWS = 4
#: Bytes of text whose filter outputs are held at once.
SLAB = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_PAD = WIDTHS[-1] - 1


class ByteNet:
    """tables[w][k]: (256, FILTERS) weights of the k-th byte under filters of width w."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def train(self, windows: np.ndarray, truth: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> ByteNet:
        """windows: (n, WINDOW + pad) bytes. Adam on the cross entropy; the maxima carry the gradient."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.out, self.bias]
        m, v = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x, y = windows[rows].astype(np.intp), truth[rows]
                pooled, args = [], []
                for w, t in zip(WIDTHS, self.tables, strict=True):
                    z = sum(t[k][x[:, k : k + WINDOW]] for k in range(w))
                    a = z.argmax(1)
                    args.append(a)
                    pooled.append(np.take_along_axis(z, a[:, None], 1)[:, 0])
                hidden = np.maximum(np.concatenate(pooled, 1), 0)
                grad = _softmax(hidden @ self.out + self.bias)
                grad[np.arange(len(y)), y] -= 1
                grad /= len(y)
                back = (grad @ self.out.T) * (hidden > 0)
                grads = []
                for i, (w, a) in enumerate(zip(WIDTHS, args, strict=True)):
                    g = np.zeros_like(self.tables[i])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(x, a + k, 1), np.arange(FILTERS)[None]), part)
                    grads.append(g)
                grads += [hidden.T @ grad, grad.sum(0)]
                step += 1
                for x_, g, m_, v_ in zip(weights, grads, m, v, strict=True):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.001 * (g * g - v_)
                    x_ -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)
        return self

    def pairs(self) -> list[np.ndarray]:
        """Tables over two bytes at once, (65536, FILTERS) each: widths 2, 3 (first two) and 4 (twice)."""
        two = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        t2, t3, t4 = self.tables
        return [two(t2[0], t2[1]), two(t3[0], t3[1]), t3[2], two(t4[0], t4[1]), two(t4[2], t4[3])]

    def window_probabilities(self, data: np.ndarray, pairs: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
        """data: WINDOW * n + pad bytes -> (n, languages); `ends`: where texts end, after which filters read blanks."""
        n = (len(data) - _PAD) // WINDOW
        x = data.astype(np.intp)
        pair = x[:-1] * 256 + x[1:]
        size = n * WINDOW
        z2 = pairs[0].take(pair[:size], 0)
        z3 = pairs[1].take(pair[:size], 0)
        z3 += pairs[2].take(x[2 : 2 + size], 0)
        z4 = pairs[3].take(pair[:size], 0)
        z4 += pairs[4].take(pair[2 : 2 + size], 0)
        last = np.full((len(ends), 2 * _PAD), 0x20, np.intp)
        last[:, :_PAD] = x[ends[:, None] - _PAD + np.arange(_PAD)]
        for z, t in zip((z2, z3, z4), self.tables, strict=True):
            for p in range(_PAD):
                z[ends - _PAD + p] = sum(t[k][last[:, p + k]] for k in range(len(t)))
        pooled = np.concatenate([z.reshape(n, WINDOW, FILTERS).max(1) for z in (z2, z3, z4)], 1)
        return _softmax(np.maximum(pooled, 0) @ self.out + self.bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _framed(data: bytes) -> bytes:
    return data.ljust(-(-max(len(data), 1) // WINDOW) * WINDOW)


def predict(net: ByteNet, pairs: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """(n, languages): mean window probabilities of each text, by their bytes."""
    total = np.zeros((len(texts), len(net.langs)))
    group: list[tuple[int, int]] = []  # text, bytes of each window
    held: list[bytes] = []

    def flush():
        if held:
            p = net.window_probabilities(np.frombuffer(b"".join(held) + b" " * _PAD, np.uint8), pairs, np.cumsum([len(x) for x in held]))
            np.add.at(total, [i for i, _ in group], p * np.array([w for _, w in group])[:, None])
            held.clear()
            group.clear()

    size = 0
    for i, data in enumerate(texts):
        for part in (data[at : at + SLAB] for at in range(0, max(len(data), 1), SLAB)):
            framed = _framed(part)
            held.append(framed)
            group += [(i, max(1, min(WINDOW, len(part) - at))) for at in range(0, len(framed), WINDOW)]
            size += len(framed)
            if size >= SLAB:
                flush()
                size = 0
    flush()
    return total / np.maximum(total.sum(1, keepdims=True), 1e-12)


def sample_by(df: DataFrame, label: str, per_label: int, keep: list[str], by: list[str], labels_at_most: int = LANGS) -> list:
    """About `per_label` rows of each of the most frequent values of `label`, chosen by a hash of the columns `by`, so that
    reruns agree and copies are chosen each on its own. At most twice per_label * labels_at_most rows come to the driver."""
    counts = df.groupBy(label).count().orderBy(F.desc("count"), label).limit(labels_at_most)
    share = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("count"))
    chosen = df.join(F.broadcast(counts), label).withColumn("__at", F.xxhash64(*by, F.lit(3))).where(F.pmod("__at", F.lit(1_000_000)) < share * 1_000_000)
    return sorted(map(tuple, chosen.orderBy("__at").select(*keep).limit(2 * per_label * labels_at_most).collect()), key=repr)


def fit(docs: DataFrame, learn_from: Column, per_lang: int = PER_LANG) -> ByteNet | None:
    """learn_from: a condition on doc_id."""
    d = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang")).where(learn_from & F.col("text").isNotNull() & F.col("lang").isNotNull())
    cut = [F.substring("text", (F.greatest(F.length("text") - WINDOW, F.lit(0)) * F.lit(j / (WINDOWS - 1))).cast("int") + 1, F.lit(WINDOW + _PAD)).alias(f"w{j}") for j in range(WINDOWS)]
    rows = sample_by(d.select("doc_id", "lang", "text", *cut), "lang", per_lang, ["lang", *(f"w{j}" for j in range(WINDOWS))], ["text", "doc_id"])
    data, truth = [], []
    langs = sorted({r[0] for r in rows})
    for lang, *windows in rows:
        for w in dict.fromkeys(windows):
            if _LETTER.search(w or ""):
                data.append(np.frombuffer(w.encode("utf-8", "replace").lower()[: WINDOW + _PAD].ljust(WINDOW + _PAD), np.uint8))
                truth.append(langs.index(lang))
    return ByteNet(langs).train(np.array(data), np.array(truth)) if data else None


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs(doc_id, text)."""

    def run(batches):
        pairs = net.pairs() if net else []
        for pdf in batches:
            texts = pdf["text"].tolist()
            named = [i for i, t in enumerate(texts) if net and t is not None and _LETTER.search(t)]
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if named:
                p = predict(net, pairs, [texts[i].encode("utf-8", "replace").lower() for i in named])
                best = p.argmax(1)
                lang[named] = [net.langs[b] for b in best]
                score[named] = p[np.arange(len(best)), best]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score.clip(0, 1)})

    # Ids pass as text: beside nulls pandas would make them floats.
    d = docs.select(column(docs, "doc_id", "long").cast("string").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return d.mapInPandas(run, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
