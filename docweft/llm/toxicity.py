"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words without outer punctuation and their leading 4 to 7
bytes, hashed into ``2**BITS`` buckets; a term's value grows with the logarithm of
its count.  Beside a linear weight each kept bucket has a short vector, and the dot
product of two buckets' vectors weighs their appearing together: an insult repeated
or aimed at somebody counts for more, and a word inside a harmless stock phrase for
less, than any sum of single weights could say.

Every text is read in windows of ``2 * STEP`` words, each half of the next one's, and has
the largest of their scores; a text of up to ``2 * STEP`` words is one window.  So a
score does not depend on how much else a document holds, and a toxic passage weighs the
same in a short text and in a very long one.

The ``keep`` buckets with the largest chi-square on the sample are kept.  The machine
is fitted on at most ``per_class`` labelled rows of each class and weighted back to the
shares of all labelled rows: first on all windows, then once more with only the window of
each toxic document that scored highest, as its other windows may be harmless.  Without
rows of both classes every document scores their share.  Null and empty texts get the
score of a window without terms.  An id with several labels counts once, with the
smallest.  Repeated rows are scored one by one.  Columns of ``docs`` other than doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.learning import class_counts, labelled_sample, map_texts, scored, sigmoid
from docweft.llm.textvec import Spans, Words, flat, lists, slices, trimmed, words

BITS = 18
PREFIXES = (4, 5, 6, 7)
#: Words by which a window moves on; it is twice as long.  Windows in which an insult stands alone teach what it weighs by itself.
STEP = 32
#: Training has a window without terms, labelled clean, for every so many windows: nothing is toxic for want of a term.
EMPTY = 10


def _hashed(found: Words, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the terms of all words; ``slot`` renumbers buckets and drops those at -1."""
    start, end = trimmed(found)
    spans, size = Spans(found.data), end - start
    owners, buckets = [], []
    for n in (0, *PREFIXES):
        pick = np.arange(len(start)) if not n else np.flatnonzero(size > n)
        name = spans(start[pick], end[pick] if not n else start[pick] + n)
        bucket = ((name ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - BITS)).astype(np.int64)
        if slot is not None:
            bucket = slot[bucket]
            live = bucket >= 0
            bucket, pick = bucket[live], pick[live]
        owners.append(pick)
        buckets.append(bucket)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def _counted(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    most = 1 << BITS
    key, count = np.unique(owner * most + bucket, return_counts=True)
    return key // most, key % most, count


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the distinct terms of a batch."""
    found = words(data, offs, lower=True)
    if not len(found.start):
        return (np.zeros(0, np.int64),) * 3
    word, bucket = _hashed(found, None)
    return _counted(found.doc[word], bucket)


def window_terms(data: np.ndarray, offs: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, window, index, count): each document's first window (and their number), and the distinct kept terms of each window."""
    found = words(data, offs, lower=True)
    many = np.maximum(-(-found.count // STEP) - 1, 1)
    first = np.concatenate([[0], np.cumsum(many)])
    if not len(found.start):
        return first, *(np.zeros(0, np.int64),) * 3
    word, index = _hashed(found, slot)
    doc = found.doc[word]
    cell = (word - found.first[doc]) // STEP
    # a half belongs to the window that it begins and to the one that it ends
    begins, ends = cell < many[doc], cell > 0
    window = np.concatenate([(first[doc] + cell)[begins], (first[doc] + cell - 1)[ends]])
    return first, *_counted(window, np.concatenate([index[begins], index[ends]]))


@dataclass
class Machine:
    """slot: bucket -> index or -1; linear weights and vectors by index."""

    slot: np.ndarray
    bias: float
    linear: np.ndarray
    vectors: np.ndarray

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Each text's score: the largest of its windows'."""
        first, window, index, count = window_terms(data, offs, self.slot)
        return np.maximum.reduceat(self.scored(window, index, np.log2(1.0 + count), first[-1]), first[:-1]) if len(first) > 1 else np.zeros(0)

    def scored(self, window: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias) + np.bincount(window, weights=self.linear[index] * value, minlength=n)
        for f in range(self.vectors.shape[1]):
            part = self.vectors[index, f] * value
            out += 0.5 * (np.bincount(window, weights=part, minlength=n) ** 2 - np.bincount(window, weights=part * part, minlength=n))
        return sigmoid(out)


def fit(first: np.ndarray, index: np.ndarray, value: np.ndarray, width: int, y: np.ndarray, weight: np.ndarray, rank: int = 6, steps: int = 2000, epochs: int = 20, batch: int = 256, rate: float = 0.02, ridge: float = 2e-4, seed: int = 11) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the weighted logistic loss of the factorization machine, for at least so many steps and epochs; deterministic.

    Row i has ``value`` at ``index`` from ``first[i]`` to ``first[i + 1]``; a batch of rows at a time is made dense.
    """
    rng = np.random.default_rng(seed)
    n, d = len(y), width
    epochs = max(epochs, -(-steps * batch // n))
    share = float((weight * y).sum() / weight.sum())
    params = [np.array([np.log(share / (1 - share))]), np.zeros(d), rng.normal(0, 0.03, (d, rank))]
    slope, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            size = first[rows + 1] - first[rows]
            at_ = np.arange(size.sum()) + np.repeat(first[rows] - (np.cumsum(size) - size), size)
            xb = np.zeros((len(rows), d))
            xb[np.repeat(np.arange(len(rows)), size), index[at_]] = value[at_]
            bias, w, v = params
            xv = xb @ v
            z = bias[0] + xb @ w + 0.5 * ((xv**2) - (xb**2) @ (v**2)).sum(axis=1)
            g = weight[rows] * (sigmoid(z) - y[rows]) / len(rows)
            grads = [np.array([g.sum()]), xb.T @ g + ridge * w, xb.T @ (g[:, None] * xv) - ((xb**2).T @ g)[:, None] * v + ridge * v]
            t += 1
            for p, gr, m, s in zip(params, grads, slope, square, strict=True):
                m *= 0.9
                m += 0.1 * gr
                s *= 0.99
                s += 0.01 * gr * gr
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return float(params[0][0]), params[1], params[2]


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = 3000, keep: int = 1024) -> Machine:
    """Learn from labelled rows whose remainder is not ``held``."""
    counts = class_counts(labels, "toxic", modulus, held)
    total = sum(counts.values())
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    empty = Machine(np.full(1 << BITS, -1, dtype=np.int32), float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, 1)))
    if not counts.get(0) or not counts.get(1):
        return empty
    sample = labelled_sample(docs, labels, "toxic", modulus, held, per_class)

    def seen(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        doc, bucket, _ = terms(data, offs)
        return [lists(bucket, np.searchsorted(doc, np.arange(len(offs))), pa.int64())]

    held_by = map_texts(sample, ["doc_id", "label"], [T.StructField("buckets", T.ArrayType(T.LongType()))], seen)
    # one row for each bucket: bounded by the size of the hash space
    table = held_by.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("all")).toPandas()
    size = {int(r["label"]): int(r["count"]) for r in sample.groupBy("label").count().collect()}
    if not size.get(0) or not size.get(1):
        return empty
    pos, both = table["pos"].to_numpy(float), table["all"].to_numpy(float)
    rate, n = both / (size[0] + size[1]), size[0] + size[1]
    chi = n * (pos / size[1] - (both - pos) / size[0]) ** 2 * (size[1] / n) * (size[0] / n) / np.maximum(rate * (1 - rate), 1e-9)
    chi = np.where(both >= 3, chi, 0)
    best = table["bucket"].to_numpy()[np.lexsort((table["bucket"], -chi))[:keep]]
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[best] = np.arange(len(best))

    def kept(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        first, window, index, count = window_terms(data, offs, slot)
        at = np.searchsorted(window, first)  # of each document's first window
        own = window - np.repeat(first[:-1], np.diff(at))
        return [pa.array(np.diff(first)), lists(own, at, pa.int64()), lists(index, at, pa.int64()), lists(count, at, pa.int64())]

    fields = [T.StructField("windows", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("window", "index", "count"))]
    rows = map_texts(sample, ["doc_id", "label"], fields, kept).orderBy("doc_id").toPandas()
    many = rows["windows"].to_numpy(np.int64)
    base = np.cumsum(many) - many
    size = rows["window"].map(len).to_numpy(np.int64)
    flat_ = {c: np.concatenate([np.asarray(v, dtype=np.int64) for v in rows[c]]) for c in ("window", "index", "count")}
    window, value = flat_["window"] + np.repeat(base, size), np.log2(1.0 + flat_["count"])
    first = np.searchsorted(window, np.arange(many.sum() + 1))
    y, share = np.repeat(rows["label"].to_numpy(float), many), counts[1] / total

    def fitted(live: np.ndarray, epochs: int) -> Machine:
        """The machine of the windows with ``live`` above 0, weighted to the share of toxic documents."""
        own = float((live * y).sum() / live.sum())
        weight = live * np.where(y == 1, share / own, (1 - share) / (1 - own))
        pick = np.flatnonzero(live)
        length = first[pick + 1] - first[pick]
        at = np.arange(length.sum()) + np.repeat(first[pick] - (np.cumsum(length) - length), length)
        blank = np.zeros(-(-len(pick) // EMPTY), dtype=np.int64)  # windows without terms, which are clean
        first_ = np.concatenate([[0], np.cumsum(np.concatenate([length, blank]))])
        return Machine(slot, *fit(first_, flat_["index"][at], value[at], len(best), np.concatenate([y[pick], blank]), np.concatenate([weight[pick], blank + (1 - share) / (1 - own)]), steps=100 * epochs, epochs=epochs))

    model = fitted(np.ones(len(y)), 6)
    score = model.scored(window, flat_["index"], value, len(y))
    doc = np.repeat(np.arange(len(rows)), many)
    order = np.lexsort((-score, doc))  # of each document the highest window first, the earlier of equals
    top = np.zeros(len(y))
    top[order[base]] = 1
    return fitted(np.where(y == 1, top, 1.0), 20)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 for a toxic one."""
    model = train(docs, labels, modulus, held, per_class)
    return scored(docs, modulus, held, model.score)


def toxicity_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 4, held: int = 2, per_class: int = 3000) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns.

    Each row is judged by its own text, so rows that share an id do not affect each other.
    """
    model = train(docs, labels, modulus, held, per_class)
    names = docs.columns
    body = docs.select(*names) if dict(docs.dtypes)["text"] == "string" else docs.withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.score(*flat(part.column("text"))) < threshold))

    return body.mapInArrow(run, body.schema)
