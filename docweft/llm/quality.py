"""Quality by Bradley-Terry ranking: documents are scored so that preferred ones win their pairs.

A document's worth is linear in surface features of its whole text (and their squares)
and in hashed terms: words and pairs of neighbouring words, lower-cased and without
outer punctuation, by the logarithm of their count a thousand words.  Training pairs
one good with one bad document at a time and minimises the logistic loss of the
difference of their features (no intercept: only differences matter).  The worth
below which the labelled share of bad documents lies - a score quantile - becomes
the score 0.3, so that ``score >= 0.3`` keeps the labelled share of good ones.

The model is fitted on all labelled rows with a text that are not held out: the ``keep`` term
buckets with the largest chi-square, means, weights and the cut come from all of them.
Weights are averages of what tasks learn from random pairs of their own rows, round by round;
without rows of both classes every document scores 0.5.  Null and empty texts are
documents without words and get the score of their (zero) features.  An id with several
labels counts with the smallest; repeated rows are scored one by one.  Columns of
``docs`` other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.learning import class_counts, labelled_rows, map_texts, scored, sigmoid, summed
from docweft.llm.shared import bounded_batches, stored
from docweft.llm.textvec import ALNUM, Spans, distinct_sorted, flat, lists, mix64, shingle_names, slices, trimmed, word_names, words

#: Terms are hashed into 2**BITS buckets.
BITS = 18

FEATURES = ("log_words", "word_bytes", "distinct_words", "repeated_word", "upper", "symbols", "stops", "lone_symbols", "digits", "distinct_triples", "odd_endings", "lines", "end_marks", "log_unique")
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLAIN = ALNUM.copy()
_PLAIN[[ord(c) for c in " \t\r\n\v\f.,;:'\"()-?!"]] = True


def _per_doc(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document, all zero for a document without words."""
    found = words(data, offs)
    n = np.maximum(found.count, 1)
    size = np.maximum(np.diff(offs), 1)
    name = word_names(found)
    doc_first = np.zeros(len(name) + 1, dtype=bool)
    doc_first[found.first] = True
    again = np.zeros(len(name), dtype=bool)
    again[1:] = (name[1:] == name[:-1]) & ~doc_first[1 : len(name)]
    unique = np.diff(distinct_sorted(name, found.first)[1])
    triple, triple_first = shingle_names(name, found.first, 3)
    triples = np.diff(distinct_sorted(triple, triple_first)[1])
    last, alone = (data[found.end - 1], found.end - found.start == 1) if len(name) else (np.zeros(0, np.uint8), np.zeros(0, bool))
    letters = np.maximum(_per_doc(_LETTER[data], offs), 1)
    out = np.stack(
        [
            np.log1p(found.count),
            _per_doc(found.end - found.start, found.first) / n / 10,
            unique / n,
            _per_doc(again, found.first) / n,
            _per_doc(_UPPER[data], offs) / letters,
            _per_doc(~_PLAIN[data], offs) / size,
            _per_doc((last == 46) | (last == 44), found.first) / n,
            _per_doc(alone & ~ALNUM[last], found.first) / n,
            _per_doc((data >= 48) & (data < 58), offs) / size,
            triples / np.maximum(np.diff(triple_first), 1),
            _per_doc(~_PLAIN[last], found.first) / n,
            _per_doc(data == 10, offs) / n,
            _per_doc(last == 33, found.first) / n,
            np.log1p(unique),
        ],
        axis=1,
    )
    return np.where(found.count[:, None] > 0, out, 0.0)


def terms(data: np.ndarray, offs: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the distinct terms of a batch; ``slot`` renumbers buckets and drops those at -1."""
    found = words(data, offs, lower=True)
    if not len(found.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    name, doc = Spans(found.data)(*trimmed(found)), found.doc
    near = np.flatnonzero(doc[1:] == doc[:-1])
    both = np.concatenate([name, mix64(name[near] * np.uint64(0xA0761D6478BD642F) + name[near + 1])])
    bucket, owner = (both >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([doc, doc[near]])
    if slot is not None:
        bucket = slot[bucket].astype(np.int64)
        live = bucket >= 0
        bucket, owner = bucket[live], owner[live]
    key, count = np.unique(owner << BITS | bucket, return_counts=True)
    owner = key >> BITS
    return owner, key & ((1 << BITS) - 1), np.log2(1 + 1000 * count / found.count[owner]) / 4


@dataclass
class Ranking:
    """Worth = weights . scaled features + term weights . terms; ``cut`` is the worth at the score 0.3."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slot: np.ndarray
    term_weights: np.ndarray
    cut: float

    def worth(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, index, value = terms(data, offs, self.slot)
        out = expanded((features(data, offs) - self.mean) / self.scale) @ self.weights
        return out + np.bincount(doc, weights=self.term_weights[index] * value, minlength=len(out))

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sigmoid(self.worth(data, offs) - self.cut + np.log(0.3 / 0.7))


def expanded(z: np.ndarray) -> np.ndarray:
    """Scaled features with their squares, so that a middle range can be preferred."""
    z = np.clip(z, -8, 8)
    return np.concatenate([z, z * z / 4], axis=1)


#: Passes over all training rows, steps of each on the rows that a task holds at a time, and pairs of a step.
ROUNDS, STEPS, PAIRS, ROWS = 6, 50, 2048, 8192
FIELDS = [T.StructField("x", T.ArrayType(T.FloatType())), T.StructField("index", T.ArrayType(T.ShortType())), T.StructField("value", T.ArrayType(T.FloatType()))]


def chosen(rows: DataFrame, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with the largest chi-square over all training rows, and how many of these are bad and good."""
    size = 1 << BITS

    def seen(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(2 * size + 2)
        for part in slices(batch, "text"):
            label = part.column("label").to_numpy()
            doc, bucket, _ = terms(*flat(part.column("text")))
            out += np.concatenate([np.bincount(bucket[label[doc] == 1], minlength=size), np.bincount(bucket, minlength=size), [(label == 0).sum(), (label == 1).sum()]])
        return out

    found = summed(rows.filter("label IN (0, 1)").select("text", "label"), seen)
    if not len(found) or not found[-2:].all():
        return np.zeros(0, np.int64), np.zeros(2)
    good, both, (bad_n, good_n) = found[:size], found[size:-2], found[-2:]
    n = bad_n + good_n
    rate = both / n
    chi = np.where(both >= 3, n * (good / good_n - (both - good) / bad_n) ** 2 / np.maximum(rate * (1 - rate), 1e-9), 0)
    live = np.flatnonzero(both)
    return live[np.lexsort((live, -chi[live]))[:keep]], found[-2:]


def _dense(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray, keep: int) -> np.ndarray:
    """Scaled features with their squares, then terms, of a batch of stored rows."""
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
    t = np.zeros((batch.num_rows, keep), dtype=np.float32)
    t[np.repeat(np.arange(batch.num_rows), batch.column("index").value_lengths().to_numpy()), batch.column("index").flatten().to_numpy()] = batch.column("value").flatten().to_numpy()
    return np.concatenate([expanded((x - mean) / scale).astype(np.float32), t], axis=1)


def improved(w: np.ndarray, both: np.ndarray, label: np.ndarray, turn: int, ridge: float = 1e-3, seed: int = 7) -> np.ndarray | None:
    """Weights after Adam steps on random (good, bad) pairs of some rows; None without rows of both classes."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng([seed, turn])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        diff = both[rng.choice(good, PAIRS)] - both[rng.choice(bad, PAIRS)]
        grad = -sigmoid(-(diff @ w)) @ diff / PAIRS + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        rate = 0.05 * (1 - (turn * STEPS + step) / (ROUNDS * STEPS + 1))
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def fit(rows: DataFrame, slot: np.ndarray, keep: int, size: np.ndarray, share_bad: float) -> Ranking:
    """Fit the ranking on all stored rows (label, x, index, value) and find its cut among all of them.

    In a round each task improves the weights on the rows it holds, at most ``ROWS`` at a time, and the
    weights that come from it are averaged by their rows.
    """
    width = len(FEATURES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
        return np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])

    sums = summed(rows, moments) / size.sum()
    mean = sums[:width]
    scale = np.sqrt(np.maximum(sums[width:] - mean * mean, 0)) + 1e-6
    w = np.zeros(2 * width + keep, dtype=np.float32)
    for turn in range(ROUNDS):

        def step(batch: pa.RecordBatch, w=w, turn=turn) -> np.ndarray:
            out = np.zeros(len(w) + 1)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = improved(w, _dense(part, mean, scale, keep), part.column("label").to_numpy(), turn)
                if found is not None:
                    out += np.append(found.astype(np.float64), 1) * part.num_rows
            return out

        both = summed(rows, step, ROWS)
        if both[-1]:
            w = (both[:-1] / both[-1]).astype(np.float32)
    w = w.astype(np.float64)
    return Ranking(mean, scale, w[: 2 * width], slot, w[2 * width :], _cut(rows, mean, scale, keep, w, size, share_bad))


def _cut(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, keep: int, w: np.ndarray, size: np.ndarray, share_bad: float, bins: int = 4096) -> float:
    """The worth below which ``share_bad`` of all rows lie, each class with its share of the labels: counts in bins, then in the bins of the one that has it."""

    def counted(low: float, high: float) -> np.ndarray:
        def count(batch: pa.RecordBatch) -> np.ndarray:
            worth, label = _dense(batch, mean, scale, keep) @ w, batch.column("label").to_numpy()
            at = np.clip(np.floor((worth - low) / (high - low) * bins), -1, bins).astype(np.int64) + 1
            return np.concatenate([np.bincount(at[label == k], minlength=bins + 2) for k in (0, 1)])

        return (summed(rows, count).reshape(2, -1) * np.array([[share_bad / size[0]], [(1 - share_bad) / size[1]]])).sum(axis=0)

    reach = 8 * np.abs(w[: len(FEATURES)]).sum() + 16 * np.abs(w[len(FEATURES) : 2 * len(FEATURES)]).sum() + 3 * np.abs(w[2 * len(FEATURES) :]).sum() + 1e-9  # no worth lies beyond
    low, high = -reach, reach
    for _ in range(2):
        total = np.cumsum(counted(low, high))
        at = int(np.clip(np.searchsorted(total, share_bad * (1 - 1e-12)) - 1, 0, bins - 1))
        low, high = low + (high - low) * at / bins, low + (high - low) * (at + 1) / bins
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, keep: int = 1024) -> Ranking | None:
    """Learn from all labelled rows whose remainder is not ``held``."""
    counts = class_counts(labels, "quality", modulus, held)
    if not counts.get(0) or not counts.get(1):
        return None
    bounded_batches(docs.sparkSession)
    rows = labelled_rows(docs, labels, "quality", modulus, held)
    best, size = chosen(rows, keep)
    if not len(best):
        return None
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[best] = np.arange(len(best))

    def kept(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        doc, index, value = terms(data, offs, slot)
        first = np.searchsorted(doc, np.arange(len(offs)))
        x = features(data, offs).astype(np.float32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel())), lists(index.astype(np.int16), first, pa.int16()), lists(value.astype(np.float32), first, pa.float32())]

    made = map_texts(rows.filter("label IN (0, 1)"), ["doc_id", "label"], FIELDS, kept)
    # dealt by the hash of the id, so that every task has rows of both classes, and in its order, whatever files they came from
    dealt = made.repartition(max(1, int(size.sum()) // (4 * ROWS) + 1), F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)))
    table = stored(dealt.select("label", "x", "index", "value"), "features")
    return fit(table, slot, len(best), size, counts[0] / (counts[0] + counts[1]))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, modulus, held)
    return scored(docs, modulus, held, lambda data, offs: model.score(data, offs) if model else np.full(len(offs) - 1, 0.5))
