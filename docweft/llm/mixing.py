"""Mixing by soft membership: document rates whose expected domain token totals match targets.

1. A classifier learned from a labelled table gives every text a posterior over the
   table's domains: softmax regression on hashed terms and a few surface shares.
2. Rates r >= 0 solve  min  sum_j (S_j - T_j)^2 / (N^2 m_j),  S_j = sum_d r_d n_d p_dj,
   with n_d a text's words, p_d its posterior, m_j the domains' present shares of all
   N words and T_j the target totals.  Projected gradient descent starts at r = 1 and
   steps by r_d <- max(0, r_d - eta sum_j p_dj (S_j - T_j) / (N m_j)), the gradient in
   the metric of the words, from a point moved ahead by Nesterov's rule; eta is one over
   the largest eigenvalue of the scaled k x k moment matrix.  A step is one distributed sum of k numbers; as it is the same for
   equal posteriors, rates are replayed from the list of steps and never stored.

The classifier is fitted on at most ``per_class`` labelled rows of each domain, on the
``keep`` hashed terms with the largest chi-square there.  Rows without words have n = 0,
the prior as posterior, and a rate like any other.  Domains without any mass cannot be
matched; the fit then is the least-squares best.  Without labelled rows every text has
the one domain that is left, or none.  An id with several domains counts with the first
of them in order; rows that share an id are judged each by its own text.  Other columns
of ``docs``, whatever their names, are not read by ``mixing_rates`` and kept by ``mixed``.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.learning import labelled_sample, map_texts
from docweft.llm.shared import stored
from docweft.llm.textvec import ALNUM, Spans, flat, lists, slices, trimmed, words

BITS = 18
PREFIX = 6
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ODD = ~ALNUM
_ODD[[ord(c) for c in " \t\r\n\v\f.,;:'\"()-?!"]] = False
SURFACE = 4


def terms_and_surface(data: np.ndarray, offs: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of its distinct terms - words and their beginnings -, surface shares, and words of each text."""
    n = len(offs) - 1
    found = words(data, offs, lower=True)
    count = found.count
    surface = np.zeros((n, SURFACE))
    if not len(found.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), surface, count
    start, end = trimmed(found)
    spans, doc = Spans(found.data), found.doc
    name = spans(start, end)
    long = np.flatnonzero(end - start > PREFIX)
    both = np.concatenate([name, spans(start[long], start[long] + PREFIX) ^ np.uint64(0x5851F42D4C957F2D)])
    owner = np.concatenate([doc, doc[long]])
    bucket = (both >> np.uint64(64 - BITS)).astype(np.int64)
    if slot is not None:
        bucket = slot[bucket]
        live = bucket >= 0
        bucket, owner = bucket[live], owner[live]
    key = np.unique(owner << BITS | bucket)
    again = np.zeros(len(name), dtype=bool)
    again[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])

    def share(flag: np.ndarray, first: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(of, 1)

    size = np.diff(offs)
    surface[:, 0] = share(_UPPER[data], offs, size)
    surface[:, 1] = np.sqrt(share(_ODD[data], offs, size))
    surface[:, 2] = share(again, found.first, count)
    surface[:, 3] = np.log1p(count) / 10
    return key >> BITS, key & ((1 << BITS) - 1), surface, count


@dataclass
class Domains:
    """Softmax regression: slot of each bucket (or -1), weights of kept buckets and surface shares, and biases."""

    names: list[str]
    slot: np.ndarray
    weights: np.ndarray
    surface: np.ndarray
    bias: np.ndarray
    centre: np.ndarray

    def posteriors(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, domains) probabilities and each text's words."""
        doc, index, surface, count = terms_and_surface(data, offs, self.slot)
        z = ((surface - self.centre[0]) / self.centre[1]).clip(-8, 8) @ self.surface + self.bias
        z = np.where(count[:, None] > 0, z, self.bias)
        for j in range(z.shape[1]):
            z[:, j] += np.bincount(doc, weights=self.weights[index, j], minlength=len(z))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), count


def fit(x: np.ndarray, surface: np.ndarray, y: np.ndarray, k: int, prior: np.ndarray, steps: int = 300, ridge: float = 3e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Full-batch Adam on the cross-entropy, each domain weighted to its prior."""
    centre = np.stack([surface.mean(axis=0), surface.std(axis=0) + 1e-3])
    both = np.concatenate([x, ((surface - centre[0]) / centre[1]).clip(-8, 8)], axis=1).astype(np.float32)
    weight = (prior / np.maximum(np.bincount(y, minlength=k) / len(y), 1e-9))[y] / len(y)
    target = np.eye(k)[y]
    w, b = np.zeros((both.shape[1], k)), np.log(np.maximum(prior, 1e-6))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = both @ w.astype(np.float32) + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * weight[:, None]
        for param, grad, m, v in ((w, both.T @ g.astype(np.float32) + ridge * w, *state[:2]), (b, g.sum(axis=0), *state[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[: x.shape[1]], w[x.shape[1] :], b, centre


def train(docs: DataFrame, labelled: DataFrame, per_class: int = 1500, keep: int = 768) -> Domains:
    """Learn the domains of the labelled table (doc_id, domain)."""
    labelled = labelled.select("doc_id", F.col("domain").cast("string").alias("domain")).filter("domain IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    names = sorted(counts)
    none = np.full(1 << BITS, -1, dtype=np.int32)
    k = max(1, len(names))
    flat_model = Domains(names or ["all"], none, np.zeros((1, k)), np.zeros((SURFACE, k)), np.log(np.array([counts[d] for d in names] or [1.0])), np.stack([np.zeros(SURFACE), np.ones(SURFACE)]))
    if k < 2:
        return flat_model
    sample = labelled_sample(docs, labelled, "domain", 1, -1, per_class)

    def seen(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        doc, bucket, surface, _ = terms_and_surface(data, offs)
        return [lists(bucket, np.searchsorted(doc, np.arange(len(offs))), pa.int64()), pa.array(list(surface), pa.list_(pa.float64()))]

    fields = [T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("surface", T.ArrayType(T.DoubleType()))]
    rows = stored(map_texts(sample, ["doc_id", "label"], fields, seen), "terms")
    size = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(size) < 2:
        return flat_model
    # bounded by the size of the hash space times the domains
    table = rows.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket", "label").count().toPandas()
    own = np.zeros((1 << BITS, k))
    own[table["bucket"], [names.index(x) for x in table["label"]]] = table["count"]
    total = np.array([size.get(d, 0) for d in names], dtype=float)
    rate = own.sum(axis=1, keepdims=True) / total.sum()
    chi = ((own - rate * total) ** 2 / np.maximum(rate * (1 - rate) * total, 1e-9)).sum(axis=1) * (own.sum(axis=1) >= 3)
    best = np.argsort(-chi, kind="stable")[:keep]
    slot = none.copy()
    slot[best] = np.arange(len(best))
    data = rows.orderBy("doc_id", "label").select("label", F.array_sort(F.array_intersect("buckets", F.lit(best.tolist()))).alias("buckets"), "surface").toPandas()
    x = np.zeros((len(data), len(best)), dtype=np.float32)
    for i, buckets in enumerate(data["buckets"]):
        x[i, slot[np.asarray(buckets, dtype=np.int64)]] = 1
    y = np.array([names.index(d) for d in data["label"]])
    prior = np.array([counts[d] for d in names], dtype=float) / sum(counts.values())
    w, s, b, centre = fit(x, np.stack(data["surface"]), y, k, prior)
    return Domains(names, slot, w, s, b, centre)


def posteriors(docs: DataFrame, model: Domains, kept: list[str]) -> DataFrame:
    """``kept`` columns, n_words and p (a probability for each domain) of every row, stored."""

    def kernel(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        p, count = model.posteriors(data, offs)
        return [pa.array(count), lists(p.ravel(), np.arange(len(p) + 1) * p.shape[1], pa.float64())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    return stored(map_texts(docs, kept, fields, kernel), "posteriors")


#: Steps without a smaller miss after which the targets count as out of reach.
STALL = 50
_log = logging.getLogger(__name__)


def replayed(p: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of texts with posteriors ``p`` after the given steps, and the point ahead of them at which the next step is taken."""
    r = ahead = np.ones(len(p))
    for t, g in enumerate(steps):
        last, r = r, np.maximum(0, ahead - p @ g)
        ahead = r + t / (t + 3) * (r - last)
    return r, ahead


def _sums(table: DataFrame, k: int, steps: list[np.ndarray], moments: bool = False) -> np.ndarray:
    """Sums over all rows of r n p and of the same at the point ahead, or of n p p' and n p."""
    size = k * k + k if moments else 2 * k
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("x", T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            n, p = batch.column("n_words").to_numpy().astype(float), batch.column("p").flatten().to_numpy().reshape(-1, k)
            total += np.concatenate([((p * n[:, None]).T @ p).ravel(), n @ p]) if moments else np.concatenate([(r * n) @ p for r in replayed(p, steps)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "x"])

    out = np.zeros(size)
    for row in table.select("n_words", "p").mapInArrow(add, schema).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[row.i] = row.x
    return out


def solve(table: DataFrame, names: list[str], weights: dict[str, float], budget: float = 1.0, tolerance: float = 1e-4, most: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient, reached totals and target totals; targets are shares of ``budget`` times all words.

    Steps go on until the totals are met, or until the largest miss has not fallen by a twentieth
    for ``STALL`` steps, as where rates of at least 0 cannot meet the targets (or for ``most`` steps).
    The totals are logged, a miss as a warning.
    """
    k = len(names)
    both = _sums(table, k, [], moments=True)
    moment, mass = both[: k * k].reshape(k, k), both[k * k :]
    total = mass.sum()
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in names])
    goal = budget * total * share / max(share.sum(), 1e-12)
    if total == 0:
        return [], mass, goal
    m = np.maximum(mass / total, 1e-9)
    eta = 1 / max(float(np.linalg.eigvalsh(moment / total / np.sqrt(np.outer(m, m))).max()), 1e-9)
    steps: list[np.ndarray] = []
    reached = ahead = mass
    best, since = np.inf, 0
    while (miss := np.abs(reached - goal).max()) > tolerance * budget * total and len(steps) != most:
        best, since = (miss, 0) if miss < 0.95 * best else (best, since + 1)
        if since >= STALL:
            break
        steps.append(eta * (ahead - goal) / total / m)
        reached, ahead = np.split(_sums(table, k, steps), 2)
    met = miss <= tolerance * budget * total
    _log.log(logging.INFO if met else logging.WARNING, "mixing targets %s after %d steps: reached %s, wanted %s words of %s", "met" if met else "missed", len(steps), reached.round().tolist(), goal.round().tolist(), names)
    return steps, reached, goal


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, per_class: int = 1500) -> DataFrame:
    """(doc_id, n_words, domain, p, rate) of every row: the likeliest domain, all posteriors, and the rate to use the row at."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(source, labelled, per_class)
    table = posteriors(source, model, ["doc_id"])
    steps, _, _ = solve(table, model.names, weights, budget)
    names, k = model.names, len(model.names)
    schema = T.StructType([table.schema["doc_id"], table.schema["n_words"], T.StructField("domain", T.StringType()), table.schema["p"], T.StructField("rate", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, k)
            domain = pa.array(np.array(names, dtype=object)[p.argmax(axis=1)] if len(p) else [], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), domain, batch.column("p"), pa.array(replayed(p, steps)[0])], schema.names)

    return table.mapInArrow(apply, schema)


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, per_class: int = 1500) -> DataFrame:
    """The rows to use, with ``rate`` and ``copies``: the rate rounded up or down by a hash of the id; rows at 0 copies go.

    Each row is judged by its own text.  Columns named rate or copies are replaced.
    """
    model = train(docs, labelled, per_class)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    steps, _, _ = solve(posteriors(source.select("text"), model, []), model.names, weights, budget)
    kept = [c for c in docs.columns if c not in ("rate", "copies")]
    body = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in kept))
    schema = T.StructType([*body.schema, T.StructField("rate", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p, _ = model.posteriors(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replayed(p, steps)[0])], schema.names)

    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return body.mapInArrow(apply, schema).withColumn("copies", F.floor(F.col("rate") + uniform).cast("int")).filter("copies > 0")
