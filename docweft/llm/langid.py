"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a text in either direction; a linear
layer on both states labels every position, and a document's probabilities are the
mean of those of its letter positions.  Texts are read whole.  To run in many lanes at
once they are cut into spans of ``SPAN`` bytes; each lane also reads up to ``CONTEXT``
bytes on either side, which carry both states over the cuts and whose own labels are
left to the neighbouring spans, so every position counts once.  Gates use a clipped
line in place of the logistic curve and candidates a clipped line in place of tanh,
which numpy computes several times faster.

The network is trained here by backpropagation through time over pieces of ``PIECE``
bytes, on every byte of at most ``per_class`` documents of each language.  Text and
language of training rows are all it learns from; an id with several languages counts
with the first of them in order, repeated rows are labelled one by one, and other
columns, whatever their names, are not read.  Texts that are null or without a letter
are ``und`` with score 0; so is every text when no language can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.learning import labelled_sample, map_texts, remainder
from docweft.llm.textvec import flat, slices

#: Bytes that a lane labels, and bytes that it reads before and behind them.
SPAN, CONTEXT = 256, 32
#: Bytes over which training goes back through time.
PIECE = 64
HIDDEN = 10
#: Lanes that one numpy step covers.
LANES = 1024
#: Pieces that training sees in all, at least: short samples are gone through several times.
SEEN = 60_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PADDING = 256


def _clip01(x: np.ndarray) -> np.ndarray:
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def run_direction(table: np.ndarray, inner: np.ndarray, bias: np.ndarray, x: np.ndarray, steps: range, out: np.ndarray, pad: np.ndarray | None) -> None:
    """Write the states of one direction into ``out`` (span, hidden, lanes); padded positions keep a zero state."""
    hidden = inner.shape[1]
    h = np.zeros((hidden, x.shape[1]), dtype=np.float32)
    for t in steps:
        a = np.take(table, x[t], axis=1)
        u = inner @ h
        gate = a[: 2 * hidden]
        gate += u[: 2 * hidden]
        _clip01(gate)
        n = u[2 * hidden :]
        n += bias
        n *= gate[hidden:]
        n += a[2 * hidden :]
        np.clip(n, -1, 1, out=n)
        h = out[t]
        np.subtract(out[t - steps.step] if t != steps[0] else 0, n, out=h)
        h *= gate[:hidden]
        h += n
        if pad is not None:
            h *= pad[t]


@dataclass
class Network:
    """Parameters: for each direction (input table, inner weights, candidate bias); output weights and bias."""

    languages: list[str]
    ways: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    out: np.ndarray
    bias: np.ndarray

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (span, languages, lanes) of every position of byte spans (span, lanes)."""
        span, lanes = x.shape
        hidden = self.ways[0][1].shape[1]
        pad = (x != PADDING).astype(np.float32)[:, None, :] if (x == PADDING).any() else None
        states = np.empty((span, 2 * hidden, lanes), dtype=np.float32)
        for way, steps, rows in ((self.ways[0], range(span), slice(0, hidden)), (self.ways[1], range(span - 1, -1, -1), slice(hidden, None))):
            run_direction(*way, x, steps, states[:, rows], pad)
        logits = np.matmul(self.out, states) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def documents(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean probabilities (documents, languages) over letter positions; zero rows without letters."""
        n, k = len(offs) - 1, len(self.languages)
        total, seen = np.zeros((n, k)), np.zeros(n)
        for x, doc, fresh in spans(data, offs):
            p = self.positions(x)
            live = (fresh & _LETTER[np.minimum(x, 255)] & (x != PADDING)).astype(np.float32)
            np.add.at(seen, doc, live.sum(axis=0))
            np.add.at(total, doc, np.einsum("skl,sl->lk", p, live))
        return total / np.maximum(seen, 1)[:, None]


def spans(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes (span with context, lanes), document of each lane, positions that the lane labels) in groups of lanes."""
    size = np.diff(offs)
    many = -(-size // SPAN)
    doc = np.repeat(np.arange(len(size)), many)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = offs[doc] + rank * SPAN
    length = np.minimum(offs[doc + 1] - begin, SPAN)
    order = np.argsort(length, kind="stable")  # lanes of one group are about as long
    for i in range(0, len(order), LANES):
        own = order[i : i + LANES]
        lead = np.minimum(begin[own] - offs[doc[own]], CONTEXT)
        at = np.arange(-int(lead.max()), int(length[own].max()) + CONTEXT)[:, None]
        place = begin[own] + at
        inside = (place >= offs[doc[own]]) & (place < offs[doc[own] + 1])
        x = np.where(inside, data[np.clip(place, 0, len(data) - 1)].astype(np.int64), PADDING)
        yield x, doc[own], inside & (at >= 0) & (at < SPAN)


def _states(way, x: np.ndarray, steps: range) -> list[tuple]:
    """Training pass of one direction: all intermediate values of each step."""
    table, inner, bias = way
    hidden = inner.shape[1]
    h, kept = np.zeros((hidden, x.shape[1]), dtype=np.float32), []
    for t in steps:
        a, u = table[:, x[t]], inner @ h
        gate = np.clip(a[: 2 * hidden] + u[: 2 * hidden] + 0.5, 0, 1)
        z, r, un = gate[:hidden], gate[hidden:], u[2 * hidden :] + bias
        raw = a[2 * hidden :] + r * un
        n = np.clip(raw, -1, 1)
        new = n + z * (h - n)
        live = (x[t] != PADDING).astype(np.float32)
        kept.append((t, h, z, r, un, raw, n, live))
        h = new * live
        kept[-1] += (h,)
    return kept


def _back(way, x: np.ndarray, kept: list[tuple], outer: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of one direction; ``outer`` is the loss gradient of each state."""
    table, inner, bias = way
    g_table, g_inner, g_bias = np.zeros_like(table), np.zeros_like(inner), np.zeros_like(bias)
    dh = np.zeros_like(outer[0])
    eye = np.eye(table.shape[1], dtype=np.float32)
    for t, h, z, r, un, raw, n, live, _ in reversed(kept):
        d = (dh + outer[t]) * live
        dz = d * (h - n) * ((z > 0) & (z < 1))
        dn = d * (1 - z) * (np.abs(raw) < 1)
        dr = dn * un * ((r > 0) & (r < 1))
        du = np.concatenate([dz, dr, dn * r])
        g_inner += du @ h.T
        g_bias += du[-len(n) :].sum(axis=1, keepdims=True)
        g_table += np.concatenate([dz, dr, dn]) @ eye[x[t]]
        dh = d * z + inner.T @ du
    return [g_table, g_inner, g_bias]


def loss_and_gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions and the gradients of (two ways of three arrays, output weights, bias)."""
    ways, out, bias = (params[0:3], params[3:6]), params[6], params[7]
    span, lanes = x.shape
    hidden = out.shape[1] // 2
    kept = [_states(ways[0], x, range(span)), _states(ways[1], x, range(span - 1, -1, -1))]
    states = np.empty((span, 2 * hidden, lanes), dtype=params[0].dtype)
    for own, rows in zip(kept, (slice(0, hidden), slice(hidden, None)), strict=True):
        for step in own:
            states[step[0], rows] = step[-1]
    logits = np.matmul(out, states) + bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    live = (x != PADDING).astype(p.dtype)
    n, lane = live.sum(), np.arange(lanes)
    loss = float(-(np.log(p[:, y, lane] + 1e-12) * live).sum() / n)
    p[:, y, lane] -= 1
    p *= live[:, None, :] / n
    grads = []
    for own, way, rows in zip(kept, ways, (slice(0, hidden), slice(hidden, None)), strict=True):
        grads += _back(way, x, own, np.matmul(out[:, rows].T, p))
    grads.append(np.einsum("skl,shl->kh", p, states))
    grads.append(p.sum(axis=(0, 2))[:, None])
    return loss, grads


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], hidden: int = HIDDEN, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 3) -> Network:
    """Train on pieces ``x`` (bytes, lanes) of languages ``y`` by Adam, its rate falling to nothing; deterministic."""
    rng = np.random.default_rng(seed)
    params: list[np.ndarray] = []
    for _ in range(2):
        params += [rng.normal(0, 0.3, (3 * hidden, 257)), rng.normal(0, 0.25, (3 * hidden, hidden)), np.zeros((hidden, 1))]
    params += [rng.normal(0, 0.2, (len(languages), 2 * hidden)), np.zeros((len(languages), 1))]
    params = [p.astype(np.float32) for p in params]
    total = epochs * -(-x.shape[1] // batch)
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, grads = loss_and_gradients(params, x[:, rows].astype(np.int64), y[rows])
            t += 1
            scale = min(1.0, 1.0 / (float(np.sqrt(sum((g**2).sum() for g in grads))) + 1e-9))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g * scale
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - (t - 1) / total) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Network(languages, [tuple(params[0:3]), tuple(params[3:6])], params[6], params[7])


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch as pieces (lanes, ``PIECE``), padded, and the document of each."""
    size = np.diff(offs)
    many = -(-size // PIECE)
    doc = np.repeat(np.arange(len(size)), many)
    place = (offs[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * PIECE)[:, None] + np.arange(PIECE)
    if not len(place):
        return np.zeros((0, PIECE), np.uint16), doc
    return np.where(place < offs[doc + 1][:, None], data[np.minimum(place, len(data) - 1)].astype(np.uint16), np.uint16(PADDING)), doc


def train(docs: DataFrame, modulus: int = 5, held: int = 0, per_class: int = 400) -> Network | None:
    """Learn the languages of rows whose remainder is not ``held``; the sampled texts have to fit the driver."""
    sample = labelled_sample(docs, docs.select("doc_id", F.col("lang").cast("string").alias("lang")), "lang", modulus, held, per_class)

    def cut(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        x, doc = pieces(data, offs)
        first = 2 * PIECE * np.searchsorted(doc, np.arange(len(offs)))
        return [pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])]

    rows = map_texts(sample, ["doc_id", "label"], [T.StructField("pieces", T.BinaryType())], cut).orderBy("doc_id", "label").toPandas()
    languages = sorted(set(rows["label"]))
    own = [np.frombuffer(p, np.uint16).reshape(-1, PIECE) for p in rows["pieces"]]
    if not languages or not sum(map(len, own)):
        return None
    y = np.repeat([languages.index(x) for x in rows["label"]], [len(p) for p in own])
    return fit(np.concatenate(own).T, y, languages, epochs=max(1, -(-SEEN // len(y))))


def languages_of(docs: DataFrame, modulus: int = 5, held: int = 0, per_class: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, modulus, held, per_class)
    text = F.col("text").cast("string")
    df = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))
    schema = T.StructType([df.schema["doc_id"], df.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                known = part.column("letters").to_numpy(zero_copy_only=False).astype(bool) if model else np.zeros(n, dtype=bool)
                p = model.documents(*flat(part.column("text"))) if model else np.zeros((n, 1))
                names = np.array([*(model.languages if model else []), "und"], dtype=object)
                best = np.where(known, p.argmax(axis=1), len(names) - 1)
                score = np.where(known, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], schema.names)

    return df.mapInArrow(run, schema)
