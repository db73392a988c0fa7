"""Cross-entropy difference: how much more like the target than like the corpus a text reads.

Two interpolated bigram models share one vocabulary: the background is counted over
all texts, the target over all texts of a labelled table.  Moore and Lewis,
"Intelligent selection of language model training data" (2010).

* The vocabulary has all words of the corpus and is never gathered in one place.  Only
  where a caller asks for a ``share`` above 0, words that make up less of all running
  words are one unknown word.  Every text begins with a start symbol.
* Words and bigrams are counted one by one, by 64-bit names.  A task reads its texts in
  chunks of about 2**bits words; of each chunk the distinct words and bigrams go, with
  their counts, to buckets of names, where the counts of all chunks meet.  A bucket
  answers each chunk with the totals of that chunk's own names, in their order.  The
  number of buckets grows with the corpus, so that a bucket's size does not, and a name
  comes once from each chunk, however common it is.
* P(w | v) = (c(v w) + ALPHA P(w)) / (c(v) + ALPHA), with P(w) add-half smoothed.

A text's score is the mean over its words of (target loss - background loss), in nats:
the lower, the more like the target.  Texts without words (null, empty) have losses
and score 0.  Without target texts both models are uniform on the target side.  Rows
may repeat or share an id; a target id stands for all rows that bear it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.bitfilter import bit_filter, packed_slices, packed_texts, unpacked
from docweft.llm.shared import stored
from docweft.llm.textvec import flat, mix64, release, slices, word_names, words

#: Every word that occurs is known, at any size of the corpus.
SHARE = 0.0
#: A chunk is closed at 2**BITS words; it bounds a task's memory and has no part in the scores.
BITS = 20
ALPHA = 2.0
#: Distinct words that a task gathers before it hands their counts on.
GATHER = 1 << 20
#: Bytes of text for each bucket of names.
BUCKET_BYTES = 8 << 20
#: Names of the start symbol and of the unknown word.
START, UNKNOWN = mix64(np.array([0x57A27, 0x04C0], dtype=np.uint64))

_COUNTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    if "packed" in batch.schema.names:
        for part in packed_slices(batch, "packed"):
            yield part, *flat(unpacked(part.column("packed")))
    else:
        for part in slices(batch, "text"):
            yield part, *flat(part.column("text"))


def word_counts(df: DataFrame) -> DataFrame:
    """(key, n): how often each word (by name) occurs in all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ns)], ["key", "n"])

        for batch in batches:
            for _, data, offs in _texts(batch):
                name, n = np.unique(word_names(words(data, offs, lower=True)), return_counts=True)
                if len(keys):
                    both, at = np.unique(np.concatenate([keys, name]), return_inverse=True)
                    keys, ns = both, np.bincount(at, weights=np.concatenate([ns, n])).astype(np.int64)
                else:
                    keys, ns = name, n
                if len(keys) > GATHER:
                    yield out()
                    keys, ns = keys[:0], ns[:0]
        yield out()

    return df.mapInArrow(count, _COUNTS).groupBy("key").agg(F.sum("n").alias("n"))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as compressed bytes, byte by byte of significance."""
    head = np.array([len(arrays), *map(len, arrays)], dtype=np.int64)
    planes = [np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *planes]))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    many = int(data[:8].view(np.int64)[0])
    out, at = [], 8 * (1 + many)
    for n in data[8:at].view(np.int64).tolist():
        out.append(np.ascontiguousarray(data[at : at + 8 * n].reshape(8, n).T).reshape(-1).view(np.uint64))
        at += 8 * n
    return out


def _steps(names: np.ndarray) -> np.ndarray:
    return np.diff(names, prepend=np.uint64(0))


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each name; it rises with the name."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _before(own: np.ndarray, count: np.ndarray, start: int) -> np.ndarray:
    """The word before each word of texts with ``count`` words each."""
    before = np.concatenate([[start], own[:-1]]) if len(own) else own
    before[(np.cumsum(count) - count)[count > 0]] = start
    return before


def _pairs(names: np.ndarray, own: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct bigrams, ascending; the order that sorts them; and each word's bigram before that."""
    code, pair = np.unique(before * len(names) + own, return_inverse=True)
    name = mix64(names[code // len(names)] * np.uint64(0xA0761D6478BD642F) + names[code % len(names)])
    order = np.argsort(name, kind="stable")
    return name[order], order, pair


def chunks(df: DataFrame, known: np.ndarray | None, bits: int, target: bool = False) -> DataFrame:
    """(chunk, blob, docs): texts as numbers of the chunk's words.  Chunks of the ``target`` have a negative number, and no ids."""
    kind = T.LongType() if target else df.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("docs", T.ArrayType(kind))])

    def closed(number: int, parts: list, ids: list) -> pa.RecordBatch:
        names, own = np.unique(np.concatenate([np.array([START]), *(p[0] for p in parts)]), return_inverse=True)
        blob = _pack(_steps(names), np.concatenate([p[1] for p in parts]), own[1:])
        held = pa.array([], pa.int64()) if target else pa.chunked_array(ids).combine_chunks()
        docs = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), docs], schema.names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, ids, held = TaskContext.get().partitionId() << 32, [], [], 0
        sign = -1 if target else 1
        for batch in batches:
            for part, data, offs in _texts(batch):
                found = words(data, offs, lower=True)
                name = word_names(found)
                if known is not None:
                    name[~np.isin(name, known)] = UNKNOWN
                parts.append((name, found.count))
                if not target:
                    ids.append(part.column("doc_id"))
                held += len(name)
                if held >= 1 << bits:
                    number += 1
                    yield closed(sign * number, parts, ids)
                    parts, ids, held = [], [], 0
                    release()
        if parts:
            yield closed(sign * (number + 1), parts, ids)

    return df.mapInArrow(gather, schema)


def _texts_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of a chunk's words, words of each text, and the word and the word before of each place."""
    steps, count, own = _unpack(blob)
    names, count, own = np.cumsum(steps, dtype=np.uint64), count.astype(np.int64), own.astype(np.int64)
    return names, count, own, _before(own, count, int(np.searchsorted(names, START)))


_PARTS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def counts_by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, blob): names of a chunk's words and bigrams and their counts, for each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                names, _, own, before = _texts_of(blob.as_py())
                n, context = (np.bincount(x, minlength=len(names)) for x in (own, before))
                pair_names, order, pair = _pairs(names, own, before)
                pair_n = np.bincount(pair, minlength=len(order))[order]
                edges, pair_edges = (np.searchsorted(_bucket(x, buckets), np.arange(buckets + 1)) for x in (names, pair_names))
                some = np.flatnonzero((np.diff(edges) > 0) | (np.diff(pair_edges) > 0)).tolist()
                blobs = []
                for b in some:
                    w, p = slice(edges[b], edges[b + 1]), slice(pair_edges[b], pair_edges[b + 1])
                    blobs.append(_pack(_steps(names[w]), n[w], context[w], _steps(pair_names[p]), pair_n[p]))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], _PARTS.names)
                release()

    return df.select("chunk", "blob").mapInArrow(count, _PARTS)


_TOTALS = T.StructType([T.StructField(c, k) for c, k in (("chunk", T.LongType()), ("bucket", T.IntegerType()), ("blob", T.BinaryType()), ("known", T.LongType()), ("n", T.LongType()), ("t", T.LongType()))])


def _summed(names: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct names, the place of each given name among them, and the sums of each kind of count."""
    name, at = np.unique(np.concatenate(names), return_inverse=True)
    return name, at, [np.bincount(at, weights=np.concatenate(c), minlength=len(name)).astype(np.int64) for c in counts]


def totals(table: pa.Table) -> pa.Table:
    """The totals of a bucket, for each chunk of the background in the order of its names; and the sums of the bucket (chunk 0)."""
    chunk = table.column("chunk").to_numpy()
    blobs = [_unpack(b) for b in table.column("blob").to_pylist()]
    size, pair_size = [len(b[0]) for b in blobs], [len(b[3]) for b in blobs]
    sides = [(c > 0, c < 0) for c in chunk.tolist()]
    name, at, counts = _summed([np.cumsum(b[0], dtype=np.uint64) for b in blobs], [[b[i] * np.uint64(s[k]) for b, s in zip(blobs, sides)] for k in (0, 1) for i in (1, 2)])
    _, pair_at, pair_counts = _summed([np.cumsum(b[3], dtype=np.uint64) for b in blobs], [[b[4] * np.uint64(s[k]) for b, s in zip(blobs, sides)] for k in (0, 1)])
    edges, pair_edges = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(pair_size)])
    bucket = table.column("bucket")[0].as_py()
    rows = [(0, bucket, None, int(((counts[0] > 0) & (name != UNKNOWN)).sum()), int(counts[0].sum()), int(counts[2].sum()))]
    for k in np.flatnonzero(chunk > 0).tolist():
        w, p = at[edges[k] : edges[k + 1]], pair_at[pair_edges[k] : pair_edges[k + 1]]
        rows.append((int(chunk[k]), bucket, _pack(*(c[w] for c in counts), *(c[p] for c in pair_counts)), None, None, None))
    release()
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_TOTALS.names)


def _losses(word: np.ndarray, context: np.ndarray, pair: np.ndarray, own: np.ndarray, before: np.ndarray, at: np.ndarray, words_: int, size: int) -> np.ndarray:
    share = (word + 0.5) / (words_ + 0.5 * size)
    return np.log(context + ALPHA)[before] - np.log(pair[at] + (ALPHA * share)[own])


def lm_scores(docs: DataFrame, targets: DataFrame, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of every row; ``targets`` has the ids (doc_id) of the target."""
    text = F.col("text").cast("string").alias("text")
    source = docs.select("doc_id", text)
    ids = stored(targets.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), "targets")
    target = stored(packed_texts(source.filter(F.col("doc_id").isNotNull()), "doc_id", bit_filter(ids)).join(ids, "doc_id", "left_semi").select("packed"), "target")
    known = None
    if share:
        counts = stored(word_counts(source.select("text")), "words")
        total = counts.agg(F.sum("n")).first()[0] or 0
        # at most 1 / share rows: each has at least that share of all words
        known = counts.filter(F.col("n") >= F.lit(max(1.0, share * total))).select("key").toArrow().column("key").to_numpy().view(np.uint64)
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(volume) // BUCKET_BYTES + 1
    gathered = stored(chunks(source, known, bits), "chunks")
    counted = counts_by_bucket(gathered, buckets).unionByName(counts_by_bucket(chunks(target, known, bits, target=True), buckets))
    answers = stored(counted.groupBy("bucket").applyInArrow(totals, _TOTALS), "totals")
    size, n, t = (int(x or 0) for x in answers.filter("chunk = 0").agg(F.sum("known"), F.sum("n"), F.sum("t")).first())
    size += 2  # the unknown word and the start symbol

    fields = [T.StructField("n_words", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score")]
    schema = T.StructType([source.schema["doc_id"], *fields])

    def score(table: pa.Table) -> pa.Table:
        release()
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket).tolist()
        names, many, own, before = _texts_of(table.column("blob")[order[0]].as_py())
        found = [_unpack(table.column("blob")[k].as_py()) for k in order[1:]]
        word, context, t_word, t_context, pair, t_pair = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(6))
        _, by, at = _pairs(names, own, before)
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        at = place[at]
        del found, by, place
        doc = np.repeat(np.arange(len(many)), many)
        models = (t_word, t_context, t_pair, t), (word, context, pair, n)
        a, b = (np.bincount(doc, weights=_losses(w, c, p, own, before, at, m, size), minlength=len(many)) / np.maximum(many, 1) for w, c, p, m in models)
        ids_ = table.column("docs").combine_chunks().take(pa.array([order[0]])).flatten()
        return pa.table([ids_, pa.array(many), pa.array(a), pa.array(b), pa.array(a - b)], names=schema.names)

    texts = gathered.withColumn("bucket", F.lit(-1))
    back = answers.filter("chunk > 0").select(*_PARTS.names, F.lit(None).cast(gathered.schema["docs"].dataType).alias("docs"))
    return texts.unionByName(back).groupBy("chunk").applyInArrow(score, schema)
