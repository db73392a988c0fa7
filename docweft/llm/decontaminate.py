"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment of words.

Words are compared lower-cased and without outer punctuation.  A text's words are
aligned with an item's (match 2, mismatch -1, gap -1).  A pair is a leak if its score
reaches ``similarity`` of the item's score against itself.

Seeds lose no leak.  An alignment of that score matches at least ``similarity`` of the
item's m words, so it leaves at most ``lost`` of them out; of any lost + k words of the
item it matches k or more, at as many places of the text.  Each match gives 2 and each
edit takes 1, so it covers at most m (3 - 2 similarity) words of the text.  The seeds of
an item are its words that are rarest in the corpus, times the items that have them,
lost + ``MORE`` of them; only where enough seeds of an item lie that close together is the
text looked at.  There the longest common subsequence must have ``similarity`` of the
item's words, too, or nothing is aligned.

Seeds and texts are joined by broadcasting: half of all words of all texts are seeds of
some item, so a join by shuffle would move the corpus several times over.  The broadcast
side is checked: items go out in blocks of at most ``block_bytes`` of text, and a
benchmark beyond it takes one pass over the texts for each block; it is never collected
whole, only the 64-bit names and counts of its distinct words are.  Texts are read whole
and never shuffled.

Null and empty texts or items match nothing; repeated rows are judged one by one;
items with equal text are all reported; ids are of any type and may be null or empty;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.textvec import Spans, flat, slices, trimmed, words

#: Seeds of an item beyond the words that a leak may leave out.
MORE = 4
MATCH, MISMATCH, GAP = 2, -1, 1
#: Bits of the table that drops most words before the search.
TABLE_BITS = 22
#: Items whose words a task keeps as bits at a time.
HELD = 4096


def cores(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of each text (lower case, without outer punctuation), and each text's first."""
    found = words(data, offs, lower=True)
    return Spans(found.data)(*trimmed(found)), found.first


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of the best local alignment, and the words [from, to) of the text under it."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        ramp = GAP * np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, dtype=np.int64)
        top, end = 0, 0
        for x in a:
            new = np.zeros_like(row)
            new[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] - GAP)
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + ramp) - ramp  # gaps in the item
            at = int(row.argmax())
            if row[at] > top:
                top, end = int(row[at]), at
        return top, end

    score, to = best(item, text)
    back = best(item[::-1], text[:to][::-1])[1]
    return score, to - back, to


def common(places: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence of an item and a text; ``places`` has the item's places of a word as bits."""
    full = rest = (1 << size) - 1
    for word in text:
        at = places.get(word)
        if at:
            own = rest & at
            rest = ((rest + own) | (rest - own)) & full
    return size - rest.bit_count()


def least(size: int, similarity: float) -> int:
    """Words of an item that an alignment of ``similarity`` matches at least."""
    return max(1, math.ceil(similarity * size - 1e-9))


@dataclass
class Index:
    """Seeds of a block of items: sorted words with their items, the hits that each item needs, and all items' words."""

    ids: pa.Array
    names: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    need: np.ndarray
    table: np.ndarray

    def hits(self, name: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the batch, item) of every seed in a batch, in this order of text, item and place."""
        at = np.flatnonzero(self.table[(name >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seed, name[at], "left"), np.searchsorted(self.seed, name[at], "right")
        times = hi - lo
        at = np.repeat(at, times)
        item = self.item[np.arange(len(at)) + np.repeat(lo - (np.cumsum(times) - times), times)]
        doc = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((at, item, doc))
        return doc[order], at[order], item[order]

    def regions(self, name: np.ndarray, first: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to): the places of the batch that an alignment of ``similarity`` can cover."""
        doc, at, item = self.hits(name, first)
        span = np.floor(np.diff(self.first) * (3 - 2 * similarity) + 1e-9).astype(np.int64)[item]
        last = np.arange(len(at)) + self.need[item] - 1
        to = np.minimum(last, len(at) - 1)
        keep = np.flatnonzero((last < len(at)) & (doc[to] == doc) & (item[to] == item) & (at[to] - at < span))
        doc, item, to, at, span = doc[keep], item[keep], at[to[keep]], at[keep], span[keep]
        lo, hi = np.maximum(first[doc], to - span + 1), np.minimum(first[doc + 1], at + span)
        cut = np.ones(len(doc) + 1, dtype=bool)
        cut[1:-1] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
        a, b = np.flatnonzero(cut)[:-1], np.flatnonzero(cut)[1:] - 1
        yield from zip(doc[a].tolist(), item[a].tolist(), lo[a].tolist(), hi[b].tolist())

    def leaks(self, name: np.ndarray, first: np.ndarray, similarity: float) -> Iterator[tuple]:
        """(text, item, score, similarity, from word, to word) of every text and item that match."""
        best: dict[tuple[int, int], tuple] = {}
        bits: dict[int, dict[int, int]] = {}
        for d, i, lo, hi in self.regions(name, first, similarity):
            own = self.names[self.first[i] : self.first[i + 1]]
            if i not in bits:
                if len(bits) >= HELD:
                    bits.clear()
                places = bits[i] = {}
                for k, word in enumerate(own.tolist()):
                    places[word] = places.get(word, 0) | 1 << k
            if common(bits[i], len(own), name[lo:hi].tolist()) < least(len(own), similarity):
                continue
            score, start, end = align(own, name[lo:hi])
            share = score / (MATCH * len(own))
            if share >= similarity and share > best.get((d, i), (0,))[0]:
                best[d, i] = (share, score, lo - int(first[d]) + start, lo - int(first[d]) + end)
        for (d, i), (share, score, start, end) in best.items():
            yield d, i, score, share, start, end


def _distinct_words(tests: DataFrame) -> np.ndarray:
    """Sorted names of the words of all items."""
    schema = T.StructType([T.StructField("word", T.LongType())])

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(cores(*flat(part.column("text")))[0]).view(np.int64))], schema.names)

    return np.sort(tests.select("text").mapInArrow(names, schema).distinct().toArrow().column("word").to_numpy().view(np.uint64))


def _word_counts(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often each of the (sorted) known words occurs in all texts."""
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                name, _ = cores(*flat(part.column("text")))
                at = np.minimum(np.searchsorted(known, name), len(known) - 1)
                total += np.bincount(at[known[at] == name], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema.names)

    # as many rows as the items have distinct words
    rows = docs.select("text").mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(known), dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return out


def build_index(ids: pa.Array, texts: pa.Array, known: np.ndarray, count: np.ndarray, similarity: float) -> Index | None:
    """Seeds of a block of items, chosen by the word counts of all texts."""
    name, first = cores(*flat(texts))
    if not len(name):
        return None
    size = np.diff(first)
    distinct = [np.unique(name[first[i] : first[i + 1]], return_counts=True) for i in range(len(size))]
    place = [np.searchsorted(known, word) for word, _ in distinct]
    held_by = np.bincount(np.concatenate(place), minlength=len(known))
    seeds, owners, need = [], [], np.ones(len(size), dtype=np.int64)
    for i in np.flatnonzero(size).tolist():
        word, times = distinct[i]
        order = np.argsort(count[place[i]] * held_by[place[i]], kind="stable")
        lost, total = int(size[i]) - least(int(size[i]), similarity), np.cumsum(times[order])
        many = min(int(np.searchsorted(total, lost + MORE)) + 1, len(word))
        seeds.append(word[order[:many]])
        owners.append(np.full(many, i))
        need[i] = total[many - 1] - lost
    seed, item = np.concatenate(seeds), np.concatenate(owners)
    order = np.argsort(seed, kind="stable")
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[(seed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Index(ids, name, first, seed[order], item[order], need, table)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.5, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, score, similarity, from_word, to_word) of every text and test item that match."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    tests = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    found = [T.StructField(c, k) for c, k in (("score", T.LongType()), ("similarity", T.DoubleType()), ("from_word", T.LongType()), ("to_word", T.LongType()))]
    schema = T.StructType([source.schema["doc_id"], tests.schema["item_id"], *found])
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    known = _distinct_words(tests)
    if not len(known):
        return out
    count = _word_counts(source, known)
    volume = tests.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    blocks = -(-int(volume) // block_bytes)
    for block in range(blocks):
        # one block of at most about block_bytes, by a hash of its rows
        rows = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        index = build_index(rows.column("item_id").combine_chunks(), rows.column("text").combine_chunks(), known, count, similarity)
        if index is None:
            continue
        held = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(index.leaks(*cores(*flat(part.column("text"))), similarity))
                    own, items = (pa.array([f[j] for f in found], pa.int64()) for j in (0, 1))
                    rest = [pa.array([f[j] for f in found], pa.float64() if j == 3 else pa.int64()) for j in (2, 3, 4, 5)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), index.ids.take(items), *rest], schema.names)

        out = out.unionByName(source.mapInArrow(search, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.5, block_bytes: int = 32 << 20) -> DataFrame:
    """The documents without a leak, with all their columns.

    A document goes if its id is one of a row that leaks: rows that share the id go with it,
    and so do rows with a null id if one of them leaks.
    """
    found = leaks(docs, benchmark, similarity, block_bytes).select(F.col("doc_id").alias("_docweft_leaked")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_docweft_leaked")), "left_anti")
