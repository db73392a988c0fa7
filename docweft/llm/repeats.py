"""Exact removal of long repeated word sequences by recompression.

Recompression (Jez, "Recompression: a simple and powerful technique for word
equations") rewrites a sequence in rounds.  A round first names runs of one symbol,
then splits the symbols into two classes by a hash and names every pair of a
first-class symbol followed by a second-class one.  Names are 64-bit hashes of what
they stand for, hence global: every task gives equal content the same name without
asking.  Away from its ends a substring is rewritten alike wherever it occurs.  Here
each symbol carries the interval of words that fixes it (``need``): any other place
with the same words there has the same symbol at the same spot.

A window of ``width`` words is represented by one symbol whose need lies inside it:
of the highest level that has one there, the symbol with the smallest hash.  Equal
windows have equal representatives, so only windows around a shared representative
can be equal.  Neighbouring windows with one representative form one *instance*,
about ten windows long.

1. Instances are counted by representative and its needed words (``h``).  Those met
   once are done: all their windows are unique.
2. Instances with equal words over all their windows are equal windows: all are
   repeated.  Symbols only bring them together; that their words are equal is told by a
   64-bit cryptographic digest of the words themselves (``span``), beside ``h``.
3. Where a representative occurs with different spans, one instance of each span is
   expanded into its windows, which are counted by the same digest of their own words.

Words under a repeated window go; windows are judged on the input.  Counts are
aggregated before they are shuffled and joins are split where one key is hot, so a
passage that a third of all rows share costs no single task more than its rows' keys.

Null and empty texts have no words.  Texts below ``width`` words lose nothing.
Repeated rows are occurrences of their own; rows may share an id or have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.bitfilter import BitFilter, bit_filter, packed_slices, packed_texts, unpacked
from docweft.llm.learning import map_texts
from docweft.llm.shared import hot_keys, spread_join, stored
from docweft.llm.textvec import Spans, Words, flat, joined, lists, mix64, word_names, words

#: Rounds of recompression; the need of a symbol of the third round is about 13 words.
LEVELS = 3
_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_SALTS = [np.uint64(0x589965CC75374CC3 * (2 * i + 1) & (2**64 - 1)) for i in range(8)]


class Symbols:
    """One level: names, word spans, needs and documents; a need that passes a document's end lies outside of it."""

    def __init__(self, name: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray):
        self.name, self.start, self.lo, self.hi, self.doc = name, start, lo, hi, doc

    def runs(self, first: np.ndarray) -> Symbols:
        """Name runs of equal symbols; a run is fixed by its members and the symbols at both sides."""
        n = len(self.name)
        head = np.ones(n, dtype=bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(head)
        last = np.concatenate([at[1:], [n]]) - 1
        length = last - at + 1
        name = self.name[at]
        long = length > 1
        name[long] = mix64(name[long] * _C + length[long].astype(np.uint64))
        doc = self.doc[at]
        lo = np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), first[doc] - 1, self.lo[np.maximum(at - 1, 0)])
        hi = np.where(np.concatenate([doc[1:] != doc[:-1], [True]]), first[doc + 1] + 1, self.hi[np.minimum(last + 1, n - 1)])
        return Symbols(name, self.start[at], lo, hi, doc)

    def pairs(self, first: np.ndarray, salt: np.uint64) -> Symbols:
        """Name pairs of a first-class and a second-class symbol; a symbol left alone is fixed by the side it could have paired with."""
        n = len(self.name)
        left = (mix64(self.name ^ salt) >> np.uint64(63)).astype(bool)
        near = np.zeros(n, dtype=bool)
        near[:-1] = self.doc[1:] == self.doc[:-1]
        pair = near.copy()
        pair[:-1] &= left[:-1] & ~left[1:]
        taken = np.zeros(n, dtype=bool)
        taken[1:] = pair[:-1]
        follows = np.zeros(n, dtype=bool)
        follows[1:] = near[:-1]
        name, lo, hi = self.name.copy(), self.lo.copy(), self.hi.copy()
        at = np.flatnonzero(pair)
        name[at] = mix64(self.name[at] * _A + self.name[at + 1] * _B + salt)
        hi[at] = self.hi[at + 1]
        alone = np.flatnonzero(left & ~pair)
        hi[alone] = np.where(near[alone], self.hi[np.minimum(alone + 1, n - 1)], first[self.doc[alone] + 1] + 1)
        alone = np.flatnonzero(~left & ~taken)
        lo[alone] = np.where(follows[alone], self.lo[np.maximum(alone - 1, 0)], first[self.doc[alone]] - 1)
        keep = ~taken
        return Symbols(name[keep], self.start[keep], lo[keep], hi[keep], self.doc[keep])


def recompressed(name: np.ndarray, first: np.ndarray, levels: int = LEVELS) -> list[Symbols]:
    """All levels of a batch, from single words upwards."""
    at = np.arange(len(name))
    out = [Symbols(name, at, at, at + 1, np.repeat(np.arange(len(first) - 1), np.diff(first)))]
    for i in range(levels):
        out.append(out[-1].runs(first).pairs(first, _SALTS[i]) if len(name) else out[-1])
    return out


def _top_instances(s: Symbols, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first window, last window) of the highest level: the windows in which a symbol is the smallest, leftmost first."""
    n = len(s.name)
    rank = mix64(s.name)
    begin, end = np.maximum(s.hi - width, first[s.doc]), np.minimum(s.lo, first[s.doc + 1] - width)
    open_left = open_right = np.ones(n, dtype=bool)
    back = 1
    while back < n:  # windows that also see a smaller symbol before, or an equal one
        ahead = s.lo[:-back] + 1
        live = open_left[back:] & (ahead > begin[back:]) & (begin[back:] <= end[back:])
        if not live.any():
            break
        hit = live & (rank[:-back] <= rank[back:])
        begin[back:][hit] = ahead[hit]
        open_left = open_left.copy()
        open_left[back:] &= live & ~hit
        back += 1
    ahead_by = 1
    while ahead_by < n:  # windows that also see a smaller symbol behind
        limit = s.hi[ahead_by:] - width - 1
        live = open_right[:-ahead_by] & (limit < end[:-ahead_by]) & (begin[:-ahead_by] <= end[:-ahead_by])
        if not live.any():
            break
        hit = live & (rank[ahead_by:] < rank[:-ahead_by])
        end[:-ahead_by][hit] = limit[hit]
        open_right = open_right.copy()
        open_right[:-ahead_by] &= live & ~hit
        ahead_by += 1
    at = np.flatnonzero((begin <= end) & (s.lo >= first[s.doc]) & (s.hi <= first[s.doc + 1]))
    return at, begin[at], end[at]


class WordDigests:
    """64 bits of a cryptographic digest of the words of a span, joined by blanks."""

    def __init__(self, found: Words):
        self.raw = joined(found)[0].tobytes()
        self.stop = np.concatenate([[0], np.cumsum(found.end - found.start + 1)])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        edges = zip(self.stop[begin].tolist(), (self.stop[end] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join(hashlib.blake2b(self.raw[a:b], digest_size=8).digest() for a, b in edges), np.uint64)


def instances(name: np.ndarray, first: np.ndarray, width: int, digest: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, span, first window, windows) of all instances of a batch, by document and position; ``digest`` names the words of a span."""
    levels = recompressed(name, first)
    seq = Spans(name)
    count = np.maximum(np.diff(first) - width + 1, 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    window = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], count)
    if not len(window):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    at, begin, end = _top_instances(levels[-1], first, width)
    found = [(levels[-1], len(levels) - 1, at, begin, end)]
    covered = np.zeros(len(name) + 1, dtype=np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, end + 1, -1)
    window = window[np.cumsum(covered)[window] == 0]
    for i in range(len(levels) - 2, -1, -1):
        if not len(window):
            break
        s = levels[i]
        rank = mix64(s.name)
        lo, hi = np.searchsorted(s.lo, window, "left"), np.searchsorted(s.hi, window + width, "right")
        has = hi > lo
        own, lo, hi = window[has], lo[has], hi[has]
        window = window[~has]
        best = lo.copy()
        for k in range(1, int((hi - lo).max(initial=0))):
            other = np.minimum(lo + k, len(rank) - 1)
            better = (lo + k < hi) & (rank[other] < rank[best])
            best[better] = other[better]
        if len(own):
            head = np.ones(len(own), dtype=bool)
            head[1:] = (best[1:] != best[:-1]) | (own[1:] != own[:-1] + 1)
            heads = np.flatnonzero(head)
            found.append((s, i, best[heads], own[heads], own[np.concatenate([heads[1:], [len(own)]]) - 1]))
    parts = []
    for s, i, at, begin, end in found:
        h = mix64(seq(s.lo[at], s.hi[at]) * _A + ((s.start[at] - s.lo[at]).astype(np.uint64) * np.uint64(8) + np.uint64(i)))
        span = mix64(digest(begin, end + width) * _B + (s.start[at] - begin).astype(np.uint64))
        parts.append((h, span, begin, end - begin + 1))
    h, span, begin, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.argsort(begin, kind="stable")
    return h[order], span[order], begin[order], n[order]


def _digests(found, keep: np.ndarray | None = None) -> list[str]:
    out, offs = joined(found, keep)
    raw = out.tobytes()
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parsed(rows: DataFrame, width: int) -> DataFrame:
    """Each row's words, digest and instances (as lists), stored."""

    def kernel(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        found = words(data, offs)
        h, span, begin, n = instances(word_names(found), found.first, width, WordDigests(found))
        doc = np.searchsorted(found.first, begin, "right") - 1
        cut = np.searchsorted(begin, found.first)
        return [pa.array(found.count), pa.array(_digests(found), pa.string()), lists(_signed(h), cut, pa.int64()), lists(_signed(span), cut, pa.int64()), lists((begin - found.first[doc]).astype(np.int32), cut, pa.int32()), lists(n.astype(np.int32), cut, pa.int32())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType())]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("h", "span")] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("at", "n")]
    return stored(map_texts(rows, ["doc_id", "tk"], fields, kernel), "parsed")


def _flat_instances(parsed: DataFrame, columns: list[str], members: BitFilter | None = None) -> DataFrame:
    """One row for each instance; with ``members``, only those whose ``h`` may be one."""
    kept = [c for c in columns if c in ("doc_id", "tk")]
    schema = T.StructType([parsed.schema[c] if c in kept else T.StructField(c, parsed.schema[c].dataType.elementType) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), batch.column("h").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            pick = pa.array(np.arange(len(h)) if members is None else np.flatnonzero(members.maybe_in(h & (8 * len(members.bits) - 1))))
            row = pa.array(row).take(pick)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(row) if c in kept else batch.column(c).flatten().take(pick) for c in columns], columns)

    return parsed.select(*columns).mapInArrow(run, schema)


def _windows_of(joined_texts: DataFrame, width: int) -> DataFrame:
    """(h, window, doc_id, tk, at, alone) of each window of the listed instances."""
    out = T.StructType([T.StructField("h", T.LongType()), T.StructField("window", T.LongType()), joined_texts.schema["doc_id"], joined_texts.schema["tk"], T.StructField("at", T.IntegerType()), T.StructField("alone", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packed_slices(batch, "packed"):
                found = words(*flat(unpacked(part.column("packed"))))
                digest = WordDigests(found)
                items = part.column("items")
                row = np.repeat(np.arange(part.num_rows), items.value_lengths().to_numpy().astype(np.int64))
                at, n, h, alone = (items.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "h", "alone"))
                rep = np.repeat(np.arange(len(at)), n)
                pos = at[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                own = pa.array(row[rep])
                begin = found.first[row[rep]] + pos
                yield pa.RecordBatch.from_arrays([pa.array(h[rep]), pa.array(_signed(digest(begin, begin + width))), part.column("doc_id").take(own), part.column("tk").take(own), pa.array(pos.astype(np.int32)), pa.array(alone[rep])], out.names)

    return joined_texts.mapInArrow(run, out)


def _with_texts(lists_by_row: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``lists_by_row`` (doc_id, tk, ...) with their compressed texts."""
    texts = packed_texts(rows, "tk", bit_filter(lists_by_row.select("tk")))
    b = lists_by_row.withColumnsRenamed({"doc_id": "id_b", "tk": "tk_b"})
    return texts.join(b, (F.col("tk") == F.col("tk_b")) & F.col("doc_id").eqNullSafe(F.col("id_b"))).drop("id_b", "tk_b")


def repeated_ranges(rows: DataFrame, parsed: DataFrame, width: int) -> DataFrame:
    """(doc_id, tk, ranges): for each row with a repeat, the word ranges under repeated windows."""
    groups = _flat_instances(parsed, ["h", "span"]).groupBy("h").agg(F.count("*").alias("c"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    groups = stored(groups.filter("c > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "groups")
    members = bit_filter(groups.select("h"), hashed=True)
    shared = stored(_flat_instances(parsed, ["doc_id", "tk", "h", "span", "at", "n"], members).join(groups, "h"), "shared")
    mixed = shared.filter("mixed").select("doc_id", "tk", "h", "span", "at", "n")
    spans = mixed.groupBy("h", "span").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "tk", "at", "n")).alias("rep"))
    spans = stored(spans, "spans")
    many = spans.filter("c > 1").select("h", "span")
    whole = shared.filter("NOT mixed").select("doc_id", "tk", "at", "n").unionByName(mixed.join(many, ["h", "span"], "left_semi").select("doc_id", "tk", "at", "n"))
    items = F.collect_list(F.struct(F.col("rep.at").alias("at"), F.col("rep.n").alias("n"), "h", (F.col("c") == 1).alias("alone"))).alias("items")
    chosen = stored(spans.groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep.tk").alias("tk")).agg(items), "expanded")
    windows = stored(_windows_of(_with_texts(chosen, rows), width), "windows")
    named = F.struct("h", "window").alias("name")
    often = stored(windows.groupBy(named).count().filter("count > 1"), "often")
    alone = windows.filter("alone").select("doc_id", "tk", "at", named)
    single = spread_join(alone, often, "name", hot_keys(often, "name", "count")).select("doc_id", "tk", "at", F.lit(1).alias("n"))
    ranges = whole.unionByName(single).select("doc_id", "tk", F.struct("at", (F.col("at") + F.col("n") + (width - 1)).alias("to")).alias("r"))
    return stored(ranges.groupBy("doc_id", "tk").agg(F.collect_set("r").alias("ranges")), "ranges")


def without_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    return _applied(docs, width).select("doc_id", "n_words", "n_removed", "kept_sha256")


def kept_texts(docs: DataFrame, width: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of the rows that lose words, with the words kept."""
    return _applied(docs, width, texts=True).filter("n_removed > 0").select("doc_id", "n_words", "n_removed", "kept")


def _applied(docs: DataFrame, width: int, texts: bool = False) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("tk"), text.alias("text"))
    parsed = _parsed(rows, width)
    ranges = repeated_ranges(rows, parsed, width)
    out = T.StructType([rows.schema["doc_id"], rows.schema["tk"], T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packed_slices(batch, "packed"):
                found = words(*flat(unpacked(part.column("packed"))))
                items = part.column("ranges")
                row = np.repeat(np.arange(part.num_rows), items.value_lengths().to_numpy().astype(np.int64))
                at, to = (items.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "to"))
                edge = np.zeros(len(found.start) + 1, dtype=np.int64)
                np.add.at(edge, found.first[row] + at, 1)
                np.add.at(edge, found.first[row] + to, -1)
                keep = np.cumsum(edge)[:-1] == 0
                removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[found.first])
                body, offs = joined(found, keep)
                raw = body.tobytes()
                own = [raw[a : max(a, b - 1)] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()), pa.array([x.decode() for x in own] if texts else [None] * len(own), pa.string())], out.names)

    changed = _with_texts(ranges, rows).mapInArrow(cut, out).dropDuplicates(["doc_id", "tk"]).withColumnsRenamed({"doc_id": "id_b", "tk": "tk_b"})
    base = parsed.select("doc_id", "tk", "n_words", "whole")
    done = base.join(changed, (F.col("tk") == F.col("tk_b")) & F.col("doc_id").eqNullSafe(F.col("id_b")), "left")
    return done.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept")
