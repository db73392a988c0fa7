"""Pairs of documents by tiles: blocks of documents meet two by two, and each pair of blocks is a task's work.

Blocks are written once, as compressed Arrow arrays that only the task opens in which two of them
meet.  What is shuffled is every block once for each block that it meets, never a row for each pair of
documents or for each thing that two of them share.  Entities are numbers in blocks, and blocks that
share no entity do not meet where only entities matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docweft.sources.store import kept

#: Most entities and documents of a block; of documents fewer if pairs are asked for, as a tile lists them.
ENTRIES, DOCS, ASKED_DOCS = 1 << 20, 1 << 14, 1 << 11
#: Entries that make a block of their own worth while, where there are fewer blocks than cores need.
LEAST_ENTRIES = 20_000
#: Shared entities that a task holds at a time, and cells of its matrix of pairs.
CELLS = 1 << 20
#: Entities whose bits meet in one step, and blocks from which on it is worth while to look for those that share none.
SLICE, MANY_BLOCKS = 1 << 13, 8
#: Shared entities of a part whose texts are listed, and bytes of texts that one array holds.
LISTED, BYTES = 1 << 19, 1 << 28
#: Vectors that make a block of their own worth while, where there are fewer blocks than cores need.
LEAST_ROWS = 1 << 9
#: A look-up costs as much as so many shared entities of a product.
PROBE = 8
SLACK = 1e-9


def block_of(doc_id: str, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def _packed(names: list[str], lists: list[pa.Array]) -> bytes:
    """Arrays of a block as one compressed message."""
    row = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists], names)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(row)
    return out.getvalue().to_pybytes()


def _opened(data: pa.BinaryScalar) -> dict[str, pa.Array] | None:
    """The arrays of a block; nothing if there is none."""
    if not data.is_valid:
        return None
    row = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
    return {name: row.column(name)[0].values for name in row.schema.names}


def _flat(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


BLOCK = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType())])


def tiled(blocks: DataFrame, n: int, run: Callable[..., Iterator[list[pa.Array]]], schema: T.StructType, pairs: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """The columns that ``run(own, left, right)`` gives of the pairs bl <= br of blocks (block, packed columns), of all or of those ``asked`` (bl, br).

    With ``pairs`` (a, b), only blocks with some of them meet, and ``run`` is also given lists of their ends in each.
    """
    spark = blocks.sparkSession
    names = [c for c in blocks.columns if c != "block"]
    if pairs is not None:
        turned = pairs.select("a", "b", block_of("a", n).alias("ba"), block_of("b", n).alias("bb"))
        first = F.col("ba") <= F.col("bb")
        ends = [F.when(first, F.col(p)).otherwise(F.col(q)).alias(name) for p, q, name in (("ba", "bb", "bl"), ("bb", "ba", "br"), ("a", "b", "x"), ("b", "a", "y"))]
        lists = kept(turned.select(*ends).groupBy("bl", "br").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y")), "tiles")  # of a tile's documents: at most ASKED_DOCS squared
        asked = lists.select("bl", "br")
    elif asked is None:
        asked = spark.range(n).select(F.col("id").cast("int").alias("bl")).select("bl", F.explode(F.sequence("bl", F.lit(n - 1))).alias("br"))
    tasks = min(4096, max(spark.sparkContext.defaultParallelism, n * (n + 1) // 2))
    own = blocks.select("block", F.struct(*names).alias("own"))
    left, right = (own.withColumnsRenamed({"block": b, "own": side}).join(F.broadcast(asked), b).repartition(tasks, "bl", "br") for b, side in (("bl", "l"), ("br", "r")))
    both = left.join(right, ["bl", "br"])
    if pairs is not None:
        both = both.join(lists, ["bl", "br"])

    asked_for = "xy" if pairs is not None else ""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [{c: _opened(batch.column(s).field(c)[i]) for c in names} for s in "lr"]
                given = (batch.column(c)[i].values for c in asked_for)
                for arrays in run(batch.column("bl")[i].as_py() == batch.column("br")[i].as_py(), *sides, *given):
                    yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return both.mapInArrow(met, schema)


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (first, size): the range of each member, and the members."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) + np.repeat(first - (np.cumsum(size) - size), size)


def _entity_arrays(table: pa.Table) -> tuple[list[str], list[pa.Array]]:
    """A block's rows (doc_id, entity, idf and, where entities are listed, text, label, k, count) as arrays: entities by number, each with its documents."""
    ids = pc.unique(table["doc_id"]).sort()
    doc, entity = pc.index_in(table["doc_id"], ids).to_numpy(), table["entity"].to_numpy()
    order = np.lexsort((doc, entity))
    doc, entity, idf = doc[order].astype(np.int32), entity[order], table["idf"].to_numpy()[order]
    at = np.flatnonzero(np.concatenate([[True], entity[1:] != entity[:-1]]))
    mass = np.bincount(doc, weights=idf, minlength=len(ids))
    names = ["ids", "mass", "entities", "idf", "first", "docs"]
    lists = [ids, pa.array(mass), pa.array(entity[at]), pa.array(idf[at]), pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(doc)]
    if "text" in table.column_names:
        heads = pa.array(order[at])
        names += ["texts", "labels", "keys", "counts"]
        lists += [*(table[c].take(heads) for c in ("text", "label", "k")), table["count"].take(pa.array(order))]
    return names, [_flat(v) for v in lists]


def _side(part: dict[str, pa.Array]) -> SimpleNamespace:
    own = SimpleNamespace(**part)
    for name in ("mass", "entities", "idf", "first", "docs", "keys", "counts"):
        if name in part:
            setattr(own, name, part[name].to_numpy())
    own.entity = np.repeat(np.arange(len(own.idf), dtype=np.int32), np.diff(own.first))
    own.order = np.argsort(own.docs, kind="stable").astype(np.int32)
    return own


def _rest(own: SimpleNamespace) -> np.ndarray:
    """Of a document's mass, what is left from each of its entries on."""
    idf = own.idf[own.entity[own.order]]
    before = np.cumsum(idf) - idf
    doc = own.docs[own.order]
    rest = np.empty(len(idf))
    rest[own.order] = own.mass[doc] - (before - before[np.searchsorted(doc, np.arange(len(own.mass)))][doc])
    return rest


def _cuts(work: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of items in order whose work is at most ``most``, or that are single, of at most ``rows`` items."""
    total, at = np.concatenate([[0], np.cumsum(work)]), 0
    while at < len(work):
        end = min(at + max(1, rows), max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1))
        yield at, end
        at = end


class _Tile:
    """Two blocks, and what their documents share."""

    def __init__(self, left: SimpleNamespace, right: SimpleNamespace, own: bool, least: float):
        self.l, self.r, self.own, self.least = left, right, own, least
        to = np.arange(len(left.idf), dtype=np.int32)
        if not own:
            at = np.minimum(np.searchsorted(right.entities, left.entities), len(right.entities) - 1).astype(np.int32)
            to = np.where(right.entities[at] == left.entities, at, np.int32(-1))
        entry = left.order[to[left.entity[left.order]] >= 0]  # by document, rarest first
        self.entry, self.doc, self.entity = entry, left.docs[entry], left.entity[entry]
        self.to, self.n = to, len(right.mass)
        self.at = np.searchsorted(self.doc, np.arange(len(left.mass) + 1))
        self.size = right.first[to[self.entity] + 1] - right.first[to[self.entity]]
        self.work = np.diff(np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])[self.at])

    def product(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, position on the right, cell) of all that the documents lo..hi share with the right; cells by row."""
        some = slice(self.at[lo], self.at[hi])
        owner, pos = _spread(self.r.first[self.to[self.entity[some]]], self.size[some])
        owner += self.at[lo]
        x, y = self.doc[owner], self.r.docs[pos]
        if self.own:
            live = x < y
            owner, pos, x, y = owner[live], pos[live], x[live], y[live]
        return owner, pos, (x - lo).astype(np.int64) * self.n + y

    def probe(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the given pairs; cells are their numbers."""
        if not hasattr(self, "sorted"):
            named = self.r.docs.astype(np.int64) * len(self.r.idf) + self.r.entity
            self.places = np.argsort(named, kind="stable")
            self.sorted = named[self.places]
        pair, owner = _spread(self.at[x], self.at[x + 1] - self.at[x])
        want = y[pair].astype(np.int64) * len(self.r.idf) + self.to[self.entity[owner]]
        found = np.minimum(np.searchsorted(self.sorted, want), len(self.sorted) - 1)
        hit = self.sorted[found] == want
        return owner[hit], self.places[found[hit]], pair[hit]

    def candidates(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(lo, hi, cells) of the pairs that may reach the least score.

        From the first entity on that two documents share - the rarest - the rest of either has to
        weigh what they have to share: least / (1 + least) of the sum of both masses.
        """
        l, r, share = self.l, self.r, self.least / (1 + self.least)
        ahead = _rest(l)
        after = ahead if self.own else _rest(r)
        some = after >= self.least * r.mass[r.docs] - SLACK  # what is shared weighs that much of either's mass
        place = np.flatnonzero(some)
        first = np.concatenate([[0], np.cumsum(some)])[r.first]
        own = np.flatnonzero(ahead[self.entry] >= self.least * l.mass[self.doc] - SLACK)
        at = np.searchsorted(self.doc[own], np.arange(len(l.mass) + 1))
        to = self.to[self.entity[own]]
        size = first[to + 1] - first[to]
        work = np.diff(np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[at])
        for lo, hi in _cuts(work, CELLS, CELLS // self.n):
            part = slice(at[lo], at[hi])
            owner, pos = _spread(first[to[part]], size[part])
            entry, pos = own[part][owner], place[pos]
            x, y = self.doc[entry], r.docs[pos]
            good = np.minimum(ahead[self.entry[entry]], after[pos]) >= share * (l.mass[x] + r.mass[y]) - SLACK
            if self.own:
                good &= x < y
            cell = np.zeros((hi - lo) * self.n, dtype=bool)
            cell[(x[good] - lo).astype(np.int64) * self.n + y[good]] = True
            yield lo, hi, np.flatnonzero(cell)

    def asked(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(lo, hi, cells) of given pairs."""
        cells = np.unique(x.astype(np.int64) * self.n + y)
        for lo, hi in _cuts(np.zeros(len(self.l.mass)), 1, CELLS // self.n):
            yield lo, hi, cells[np.searchsorted(cells, lo * self.n) : np.searchsorted(cells, hi * self.n)] - lo * self.n

    def shared(self, wanted: Iterator[tuple[int, int, np.ndarray]] | None) -> Iterator[tuple]:
        """(entry, position, cell, left document and right document of a cell's number) of all pairs or of those wanted, every pair at once."""
        if wanted is None:
            for lo, hi in _cuts(self.work, CELLS, CELLS // self.n):
                yield *self.product(lo, hi), (hi - lo) * self.n, lambda c, lo=lo: (lo + c // self.n, c % self.n)
            return
        for lo, hi, cells in wanted:
            if not len(cells):
                continue
            x, y = lo + cells // self.n, cells % self.n
            long = self.at[x + 1] - self.at[x]
            if self.work[lo:hi].sum() <= PROBE * long.sum():
                mask = np.zeros((hi - lo) * self.n, dtype=bool)
                mask[cells] = True
                for a, b in _cuts(self.work[lo:hi], CELLS, hi - lo):
                    entry, pos, cell = self.product(lo + a, lo + b)
                    live = mask[a * self.n :][cell]
                    yield entry[live], pos[live], cell[live], (b - a) * self.n, lambda c, at=lo + a: (at + c // self.n, c % self.n)
            else:
                for a, b in _cuts(long, CELLS, len(x)):
                    yield *self.probe(x[a:b], y[a:b]), b - a, lambda c, x=x[a:b], y=y[a:b]: (x[c], y[c])

    def scored(self, parts: tuple, most: int | None) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, pa.Array | None] | None:
        """(a, b, score, n, shared) of the pairs of a part, the shared entities if ``most`` of them are to be listed."""
        entry, pos, cell, size, ends = parts
        if not len(cell):
            return None
        l, r = self.l, self.r
        n = np.bincount(cell, minlength=size)
        both = np.bincount(cell, weights=l.idf[self.entity[entry]], minlength=size)
        hit = np.flatnonzero(n)
        x, y = ends(hit)
        score = both[hit] / (l.mass[x] + r.mass[y] - both[hit])
        if self.least > 0:
            good = score >= self.least
            hit, x, y, score = hit[good], x[good], y[good], score[good]
        if not len(hit):
            return None
        ids = l.ids.take(pa.array(x)), r.ids.take(pa.array(y))
        flip = pc.greater(*ids)
        a, b = pc.if_else(flip, ids[1], ids[0]), pc.if_else(flip, ids[0], ids[1])
        if most is None:
            return a, b, score, n[hit], None
        turned = np.zeros(size, dtype=bool)
        turned[hit] = flip.to_numpy(zero_copy_only=False)
        if self.least > 0:
            live = np.zeros(size, dtype=bool)
            live[hit] = True
            live = live[cell]
            entry, pos, cell = entry[live], pos[live], cell[live]
        order = np.argsort(cell, kind="stable")  # of a pair the rarest stay first
        first = np.searchsorted(cell[order], hit)
        order = order[np.arange(len(cell)) - np.repeat(first, n[hit]) < most]
        entry, pos, cell = entry[order], pos[order], cell[order]
        entity, ca, cb = pa.array(self.entity[entry]), l.counts[self.entry[entry]], r.counts[pos]
        turn = turned[cell]
        fields = [l.texts.take(entity), l.labels.take(entity), pa.array(-l.keys[self.entity[entry]]), pa.array(np.where(turn, cb, ca)), pa.array(np.where(turn, ca, cb))]
        listed = pa.StructArray.from_arrays(fields, ["text", "label", "idf", "count_a", "count_b"])
        offsets = np.concatenate([[0], np.cumsum(np.minimum(n[hit], most))]).astype(np.int32)
        return a, b, score, n[hit], pa.ListArray.from_arrays(pa.array(offsets), listed)


    def listings(self, most: int, cells: int) -> Iterator[list[pa.Array]]:
        """(a, b, text:count_a:count_b of the ``most`` rarest entities, with commas) of all pairs that share one.

        All that a pair shares is a number each: its cell, and below that the place of entity and counts in
        a dictionary of texts.  Sorted, the texts of a pair follow each other, rarest first.  A part's dictionary
        is no longer than what its pairs share.
        """
        l, r = self.l, self.r
        kinds = [np.unique(s.counts, return_inverse=True) for s in (l, r)]
        (lc, li), (rc, ri) = kinds
        named, place = np.unique(r.entity.astype(np.int64) * len(rc) + ri, return_inverse=True)  # the counts that each entity has on the right
        first = np.searchsorted(named, np.arange(len(r.idf) + 1) * len(rc))
        right = (r.docs.astype(np.int64) << 32) + (place - first[r.entity])
        left = self.entity.astype(np.int64) * len(lc) + li[self.entry]
        for lo, hi in _cuts(self.work, cells, cells // self.n):
            some = slice(self.at[lo], self.at[hi])
            size = self.size[some]
            own, place = np.unique(left[some], return_inverse=True)
            entity = own // len(lc)
            many = first[self.to[entity] + 1] - first[self.to[entity]]
            at, seen = _spread(first[self.to[entity]], many)
            _, pos = _spread(r.first[self.to[self.entity[some]]], size)
            key = np.repeat(((self.doc[some] - lo).astype(np.int64) * self.n << 32) + (np.cumsum(many) - many)[place], size) + right[pos]
            if self.own:
                key = key[np.repeat(self.doc[some], size) < r.docs[pos]]
            if not len(key):
                continue
            key.sort()
            cell, code = key >> 32, key & 0xFFFFFFFF
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            n, cell = np.diff(np.append(start, len(key))), cell[start]
            if n.max() > most:
                code = code[np.arange(len(key)) - np.repeat(start, n) < most]
                n = np.minimum(n, most)
                start = np.cumsum(n) - n
            a, b = l.ids.take(pa.array(lo + cell // self.n)), r.ids.take(pa.array(cell % self.n))
            flip = pc.greater(a, b)
            a, b = pc.if_else(flip, b, a), pc.if_else(flip, a, b)
            texts, ca, cb = l.texts.take(pa.array(entity[at])), *(pa.array(c).cast(pa.string()) for c in (lc[own % len(lc)][at], rc[named % len(rc)][seen]))
            ways = [pc.binary_join_element_wise(texts, *counts, ":") for counts in ((ca, cb), (cb, ca))]
            pieces = pa.concat_arrays([w for way in ways for w in (way, pc.binary_join_element_wise("", way, ","))])  # the first of a pair has no comma before it
            code += np.repeat(np.where(flip.to_numpy(zero_copy_only=False), 3, 1) * len(at), n)
            code[start] -= len(at)
            long = pc.binary_length(pieces).to_numpy()
            whole = int(long.max()) * len(code) <= BYTES
            for p, q in [(0, len(n))] if whole else _cuts(np.add.reduceat(long[code], start).astype(np.int64), BYTES, len(n)):
                end = start[q] if q < len(n) else len(code)
                found = pieces.take(pa.array(code[start[p] : end]))
                ends = np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset : found.offset + len(found) + 1]
                cuts = ends[np.append(start[p:q], end) - start[p]]
                yield [a[p:q], b[p:q], pa.StringArray.from_buffers(q - p, pa.py_buffer(np.ascontiguousarray(cuts)), found.buffers()[2])]


SHARED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("idf", T.DoubleType()), T.StructField("count_a", T.LongType()), T.StructField("count_b", T.LongType())]))


def _entries(weighted: DataFrame, listed: bool) -> DataFrame:
    """The rows of documents with the number of each entity, stored; texts and counts only if entities are listed."""
    more = ["text", "label", (-F.round("idf", 4)).alias("k"), F.col("count").cast("long").alias("count")] if listed else []
    return kept(weighted.filter("doc_id IS NOT NULL").select("doc_id", "entity", "idf", *more), "weighted")


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, which are a block."""
    rows = [batch for batch in batches if batch.num_rows]
    if rows:
        table = pa.Table.from_batches(rows)
        data = _packed(*_entity_arrays(table.drop_columns(["block"])))
        yield pa.RecordBatch.from_arrays([rows[0].column("block").slice(0, 1), pa.array([data], pa.binary())], BLOCK.names)


def _entity_blocks(e: DataFrame, n: int) -> DataFrame:
    """(block, data) of n blocks of documents by a hash, as tables of other things have it."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.table([_flat(table["block"].slice(0, 1)), pa.array([_packed(*_entity_arrays(table.drop_columns(["block"])))], pa.binary())], BLOCK.names)

    return kept(e.withColumn("block", block_of("doc_id", n)).groupBy("block").applyInArrow(pack, BLOCK), "entities")


def _meeting(blocks: DataFrame) -> DataFrame:
    """(bl, br) of the blocks that share an entity: the bits of all blocks for a range of entities meet in one task."""
    wide = T.StructType([T.StructField("part", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("bits", T.BinaryType())])
    size, schema = SLICE, T.StructType([T.StructField("bl", T.IntegerType()), T.StructField("br", T.IntegerType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entities = _opened(batch.column("data")[i])["entities"].to_numpy()
                parts, at = np.unique(entities // size, return_index=True)
                for part, own in zip(parts, np.split(entities, at[1:])):
                    bits = np.zeros(size, dtype=bool)
                    bits[own - part * size] = True
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), batch.column("block").slice(i, 1), pa.array([np.packbits(bits).tobytes()])], wide.names)

    def meet(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        bits = np.unpackbits(np.frombuffer(b"".join(table["bits"].to_pylist()), dtype=np.uint8).reshape(len(block), -1), axis=1).astype(np.float32)
        p, q = np.nonzero(bits @ bits.T)
        live = block[p] <= block[q]
        return pa.table([pa.array(block[p[live]]), pa.array(block[q[live]])], schema.names)

    return kept(blocks.mapInArrow(spread, wide).groupBy("part").applyInArrow(meet, schema).distinct(), "meeting")


def _dealt(weighted: DataFrame, listed: bool, pairs: DataFrame | None = None) -> tuple[T.DataType, DataFrame, int, DataFrame | None]:
    """The type of a document, n blocks, and which of them have to meet (None: all).

    Blocks are ranges of documents with about as many entries: what is alike often comes together, and ranges that
    share nothing never meet.  With ``pairs``, blocks go by a hash, as pairs are dealt.
    """
    e = _entries(weighted, listed)
    size = e.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    cores = e.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-size.rows // ENTRIES), -(-size.docs // (DOCS if pairs is None else ASKED_DOCS)), min(int((8 * cores) ** 0.5), size.rows // LEAST_ENTRIES))
    doc = e.schema["doc_id"].dataType
    if pairs is not None:
        return doc, _entity_blocks(e, n), n, None
    blocks = kept(e.repartitionByRange(n, "doc_id").withColumn("block", F.spark_partition_id()).mapInArrow(_packs, BLOCK), "entities")
    return doc, blocks, n, _meeting(blocks) if n > MANY_BLOCKS else None


def entity_lists(weighted: DataFrame, most: int) -> DataFrame:
    """(a, b, shared) with a < b of all pairs of ``weighted`` (doc_id, text, label, count, idf, entity) that share an entity.

    ``shared`` has text:count_a:count_b of the ``most`` rarest by the rounded idf, text and label - in the order of the
    numbers ``entity`` -, with commas: the text that ``entity_pairs`` lists as structs, put together where two blocks meet.
    """
    doc, blocks, n, asked = _dealt(weighted, True)
    schema = T.StructType([T.StructField("a", doc), T.StructField("b", doc), T.StructField("shared", T.StringType())])
    cells = LISTED

    def run(own: bool, left: dict, right: dict) -> Iterator[list[pa.Array]]:
        return _Tile(_side(left["data"]), _side(right["data"]), own, 0.0).listings(most, cells)

    return tiled(blocks, n, run, schema, asked=asked)


def entity_pairs(weighted: DataFrame, least: float = 0.0, pairs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(a, b, score, n or shared) with a < b of ``weighted`` (doc_id, text, label, count, idf, entity): all pairs that share an entity, those with a score of ``least`` or more, or those of ``pairs`` that share one.

    ``shared`` lists the ``most`` rarest by the rounded idf, text and label, in the order of the numbers ``entity``.
    """
    doc, blocks, n, asked = _dealt(weighted, most is not None, pairs)
    schema = T.StructType([T.StructField("a", doc), T.StructField("b", doc), T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType()) if most is None else T.StructField("shared", SHARED)])

    def run(own: bool, left: dict, right: dict, *given: pa.Array) -> Iterator[list[pa.Array]]:
        tile = _Tile(_side(left["data"]), _side(right["data"]), own, least)
        wanted = tile.candidates() if least > 0 else None
        if given:
            x, y = (pc.fill_null(pc.index_in(ends, value_set=side.ids), -1).to_numpy() for ends, side in zip(given, (tile.l, tile.r)))
            x, y = x[(x >= 0) & (y >= 0)], y[(x >= 0) & (y >= 0)]
            wanted = tile.asked(*((np.minimum(x, y), np.maximum(x, y)) if own else (x, y)))
        for found in map(lambda part: tile.scored(part, most), tile.shared(wanted)):
            if found:
                a, b, score, count, shared = found
                yield [a, b, pa.array(score), pa.array(count.astype(np.int64)) if most is None else shared]

    return tiled(blocks, n, run, schema, pairs, asked)


def _documents(part: dict[str, pa.Array]) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(documents, vectors, chunks) of a block, for each number of chunks that documents have; documents are numbers in the block's order."""
    chunks = part["chunks"]
    size = np.diff(np.append(part["first"].to_numpy(), len(chunks)))
    x = part["vectors"].to_numpy().reshape(len(chunks), -1)
    owner = np.repeat(np.arange(len(size)), size)
    out = []
    for n in np.unique(size):
        docs = np.flatnonzero(size == n)
        own = np.flatnonzero(size[owner] == n)
        out.append((docs, x[own].astype(np.float64), chunks.take(pa.array(own))))
    return out


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row, largest first; of equal ones the first column."""
    k = min(k, sim.shape[1])
    top = np.sort(np.argpartition(-sim, k - 1, axis=1)[:, :k], axis=1)
    value = np.take_along_axis(sim, top, axis=1)
    tied = np.flatnonzero((sim >= value.min(axis=1)[:, None]).sum(axis=1) > k)  # which of equals is last is left open so far
    top[tied] = np.sort(np.argsort(-sim[tied], axis=1, kind="stable")[:, :k], axis=1)
    value[tied] = np.take_along_axis(sim[tied], top[tied], axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)


def _vector_blocks(vectors: DataFrame, n: int) -> DataFrame:
    """(block, data) of n blocks of documents: ids, first, chunks, vectors, as narrow as they are, and ``text`` and ``known`` of each chunk if given."""
    more = [c for c in ("text", "known") if c in vectors.columns]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
        ids = pc.unique(table["doc_id"])
        first = np.searchsorted(pc.index_in(table["doc_id"], ids).to_numpy(), np.arange(len(ids))).astype(np.int32)
        lists = [_flat(v) for v in (ids, pa.array(first), table["chunk_id"], pc.list_flatten(table["embedding"]), *(table[c] for c in more))]
        return pa.table([_flat(table["block"].slice(0, 1)), pa.array([_packed(["ids", "first", "chunks", "vectors", *more], lists)], pa.binary())], BLOCK.names)

    return kept(vectors.filter("doc_id IS NOT NULL").select("doc_id", "chunk_id", "embedding", *more, block_of("doc_id", n).alias("block")).groupBy("block").applyInArrow(pack, BLOCK), "vectors")


def chunk_pair(vectors: DataFrame) -> T.StructType:
    chunk = vectors.schema["chunk_id"].dataType
    return T.StructType([T.StructField("a", chunk), T.StructField("b", chunk), T.StructField("sim", T.DoubleType())])


def _best_lists(parts: list[dict[str, pa.Array]], own: bool, k: int, names: list[str], wanted: np.ndarray | None = None, above: float | None = None) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(a, b, lists of the k best chunk pairs) of the documents of two blocks, of all or of the ``wanted`` pairs, or of those whose mean is ``above``, but for rounding errors."""
    ids = [part["ids"] for part in parts]
    sides = [_documents(part) for part in parts]
    for da, xa, ca in sides[0]:
        for db, xb, cb in sides[1]:
            na, nb = len(ca) // len(da), len(cb) // len(db)
            step = max(1, CELLS // (na * len(cb)))
            for at in range(0, len(da), step):
                rows_ = da[at : at + step]
                live = wanted[np.ix_(rows_, db)] if wanted is not None else np.ones((len(rows_), len(db)), dtype=bool)
                if own:
                    live &= rows_[:, None] < db[None, :]
                p, q = np.nonzero(live)
                if not len(p):
                    continue
                sim = (xa[at * na : (at + step) * na] @ xb.T).reshape(len(rows_), na, len(db), nb).transpose(0, 2, 1, 3)[p, q]
                named = ids[0].take(pa.array(rows_[p])), ids[1].take(pa.array(db[q]))
                flip = pc.greater(*named).to_numpy(zero_copy_only=False)
                for turned in (False, True):
                    some = np.flatnonzero(flip == turned)
                    if not len(some):
                        continue
                    met = sim[some].transpose(0, 2, 1) if turned else sim[some]
                    best, value = _best(met.reshape(len(some), -1), k)
                    if above is not None:
                        high = value.mean(axis=1) > above - SLACK
                        some, best, value = some[high], best[high], value[high]
                        if not len(some):
                            continue
                    inner = na if turned else nb
                    u, v = best // inner, best % inner
                    u, v = (v, u) if turned else (u, v)
                    left, right = ca.take(pa.array(((at + p[some])[:, None] * na + u).ravel())), cb.take(pa.array((q[some][:, None] * nb + v).ravel()))
                    ends = [e.take(pa.array(some)) for e in named]
                    (a, b), (x, y) = (ends[::-1], (right, left)) if turned else (ends, (left, right))
                    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * best.shape[1])
                    yield a, b, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([x, y, pa.array(value.ravel())], names))


def chunk_pairs(vectors: DataFrame, k: int, rows: int, pairs: DataFrame | None = None, above: float | None = None) -> DataFrame:
    """(a, b, l) with a < b of ``vectors`` (doc_id, chunk_id, embedding): the k chunk pairs (a, b, sim) with the largest products, of all pairs of documents or of those of ``pairs``.

    Of equal products those of the smaller chunk of a, then of b, come first.  With ``above``, pairs of documents whose
    mean of these products is not above it (but for rounding errors) are left out where they are found.
    """
    size = vectors.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-size.rows // rows), -(-size.docs // ASKED_DOCS) if pairs is not None else 1, min(int((8 * cores) ** 0.5), size.rows // LEAST_ROWS))
    blocks, one = _vector_blocks(vectors, n), chunk_pair(vectors)
    doc = vectors.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("a", doc), T.StructField("b", doc), T.StructField("l", T.ArrayType(one))])

    def run(own: bool, left: dict, right: dict, *given: pa.Array) -> Iterator[list[pa.Array]]:
        sides, wanted = [left["data"], right["data"]], None
        if given:
            ids = [side["ids"] for side in sides]
            wanted = np.zeros((len(ids[0]), len(ids[1])), dtype=bool)
            x, y = (pc.fill_null(pc.index_in(ends, value_set=own_), -1).to_numpy() for ends, own_ in zip(given, ids, strict=True))
            x, y = x[(x >= 0) & (y >= 0)], y[(x >= 0) & (y >= 0)]
            if own:
                x, y = np.minimum(x, y), np.maximum(x, y)
            wanted[x, y] = True
        for found in _best_lists(sides, own, k, one.names, wanted, above):
            yield list(found)

    return tiled(blocks, n, run, schema, pairs)


def vector_pairs(vectors: DataFrame, similarity: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int) -> DataFrame:
    """(a, b, score) with a < b of all pairs of ``vectors`` (id, embedding): the similarity of the rows of two matrices."""
    kind = vectors.schema["id"].dataType
    cores, size = vectors.sparkSession.sparkContext.defaultParallelism, vectors.count()
    n = max(1, -(-size // rows), min(int((8 * cores) ** 0.5), size // LEAST_ROWS))

    def pack(table: pa.Table) -> pa.Table:
        data = _packed(["ids", "vectors"], [_flat(table["id"]), _flat(pc.list_flatten(table["embedding"]))])
        return pa.table([_flat(table["block"].slice(0, 1)), pa.array([data], pa.binary())], BLOCK.names)

    blocks = kept(vectors.filter("id IS NOT NULL").select("id", "embedding", block_of("id", n).alias("block")).groupBy("block").applyInArrow(pack, BLOCK), "vectors")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType())])
    cells = CELLS

    def run(own: bool, left: dict, right: dict) -> Iterator[list[pa.Array]]:
        (ia, x), (ib, y) = ((part["data"]["ids"], part["data"]["vectors"].to_numpy().reshape(len(part["data"]["ids"]), -1)) for part in (left, right))
        step = max(1, cells // len(y))
        for at in range(0, len(x), step):
            sim = similarity(x[at : at + step], y)
            p, q = np.nonzero(np.triu(np.ones(sim.shape, dtype=bool), at + 1)) if own else np.divmod(np.arange(sim.size), len(y))
            a, b = ia.take(pa.array(p + at)), ib.take(pa.array(q))
            turn = pc.greater(a, b)
            yield [pc.if_else(turn, b, a), pc.if_else(turn, a, b), pa.array(sim[p, q])]

    return tiled(blocks, n, run, schema)


def _ends(ids: list[pa.Array], a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the left and in the right list of the pairs (a, b), of which either may be on the left."""
    x, y = (pc.fill_null(pc.index_in(e, value_set=ids[0]), -1).to_numpy() for e in (a, b))
    z, w = (pc.fill_null(pc.index_in(e, value_set=ids[1]), -1).to_numpy() for e in (a, b))
    straight = (x >= 0) & (w >= 0)
    return np.where(straight, x, y), np.where(straight, w, z)


#: Edges that leave a task at a time.
EDGES = 1 << 12
EVIDENCE = T.ArrayType(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("text_a", T.StringType()), T.StructField("text_b", T.StringType())]))


class _Signals:
    """All signals of the pairs of two blocks that can be edges; a pair is a cell, by its numbers in both lists of documents."""

    def __init__(self, own: bool, left: dict, right: dict, p: SimpleNamespace):
        self.own, self.p = own, p
        both = {c: [side[c] for side in (left, right)] for c in ("entities", "vectors", "topics")}
        self.parts = {c: sides if all(side is not None for side in sides) else None for c, sides in both.items()}
        self.ids = [pc.unique(pa.concat_arrays([part["ids"] for part in side.values() if part is not None])).sort() for side in (left, right)]
        self.n = len(self.ids[1])

    def cells(self, a: pa.Array, b: pa.Array) -> np.ndarray:
        x, y = _ends(self.ids, a, b)
        return x.astype(np.int64) * self.n + y

    def semantic(self) -> None:
        """The best chunk pairs of all pairs with vectors: ``met`` (cells in order), ``lists`` and ``score``."""
        found = list(_best_lists(self.parts["vectors"], self.own, self.p.k, self.p.names)) if self.parts["vectors"] else []
        if not found:
            self.met, self.score, self.lists = np.zeros(0, np.int64), np.zeros(0), None
            return
        a, b, self.lists = (pa.concat_arrays([f[c] for f in found]) for c in range(3))
        first = self.lists.offsets.to_numpy()
        raw = np.add.reduceat(self.lists.values.field("sim").to_numpy(), first[:-1]) / np.diff(first)
        cells = self.cells(a, b)
        order = np.argsort(cells)
        self.met, self.lists = cells[order], self.lists.take(pa.array(order))
        self.score = np.clip((raw[order] - self.p.floor) / (self.p.ceil - self.p.floor), 0, 1)

    def topics(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells))
        if not self.parts["topics"] or not len(cells):
            return out
        places, rows = [], []
        for side, part in zip(self.ids, self.parts["topics"], strict=True):
            places.append(pc.fill_null(pc.index_in(side, value_set=part["ids"]), -1).to_numpy())
            rows.append(part["p"].to_numpy().reshape(len(part["ids"]), -1))
        x, y = places[0][cells // self.n], places[1][cells % self.n]
        known = np.flatnonzero((x >= 0) & (y >= 0))
        for at in range(0, len(known), 1 << 16):
            some = known[at : at + (1 << 16)]
            out[some] = self.p.closeness(rows[0][x[some]], rows[1][y[some]])
        return out

    def edges(self) -> Iterator[list[pa.Array]]:
        """(a, b, l, entity score, shared, topic score) of the pairs that reach the threshold, but for rounding errors."""
        p = self.p
        self.semantic()
        tile, to = None, None
        cells = [self.met[self.score > 0]]
        if self.parts["entities"]:
            left, right = map(_side, self.parts["entities"])
            tile = _Tile(left, right, self.own, p.least or 0.0)
            to = [pc.index_in(s.ids, value_set=ids).to_numpy() for s, ids in zip((left, right), self.ids, strict=True)]
            if p.least is not None:
                cells += [(to[0][lo + c // tile.n].astype(np.int64) * self.n + to[1][c % tile.n]) for lo, _, c in tile.candidates()]
        cells = np.unique(np.concatenate(cells))
        topic, place, known = self.topics(cells), *self.places(cells)
        semantic = np.where(known, self.score[place], 0.0) if len(self.met) else np.zeros(len(cells))
        rest = p.weights[0] * semantic + p.weights[2] * topic
        live = rest + p.weights[1] >= p.threshold - SLACK  # entities can add their weight at most
        self.cand, self.topic, self.rest = cells[live], topic[live], rest[live]
        done = np.zeros(len(self.cand), dtype=bool)
        if tile is not None and len(self.cand):
            back = [np.full(len(ids), -1) for ids in self.ids]
            for own, numbers in zip(back, to, strict=True):
                own[numbers] = np.arange(len(numbers))
            x, y = back[0][self.cand // self.n], back[1][self.cand % self.n]
            both, tile.least = (x >= 0) & (y >= 0), 0.0
            for part in tile.shared(tile.asked(x[both], y[both])):
                if found := tile.scored(part, p.most):
                    a, b, score, _, shared = found
                    at = np.searchsorted(self.cand, self.cells(a, b))
                    done[at] = True
                    yield from self.reached(at, score, shared)
        at = np.flatnonzero(~done)
        yield from self.reached(at, np.zeros(len(at)), None)

    def places(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.met):
            return np.zeros(len(cells), np.int64), np.zeros(len(cells), dtype=bool)
        at = np.minimum(np.searchsorted(self.met, cells), len(self.met) - 1)
        return at, self.met[at] == cells

    def reached(self, at: np.ndarray, entity: np.ndarray, shared: pa.Array | None) -> Iterator[list[pa.Array]]:
        good = np.flatnonzero(self.rest[at] + self.p.weights[1] * entity >= self.p.threshold - SLACK)
        for lo in range(0, len(good), EDGES):
            some = good[lo : lo + EDGES]
            cells, mine = self.cand[at[some]], pa.array(some)
            a, b = self.ids[0].take(pa.array(cells // self.n)), self.ids[1].take(pa.array(cells % self.n))
            flip = pc.greater(a, b)
            place, known = self.places(cells)
            lists = self.lists.take(pa.array(place, mask=~known)) if self.lists is not None else pa.nulls(len(some), self.p.kinds[0])
            listed = shared.take(mine) if shared is not None else pa.nulls(len(some), self.p.kinds[1])
            out = [pc.if_else(flip, b, a), pc.if_else(flip, a, b), lists, pa.array(entity[some]), listed, pa.array(self.topic[at[some]])]
            yield out if self.p.shown is None else [*out, self.evidence(lists)]

    def evidence(self, lists: pa.ListArray) -> pa.Array:
        """Of each list of chunk pairs the first ``shown`` of which both texts are known: similarity and texts; null without any."""
        kind = to_arrow_type(EVIDENCE)
        if self.lists is None:
            return pa.nulls(len(lists), kind)
        chunks, texts, known = (pa.concat_arrays([part[c] for part in self.parts["vectors"]]) for c in ("chunks", "text", "known"))
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy())
        x, y = (pc.index_in(flat.field(c), value_set=chunks).to_numpy() for c in "ab")
        there = pc.fill_null(known, False).to_numpy(zero_copy_only=False)
        live = np.flatnonzero(there[x] & there[y])
        own = owner[live]
        live = live[np.arange(len(own)) - np.searchsorted(own, own) < self.p.shown]
        fields = [flat.field("sim").take(pa.array(live)), *(texts.take(pa.array(z[live])) for z in (x, y))]
        n = np.bincount(owner[live], minlength=len(lists))
        first = np.append(np.cumsum(n) - n, n.sum()).astype(np.int32)
        offsets = pa.array(first, mask=np.append(n == 0, False))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))


def signal_pairs(vectors: DataFrame, weighted: DataFrame, topics: DataFrame | None, k: int, most: int, floor: float, ceil: float, weights: tuple[float, float, float], threshold: float, least: float | None, closeness: Callable[[np.ndarray, np.ndarray], np.ndarray], shown: int | None = None) -> DataFrame:
    """(a, b, l, entity_score, shared, topic_score) with a < b of the pairs that reach the threshold (but for rounding errors) where their blocks meet.

    ``l`` are the k best chunk pairs, ``shared`` the ``most`` rarest entities, ``topics`` (doc_id, p) weights.  A pair needs a semantic
    score above 0 or an entity score of ``least``.  Nothing is shuffled but blocks: no row of a pair is, however many there are.  With ``shown``,
    vectors have the ``text`` of their chunks and whether it is ``known``, and ``evidence`` has the texts of as many best pairs.
    """
    e = _entries(weighted, True)
    rows, entries = vectors.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs")).first(), e.count()
    docs = max(df.select("doc_id").distinct().count() for df in (e, *([] if topics is None else [topics])))
    cores = e.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-rows.rows // (1 << 13)), -(-4 * rows.docs // ASKED_DOCS), -(-entries // ENTRIES), -(-docs // DOCS), min(int((8 * cores) ** 0.5), max(entries // LEAST_ENTRIES, rows.rows // 512)))
    doc, one = vectors.schema["doc_id"].dataType, chunk_pair(vectors)
    parts = [(_entity_blocks(e, n), "entities"), (_vector_blocks(vectors, n), "vectors")]
    if topics is not None:

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("doc_id").combine_chunks()
            data = _packed(["ids", "p"], [_flat(table["doc_id"]), _flat(pc.list_flatten(table["p"]))])
            return pa.table([_flat(table["block"].slice(0, 1)), pa.array([data], pa.binary())], BLOCK.names)

        own = topics.filter("doc_id IS NOT NULL").select("doc_id", "p", block_of("doc_id", n).alias("block"))
        parts.append((own.groupBy("block").applyInArrow(pack, BLOCK), "topics"))
    blocks = e.sparkSession.range(n).select(F.col("id").cast("int").alias("block"))
    for table, name in parts:
        blocks = blocks.join(table.withColumnRenamed("data", name), "block", "left")
    if topics is None:
        blocks = blocks.withColumn("topics", F.lit(None).cast("binary"))
    blocks = kept(blocks.filter("entities IS NOT NULL OR vectors IS NOT NULL OR topics IS NOT NULL"), "blocks")
    schema = T.StructType([T.StructField("a", doc), T.StructField("b", doc), T.StructField("l", T.ArrayType(one)), T.StructField("entity_score", T.DoubleType()), T.StructField("shared", SHARED), T.StructField("topic_score", T.DoubleType()), *([] if shown is None else [T.StructField("evidence", EVIDENCE)])])
    arrow = [to_arrow_type(schema[c].dataType) for c in ("l", "shared")]
    p = SimpleNamespace(k=k, names=one.names, most=most, floor=floor, ceil=ceil, weights=weights, threshold=threshold, least=least, closeness=closeness, kinds=arrow, shown=shown)

    def run(own: bool, left: dict, right: dict) -> Iterator[list[pa.Array]]:
        return _Signals(own, left, right, p).edges()

    return tiled(blocks, n, run, schema)
