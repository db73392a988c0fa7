"""Exact and near duplicates of chunks at ingestion, and the ids of what is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.sources.store import kept

#: Most rows of a block: each block is shipped to all that it meets, so large ones keep the shuffle small.
BLOCK_ROWS = 1 << 14
#: Rows that make a cell worth while, and cells of a matrix of similarities that a task holds at a time.
CELL_ROWS, CELLS = 1 << 10, 1 << 22
#: Pairs of rows that are worth a task of their own.
TASK_PAIRS = 1 << 20
#: Vectors that cells are made around.
PIVOTS = 64
#: Undecided rows that the sequential rule settles first; every round takes twice as many.
FIRST_ROWS = 1 << 13
#: Hashes that more than this part of the repeated rows have are joined by broadcast; there are at most as many.
FREQUENT = 1000


def exact_duplicates(chunks: DataFrame, known: DataFrame | None = None, order: str = "chunk_id") -> DataFrame:
    """All rows with ``is_duplicate``: the hash is known already, or an earlier row has it.

    One row for each hash is found by partial aggregates: its first row, its number of rows
    and whether it is known.  Hashes of which nothing follows are left out, and those that
    more than a ``FREQUENT``-th part of all rows have - at most ``FREQUENT`` - are sent to all
    tasks, so that no task meets the rows of a hot hash.  A null hash is nobody's duplicate.
    """
    groups = chunks.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    if known is not None:
        seen = known.filter("content_hash IS NOT NULL").select("content_hash").distinct().withColumn("_known", F.lit(True))
        groups = groups.join(seen, "content_hash", "left")
    else:
        groups = groups.withColumn("_known", F.lit(None).cast("boolean"))
    groups = groups.filter("_n > 1 OR _known").withColumn("_known", F.coalesce("_known", F.lit(False)))
    total = groups.agg(F.sum("_n").alias("_total"))
    hot = F.col("_n") * FREQUENT > F.col("_total")
    sized = groups.join(F.broadcast(total))
    frequent = sized.filter(hot).select("content_hash", F.struct("_first", "_known").alias("_hot"))
    rest = sized.filter(~hot).select(F.col("content_hash").alias("_key"), F.struct("_first", "_known").alias("_cold"))
    placed = chunks.join(F.broadcast(frequent), "content_hash", "left")
    # rows that are settled get keys of their own, spread over all tasks
    settled = F.concat(F.lit("~"), F.xxhash64(order).cast("string"))
    placed = placed.withColumn("_key", F.when(F.col("_hot").isNotNull() | F.col("content_hash").isNull(), settled).otherwise(F.col("content_hash")))
    marked = placed.join(rest, "_key", "left").withColumn("_group", F.coalesce("_hot", "_cold"))
    return marked.withColumn("is_duplicate", F.coalesce(F.col("_group._known") | (F.col(order) > F.col("_group._first")), F.lit(False))).select(*chunks.columns, "is_duplicate")


def chosen_pivots(vectors: DataFrame, k: int = PIVOTS) -> np.ndarray:
    """At most ``k`` of the vectors, the ones whose ids have the smallest hashes: a fixed choice of bounded size."""
    rows = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(k).collect()
    return np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)


@dataclass(frozen=True)
class Metric:
    """A similarity of the rows of two matrices that falls as a distance with a triangle inequality grows.

    ``distance`` is that distance for a similarity: it turns a threshold into the distance within
    which pairs have to be looked for.
    """

    similarity: Callable[[np.ndarray, np.ndarray], np.ndarray]
    distance: Callable[[np.ndarray], np.ndarray]


def _closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - root of the Jensen-Shannon divergence (base 2) of distributions, topic by topic, so that memory is that of the result.

    Twelve decimals are kept: shares do not add up to exactly 1, and disjoint distributions have 0.
    """
    out = np.zeros((len(x), len(y)))
    for p, q in zip(x.T[:, :, None], y.T[:, None, :], strict=True):
        middle = (p + q) / 2
        for side in (p, q):
            share = np.divide(side, middle, out=np.ones_like(middle), where=side > 0)
            out += side * np.log2(share)
    return np.round(1 - np.sqrt(np.maximum(out / 2, 0.0)), 12)


#: Unit vectors: the angle is the distance.
COSINE = Metric(lambda x, y: x @ y.T, lambda sim: np.arccos(np.clip(sim, -1.0, 1.0)))
#: Distributions (sum 1): the root of the divergence is a metric.
CLOSENESS = Metric(_closeness, lambda sim: 1.0 - sim)


def partitioned(vectors: DataFrame, pivots: np.ndarray, rows: int = BLOCK_ROWS, metric: Metric = COSINE) -> DataFrame:
    """(block, n, lo, hi, rows): blocks of about ``rows`` vectors that are nearest to the same pivot, stored.

    ``lo`` and ``hi`` bound the distances of a block's vectors to each pivot.  A pivot with very many
    vectors has as many blocks as they need.
    """
    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.ArrayType(T.DoubleType())), T.StructField("id", kind), vectors.schema["embedding"]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = metric.distance(metric.similarity(batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64), pivots))
                first = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(pivots))
                yield pa.RecordBatch.from_arrays([pa.array(far.argmin(axis=1).astype(np.int32)), pa.ListArray.from_arrays(first, pa.array(far.ravel())), batch.column("id"), batch.column("embedding")], schema.names)

    placed = kept(vectors.select("id", "embedding").mapInArrow(place, schema), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("parts"))  # a row for each pivot at most
    spread = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.struct("cell", F.pmod(F.xxhash64("id"), "parts").alias("part")))
    bounds = [f(F.get("far", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(len(pivots))]
    blocks = spread.groupBy("block").agg(F.collect_list(F.struct("id", "embedding")).alias("rows"), *bounds)
    lists = [F.array(*(F.col(f"{name}{i}") for i in range(len(pivots)))).alias(name) for name in ("lo", "hi")]
    return kept(blocks.select("block", F.size("rows").alias("n"), *lists, "rows"), "blocks")


def _apart(threshold: float, metric: Metric) -> Column:
    """Whether no vector of one block can reach the threshold with one of the other: the triangle inequality at any pivot."""
    reach = float(metric.distance(threshold)) + 1e-7
    gaps = F.zip_with(F.arrays_zip(F.col("la").alias("l"), F.col("ha").alias("h")), F.arrays_zip(F.col("lb").alias("l"), F.col("hb").alias("h")), lambda a, b: F.greatest(a["l"] - b["h"], b["l"] - a["h"]))
    return F.exists(gaps, lambda g: g > reach)


def block_pairs(left: DataFrame, right: DataFrame, threshold: float, own: bool, metric: Metric = COSINE) -> DataFrame:
    """(bl, br) of the blocks that have to be compared; only their bounds take part."""
    a = left.select(F.col("block").alias("bl"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = right.select(F.col("block").alias("br"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    return a.join(b, (F.col("bl") <= F.col("br") if own else F.lit(True)) & ~_apart(threshold, metric)).select("bl", "br")


def _matrix(column: pa.ListArray, i: int) -> tuple[pa.Array, np.ndarray]:
    rows = column[i].values
    return rows.field("id"), rows.field("embedding").flatten().to_numpy().reshape(len(rows), -1).astype(np.float64)


def _met(left: DataFrame, right: DataFrame, threshold: float, own: bool, metric: Metric = COSINE, once: bool = False) -> DataFrame:
    """(a, b, sim) of the rows of two tables of blocks whose similarity is above the threshold; ``own``: of one table with itself.

    ``once``: (a, b) alone, of two blocks each pair of ids once, however many of their rows are similar.
    """
    kind = left.schema["rows"].dataType.elementType["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *([] if once else [T.StructField("sim", T.DoubleType())])])
    pairs = block_pairs(left, right, threshold, own, metric)
    size = [t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (left, right)]
    tasks = max(1, min(4096, pairs.count(), max(left.sparkSession.sparkContext.defaultParallelism, size[0] * size[1] // TASK_PAIRS)))  # by the pairs of rows to compare, however few bytes the blocks have
    sides = (t.select(F.col("block").alias(b), F.col("rows").alias(r)).join(F.broadcast(pairs), b).repartition(tasks, "bl", "br") for t, b, r in ((left, "bl", "rl"), (right, "br", "rr")))
    both = next(sides).join(next(sides), ["bl", "br"]).withColumn("same", F.lit(own) & (F.col("bl") == F.col("br"))).select("same", "rl", "rr")

    def named(a: pa.Array, b: pa.Array, *sim: pa.Array) -> pa.RecordBatch:
        if own:
            turn = pc.greater(a, b)
            a, b = pc.if_else(turn, b, a), pc.if_else(turn, a, b)
        return pa.RecordBatch.from_arrays([a, b, *sim], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ia, xa), (ib, xb) = _matrix(batch.column("rl"), i), _matrix(batch.column("rr"), i)
                same = batch.column("same")[i].as_py()
                if once:  # by id, so that a step sees few of them
                    na, nb = pc.unique(ia), pc.unique(ib)
                    u, v = (pc.index_in(x, value_set=names).to_numpy() for names, x in ((na, ia), (nb, ib)))
                    order = np.argsort(u, kind="stable")
                    u, xa = u[order], xa[order]
                    if same:
                        v, xb = u, xa
                    met, last = np.zeros(len(nb), dtype=bool), -1
                step = max(1, CELLS // max(1, len(xb)))
                for at in range(0, len(xa), step):
                    to = at if same else 0
                    sim = metric.similarity(xa[at : at + step], xb[to:])
                    if same:
                        sim[np.tril_indices(len(sim), m=sim.shape[1])] = -np.inf
                    p, q = np.nonzero(sim > threshold)
                    if not once:
                        yield named(ia.take(pa.array(p + at)), ib.take(pa.array(q + to)), pa.array(sim[p, q]))
                        continue
                    low = u[at]
                    rows = np.zeros((u[min(at + step, len(u)) - 1] - low + 1, len(nb)), dtype=bool)
                    rows[u[p + at] - low, v[q + to]] = True
                    if low == last:
                        rows[0] |= met
                    elif last >= 0:
                        q = np.flatnonzero(met)
                        yield named(na.take(pa.array(np.full(len(q), last))), nb.take(pa.array(q)))
                    p, q = np.nonzero(rows[:-1])
                    yield named(na.take(pa.array(p + low)), nb.take(pa.array(q)))
                    met, last = rows[-1], low + len(rows) - 1
                if once:
                    q = np.flatnonzero(met)
                    yield named(na.take(pa.array(np.full(len(q), last))), nb.take(pa.array(q)))

    return both.mapInArrow(run, schema)


def similar_pairs(vectors: DataFrame, threshold: float, rows: int = BLOCK_ROWS, metric: Metric = COSINE, once: bool = False) -> DataFrame:
    """(a, b, sim) with a < b and a similarity above (strictly) the threshold, of (id, embedding): unit vectors for the cosine.

    Vectors are dealt into cells around pivots.  Blocks of cells that the triangle inequality
    keeps apart never meet; of the others each pair is compared as two matrices, and only pairs
    above the threshold leave it.  ``once`` is for repeated ids: (a, b), of each pair of blocks once.
    """
    blocks = partitioned(vectors, chosen_pivots(vectors, cells(vectors)), rows, metric)
    return _met(blocks, blocks, threshold, own=True, metric=metric, once=once)


def cells(vectors: DataFrame) -> int:
    """How many cells a table is dealt into: a block is shipped to all that it meets, so few rows make few cells."""
    return max(1, min(PIVOTS, vectors.count() // CELL_ROWS))


def near_known(vectors: DataFrame, known: DataFrame, threshold: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """(id) of the vectors with a cosine above the threshold to one of ``known`` (id, embedding)."""
    pivots = chosen_pivots(known, cells(known))
    if not len(pivots):
        return vectors.select("id").limit(0)
    left, right = (partitioned(v.select("id", "embedding"), pivots, rows) for v in (vectors, known))
    return _met(left, right, threshold, own=False).select(F.col("a").alias("id")).distinct()


def near_duplicates_onepass(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, is_near_dup): some earlier vector is above the threshold, kept or not."""
    later = similar_pairs(vectors, threshold).select(F.col("b").alias("id")).distinct().withColumn("is_near_dup", F.lit(True))
    return vectors.select("id").join(later, "id", "left").withColumn("is_near_dup", F.coalesce("is_near_dup", F.lit(False)))


def near_duplicates(vectors: DataFrame, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """(id, is_near_dup) of the sequential rule: a vector goes if an earlier *kept* one, or one of ``known``, is above the threshold.

    The first rows by id are settled among themselves; what is kept of them takes its later neighbours
    away, and the first of what is left follow, twice as many each time.  So only rows that no earlier round
    has settled are linked with each other, however many links all rows have.
    """
    rows = vectors.select("id", "embedding")
    rest = rows.filter("id IS NOT NULL")
    if known is not None:
        rest = rest.join(near_known(rest, known, threshold), "id", "left_anti")
    rest, size, firm = kept(rest, "rest"), FIRST_ROWS, rows.select("id").limit(0)
    while n := rest.count():
        head = rest
        if (border := _border(rest, n, size)) is not None:
            head = kept(rest.filter(F.col("id") <= F.lit(border)), "head")
        free = kept(head.join(_gone(head, threshold), "id", "left_anti"), "free")
        firm = firm.union(free.select("id"))
        if border is None:
            break
        later = rest.filter(F.col("id") > F.lit(border))
        rest, size = kept(later.join(near_known(later, free, threshold), "id", "left_anti"), "rest"), 2 * size
    return rows.select("id").join(firm.distinct().withColumn("_firm", F.lit(True)), "id", "left").select("id", (F.col("id").isNotNull() & F.col("_firm").isNull()).alias("is_near_dup"))


def _border(rows: DataFrame, n: int, size: int):
    """An id that about ``size`` of the n rows do not exceed, None for all; which one it is decides nothing but the work of a round."""
    if n <= 2 * size:
        return None
    step = max(1, size // 1024)
    some = [r.id for r in rows.select("id").filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).orderBy("id").limit(size // step).collect()]  # about 1024 ids
    return some[-1] if some else None


def _gone(rows: DataFrame, threshold: float) -> DataFrame:
    """(id) of the rows that the sequential rule drops: a row is decided once all its earlier neighbours are."""
    gone = rows.select("id").limit(0)
    links = kept(similar_pairs(rows, threshold).select("a", "b").filter("a <> b"), "links")  # a repeated row is no link
    while not links.isEmpty():
        # rows without an earlier link are kept, and what they link goes, with its own links
        free = links.select("a").distinct().join(links.select(F.col("b").alias("a")), "a", "left_anti")
        out = kept(links.join(free, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "out")
        left = links.join(free, "a", "left_anti").join(out.select(F.col("id").alias("a")), "a", "left_anti").join(out.select(F.col("id").alias("b")), "b", "left_anti")
        links, gone = kept(left.select("a", "b"), "links"), gone.union(out)
    return gone


def vector_ids(rows: DataFrame, stored: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Contiguous ids after the largest stored one, in order: ranks inside range partitions plus the rows of those before.

    Rows are stored with their partitions: its bounds come from a sample, so a second shuffle, as that of fewer columns, has others.
    """
    base = stored.agg(F.coalesce(F.max("vector_id"), F.lit(-1)).alias("base"))
    placed = kept(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "placed")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = ranked.groupBy("_part").agg(F.max("_rank").alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranked.join(F.broadcast(before.select("_part", "_before")), "_part").join(F.broadcast(base))
    return out.withColumn("vector_id", F.col("base") + F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before", "base")


def ingest_stats(chunks: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Chunk, indexed and duplicate counts of each document, and with ``events`` (doc_id, ts) the time from its first to its last one."""
    dup = F.sum(F.col("is_duplicate").cast("long"))
    out = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), (F.count("*") - dup).alias("indexed_count"), dup.alias("duplicate_count"))
    if events is None:
        return out
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return out.join(events.groupBy("doc_id").agg(((F.max(at) - F.min(at)) / 1000.0).alias("total_ms")), "doc_id", "left")
