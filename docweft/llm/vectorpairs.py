"""Near-duplicates of embeddings by int8 tile products with rigorous error bounds.

Each vector u of length 1 is written as u = s c + e with int8 codes c, a scale s and an
error e whose length is kept beside it.  For two vectors

    | u.v - s_u s_v (c_u . c_v) | <= |e_u| + |e_v| + |e_u| |e_v|,

so a product of codes tells most pairs apart from the threshold.  Only pairs that the
bound leaves open are computed again, in double precision from the vectors themselves.

The vectors of a label are dealt over tiles; the number of tiles grows with the square
root of the label's vectors, so tasks grow both in number and in size, and no tile is
larger than ``MOST`` vectors however many a label has.  Codes of two tiles meet in one
task, once.  What leaves it are not pairs but, for each vector, how many links it has
there and one link to the smallest member of its group there, so a group of copies costs
rows in proportion to its size.  A second round ships whole vectors, and only those
that have an open pair, to the same pairs of tiles.

Vectors are compared when their labels are equal and not null and their lengths are the
same.  A vector that is null, empty or zero, or holds a null or non-finite component, links
with nothing.  Repeated rows, with the same id or not, are vectors of their own.  The
component of a row is the smallest id that links reach; a null id is larger than all
others, and a row whose component has no other id is kept.  Columns other than id,
vector and label are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.graphs import components
from docweft.llm.shared import bounded_batches, stored
from docweft.llm.whitening import finite

#: Vectors of a tile: so many times the root of their label's number, and at most.
ROOTS, MOST = 32, 1 << 17
#: Partitions over which the rows of a label are dealt to learn how many tiles it has.
SALTS = 64
#: Products that a task holds at a time, and the dimensions whose products of codes a float32 adds up exactly.
CELLS, EXACT_DIMS = 1 << 21, 1024
#: What float32 scales and sums may be off by, for values up to 1.1.
ROUNDING = 4e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision, whatever their size."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error): int8 codes of unit vectors, and a bound on the length of what they leave out."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.sqrt(((u - scale[:, None] * codes) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of float32 codes, exact up to 2**24 in each run of dimensions."""
    out = a[:, :EXACT_DIMS] @ b[:, :EXACT_DIMS].T
    for at in range(EXACT_DIMS, a.shape[1], EXACT_DIMS):
        out = out + (a[:, at : at + EXACT_DIMS].astype(np.float64) @ b[:, at : at + EXACT_DIMS].T)
    return out


class Side:
    """Codes, scales and errors of the vectors of a tile."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray):
        self.codes, self.scale, self.error = codes.astype(np.float32), scale, error

    def __len__(self) -> int:
        return len(self.scale)


def bounded_pairs(left: Side, right: Side, threshold: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, sure) of the pairs that may reach the threshold, some rows at a time; ``own``: each pair of one tile once."""
    if not len(left) or not len(right):
        return
    most = left.error.max() + right.error.max() + left.error.max() * right.error.max()
    across = right.scale.astype(np.float32)
    step = max(1, CELLS // len(right))
    for at in range(0, len(left), step):
        to = min(at + step, len(left))
        dots = _products(left.codes[at:to], right.codes)
        dots *= across
        dots *= left.scale[at:to, None].astype(np.float32)
        p, q = np.nonzero(dots >= threshold - most - ROUNDING)
        value = dots[p, q].astype(np.float64)
        p += at
        if own:
            value, p, q = (x[q > p] for x in (value, p, q))
        slack = left.error[p] + right.error[q] + left.error[p] * right.error[q] + ROUNDING
        near = value + slack >= threshold
        yield p[near], q[near], value[near] - slack[near] >= threshold


class Groups:
    """Numbers of links, and groups of what is linked, of ``n`` vectors."""

    def __init__(self, n: int):
        self.links, self.root = np.zeros(n, np.int64), np.arange(n)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.links += np.bincount(p, minlength=len(self.root)) + np.bincount(q, minlength=len(self.root))
        while True:
            a, b = self.root[p], self.root[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (label, dim, ...) with the number of tiles of their label and dimension as ``tiles``."""
    salted = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    n = F.col("n")
    counts = rows.groupBy("label", "dim").agg(F.count("*").alias("n"))
    # at least as many tiles as keep each below MOST on average, with room for chance
    counts = counts.withColumn("tiles", F.ceil(F.greatest(F.sqrt(n) / ROOTS, n / (0.9 * MOST))).cast("int"))
    counts = counts.select("label", "dim", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(counts, ["label", "dim", "salt"]).drop("salt")


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row once for each pair of tiles (lo, hi) that its own tile is in."""
    placed = rows.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("other", "tiles")


def _node(id_col: Column, row: Column) -> Column:
    """A vector as a node: nodes have the order of their ids, null ids come last."""
    return F.struct(id_col.isNull().alias("no_id"), id_col.alias("id"), row.alias("row"))


def _met(dealt: DataFrame, id_kind: T.DataType, threshold: float, whole: bool) -> DataFrame:
    """(row, id, links, root_row, root_id, open) of each row with a link or an open pair in a pair of tiles.

    The first round reads codes and marks rows that have an open pair; the second (``whole``)
    reads vectors, and counts the pairs that were open.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_kind), T.StructField("links", T.LongType()), T.StructField("root_row", T.LongType()), T.StructField("root_id", id_kind), T.StructField("open", T.BooleanType())])
    keys = ["label", "dim", "lo", "hi"]

    def run(table: pa.Table) -> pa.Table:
        lo, hi, dim = (table.column(c)[0].as_py() for c in ("lo", "hi", "dim"))
        table = table.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()  # null ids come last
        n, tile = table.num_rows, table.column("tile").to_numpy()
        if whole:
            u = unit(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim))
            codes, scale, error = quantised(u)
        else:
            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(n, dim)
            scale, error = table.column("scale").to_numpy(), table.column("error").to_numpy()
        a, b = (np.flatnonzero(tile == t) for t in (lo, hi))
        left, right = (Side(codes[x], scale[x], error[x]) for x in (a, b))
        found, undecided = Groups(n), np.zeros(n, bool)
        for p, q, sure in bounded_pairs(left, right, threshold, lo == hi):
            p, q = a[p], b[q]
            if not whole:
                undecided[p[~sure]] = undecided[q[~sure]] = True
                found.add(p[sure], q[sure])
                continue
            p, q = p[~sure], q[~sure]
            step = max(1, CELLS // dim)
            for at in range(0, len(p), step):
                x, y = p[at : at + step], q[at : at + step]
                linked = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
                found.add(x[linked], y[linked])
        out = np.flatnonzero((found.links > 0) | undecided)
        ids, rows, root = table.column("id"), table.column("row"), pa.array(found.root[out])
        return pa.table([rows.take(pa.array(out)), ids.take(pa.array(out)), pa.array(found.links[out]), rows.take(root), ids.take(root), pa.array(undecided[out])], schema.names)

    columns = [*keys, "tile", "row", "id", *(["vector"] if whole else ["codes", "scale", "error"])]
    return dealt.select(*columns).groupBy(*keys).applyInArrow(run, schema)


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with the codes, scale and error of their vectors."""
    bounded_batches(rows.sparkSession)
    schema = T.StructType([*rows.schema, T.StructField("codes", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):  # vectors of one length at a time
                part = batch.filter(pa.array(dims == dim))
                codes, scale, error = quantised(unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
                raw = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw, pa.array(scale), pa.array(error)], schema.names)

    return rows.mapInArrow(run, schema)


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row: links are pairs of one label whose cosine reaches ``threshold``, above 0."""
    own = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    kind = own.schema["id"].dataType
    live = own.filter(f"label IS NOT NULL AND {finite('vector')} AND exists(vector, c -> c != 0)").withColumn("dim", F.size("vector"))
    coded = stored(_tiles(_coded(live)), "codes")
    first = stored(_met(_dealt(coded.drop("vector")), kind, threshold, whole=False), "links")
    # whole vectors of rows that have an open pair somewhere, in all of their pairs of tiles
    again = coded.join(first.filter("open").select("row").distinct(), "row", "left_semi")
    second = stored(_met(_dealt(again.drop("codes", "scale", "error")), kind, threshold, whole=True), "links")
    found = first.unionByName(second).filter("links > 0")
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    edges = found.filter("row != root_row").select(_node(F.col("id"), F.col("row")).alias("a"), _node(F.col("root_id"), F.col("root_row")).alias("b"))
    joined = components(edges).select(F.col("node.row").alias("row"), F.col("component.id").alias("smallest"), F.lit(True).alias("linked"))
    out = own.select("row", "id").join(links, "row", "left").join(joined, "row", "left")
    component = F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
