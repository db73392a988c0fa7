"""Whitening of embeddings by a tiled covariance.

A pass over the vectors cuts them into row blocks of at most ``BATCH_ROWS`` rows, and
each row block into column blocks of ``TILE`` dimensions.  Pairs of column blocks are
the tile keys: column blocks are shuffled by row block, where each pair of them with
i <= j meets, is centred and multiplied; a task adds up the products of a tile before
it hands them on, and the sums of a tile are added by a grouping.  Only the assembled
covariance, a table of dimensions squared, reaches the driver, which takes its
eigenvectors.  The same code computes the covariance of the whitened vectors, whose
largest distance from the identity is the operator's own check.

Sums and deviations are whole numbers and exact.  A deviation that a 64-bit whole
number cannot hold is null, and entries beyond 2**62 count as 2**62.

Rows whose vector is null or holds a null or non-finite entry are dropped, and so are
vectors whose length is not the most frequent one (of equally frequent lengths, the
longer).  Components are those whose eigenvalue is above ``RANK`` times the largest:
vectors that are all equal, a single vector, and an empty table have none and give no
row.  Repeated rows and ids, and null ids, are rows like any others.  Columns other than
the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.shared import bounded_batches, stored
from docweft.llm.textvec import lists

#: Dimensions of a column block.
TILE = 16
#: Eigenvalues up to this share of the largest are zero but for rounding.
RANK = 1e-12
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**62


def finite(vector: str) -> str:
    """SQL that holds for vectors without null and non-finite entries."""
    return f"{vector} IS NOT NULL AND forall({vector}, c -> c IS NOT NULL AND abs(CAST(c AS DOUBLE)) < CAST('Infinity' AS DOUBLE))"


def usable(rows: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, and the dimension."""
    found = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(finite("vector"))
    sizes = found.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = int(sizes["d"]) if sizes else 0
    return found.filter(F.size("vector") == dim), dim


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers that entries stand for."""
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def column_blocks(rows: DataFrame, values, kind: T.DataType, tile: int) -> DataFrame:
    """(row_block, tile, n, x): the matrix ``values(vectors)`` of each batch of rows, cut into blocks of ``tile`` columns."""
    bounded_batches(rows.sparkSession)
    schema = T.StructType([T.StructField("row_block", T.StringType()), T.StructField("tile", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                x = values(_matrix(batch.column("vector")))
                cuts = [np.ascontiguousarray(x[:, i : i + tile]).ravel() for i in range(0, x.shape[1], tile)]
                first = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
                columns = [[f"{part}/{at}"] * len(cuts), np.arange(len(cuts), dtype=np.int32), np.full(len(cuts), len(x), np.int32)]
                flat = np.concatenate(cuts)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists(flat, first, pa.from_numpy_dtype(flat.dtype))], schema.names)
                at += 1

    return rows.select("vector").mapInArrow(run, schema)


def column_sums(blocks: DataFrame, tile: int, total: str) -> list:
    """The sum of each dimension: one row a dimension reaches the driver.  ``total`` is the type that sums take."""
    kind = blocks.schema["x"].dataType.elementType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("s", kind)])
    whole = isinstance(kind, T.LongType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, x in zip(batch.column("n").to_pylist(), batch.column("tile").to_pylist(), batch.column("x"), strict=True):
                m = x.values.to_numpy(zero_copy_only=False).reshape(n, -1)
                # a block's sum fits 64 bits unless entries are huge: their rows go on one by one
                parts = [*m] if whole and np.abs(m).max() > 2.0**50 else [m.sum(axis=0)]
                dims = np.arange(at * tile, at * tile + m.shape[1], dtype=np.int32)
                for p in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(p)], schema.names)

    found = blocks.select("tile", "n", "x").mapInArrow(run, schema)
    return [r["s"] for r in found.groupBy("dim").agg(F.sum(F.col("s").cast(total)).alias("s")).orderBy("dim").collect()]


def covariance(blocks: DataFrame, mean: np.ndarray, n: int, tile: int) -> np.ndarray:
    """The covariance matrix (divisor ``n``) of stored column blocks around ``mean``."""
    left = blocks.select("row_block", F.col("tile").alias("i"), "n", F.col("x").alias("a"))
    right = blocks.select("row_block", F.col("tile").alias("j"), F.col("x").alias("b"))
    met = left.join(right, "row_block").filter("i <= j").select("i", "j", "n", "a", "b")
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def centred(x: pa.ListScalar, rows: int, at: int) -> np.ndarray:
            m = x.values.to_numpy(zero_copy_only=False).reshape(rows, -1)
            return m - mean[at * tile : at * tile + m.shape[1]]

        for batch in batches:
            for i, j, rows, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "n")), batch.column("a"), batch.column("b"), strict=True):
                product = centred(a, rows, i).T @ centred(b, rows, j)
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        keys = sorted(sums)
        if keys:
            first = np.concatenate([[0], np.cumsum([sums[k].size for k in keys])])
            flat = np.concatenate([sums[k].ravel() for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), lists(flat, first, pa.float64())], schema.names)

    cells = met.mapInArrow(run, schema).select("i", "j", F.posexplode("sums").alias("at", "s")).groupBy("i", "j", "at").agg(F.sum("s").alias("s"))
    found = cells.toPandas()  # dimensions squared
    d = len(mean)
    i, j, at = (found[c].to_numpy(np.int64) for c in ("i", "j", "at"))
    wide = np.minimum(tile, d - j * tile)
    out = np.zeros((d, d))
    p, q = i * tile + at // wide, j * tile + at % wide
    out[p, q] = out[q, p] = found["s"].to_numpy() / n
    return out


@dataclass
class Whitening:
    """What whitens: exact sums of ``n`` vectors, eigenvalues by falling size, and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of whole-number vectors."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - base) - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact modulo 2**64 and null where that is not the number itself."""
        n, s = np.uint64(self.n), np.array([s % 2**64 for s in self.sums], dtype=np.uint64)
        apart = x.astype(np.uint64) * n - s
        exact = (apart * apart).sum(axis=1, dtype=np.uint64).astype(np.int64)
        near = ((self.n * (x - self.mean)) ** 2).sum(axis=1)
        return pa.array(exact, mask=near > 2.0**63 * (1 - 1e-9))


def fit(rows: DataFrame, dim: int, most: int, tile: int = TILE) -> Whitening | None:
    """The whitening of all rows (vector) of dimension ``dim`` to at most ``most`` components; None if they do not differ."""
    if not dim:
        return None
    blocks = stored(column_blocks(rows, scaled, T.LongType(), tile), "column-blocks")
    n = int(blocks.filter("tile = 0").agg(F.sum("n")).first()[0] or 0)
    if not n:
        return None
    model = Whitening(n, [int(s) for s in column_sums(blocks, tile, "decimal(38,0)")], np.zeros(0), np.zeros((dim, 0)), 0.0)
    cov = covariance(blocks, model.mean, n, tile)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = int((values > RANK * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not held:
        return None
    vectors = vectors[:, : min(held, most)]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return Whitening(n, model.sums, values[: vectors.shape[1]], vectors, float(np.trace(cov)))


def identity_error(rows: DataFrame, model: Whitening, tile: int = TILE) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    blocks = stored(column_blocks(rows, lambda v: model.apply(scaled(v)), T.DoubleType(), tile), "whitened-blocks")
    mean = np.array(column_sums(blocks, tile, "double")) / model.n
    return float(np.abs(covariance(blocks, mean, model.n, tile) - np.eye(len(mean))).max())


def whitened(rows: DataFrame, most: int = 32, id_col: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    used, dim = usable(rows, id_col, vector)
    kind = rows.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    model = fit(used, dim, most, tile)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, share = identity_error(used, model, tile), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            if batch.num_rows:
                x, rep = scaled(_matrix(batch.column("vector"))), pa.array(np.repeat(np.arange(batch.num_rows), k))
                size = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rep), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, model.n)), model.deviations(x).take(rep)]
                    + [pa.array(model.apply(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(size, error))],
                    schema.names,
                )

    return used.mapInArrow(run, schema)
