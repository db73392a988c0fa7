"""What the trained operators share: the split by document id, the bounded labelled sample, and scoring.

Document ids are split by crc32 of their decimal text, so that training and
held-out rows are the same everywhere.  A null id counts as the empty text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.shared import bounded_batches, stored
from docweft.llm.textvec import flat, slices

#: Sampled ids that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` training rows of each class, stored.

    Only ids with a text in ``docs`` are eligible.  Of each class those with the smallest
    hash of their id are taken, a fixed choice that does not depend on partitioning.  An id
    that has several labels counts with the smallest, one that has several texts with the
    first of them in order.  Rows with a null id or label, and ids of the held-out
    remainder, are never taken.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("id"), modulus) != held))
    present = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"))
    usable = marked.groupBy("id").agg(F.min("label").alias("label")).join(present, "id", "left_semi").withColumn("order", F.pmod(F.xxhash64("id"), F.lit(1 << 62)))
    # of each class a little more than per_class rows, by their hash alone, so that no task meets all rows of a class
    counts = usable.groupBy("label").agg(F.count("*").alias("n"))  # a row for each class that the model can name: the driver holds them all
    enough = per_class + 6 * math.sqrt(per_class) + 20
    some = usable.join(F.broadcast(counts), "label").filter(F.col("order") / float(1 << 62) * F.col("n") < enough)
    best = some.groupBy("label").agg(F.slice(F.sort_array(F.collect_list(F.struct("order", "id"))), 1, per_class).alias("best"))
    picked = best.select("label", F.explode("best").alias("b")).select(F.col("b.id").alias("id"), "label")
    picked = stored(picked.select("id", "label"), "picked")
    small = picked.count() <= BROADCAST_ROWS
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(picked) if small else picked, F.col("doc_id") == F.col("id"))
    return stored(joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, text, label) of all training rows with a text; an id that has several labels counts with the smallest.

    Texts stay where they are as long as the labels can be sent to them; more than ``BROADCAST_ROWS`` are joined by a shuffle.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    marked = stored(usable.groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("label")), "marked")
    side = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(side, F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")


def summed(df: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], least: int = 1, groups: int = 8) -> np.ndarray:
    """The sum over all rows of an array made from each batch of ``least`` rows, or what a task has left: tasks add up their own, a few tasks those, the driver the rest."""
    schema = T.StructType([T.StructField("m", T.BinaryType())])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= least:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch], made: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = made(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype(np.float64).tobytes(), 1)], pa.binary())], ["m"])

    def again(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.frombuffer(zlib.decompress(m.as_py())) for m in batch.column(0))

    parts = df.mapInArrow(lambda batches: run(gathered(batches), kernel), schema).repartition(groups).mapInArrow(lambda batches: run(batches, again), schema)
    found = [np.frombuffer(zlib.decompress(r.m)) for r in parts.collect()]  # an array for each group
    return sum(found) if found else np.zeros(0)


def class_counts(labels: DataFrame, label: str, modulus: int, held: int) -> dict[int, int]:
    """Training ids of each class over all of the labels (not the sample); an id with several labels counts with the smallest."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    rows = usable.groupBy("doc_id").agg(F.min(label).alias("label")).groupBy("label").count().collect()
    return {int(r[0]): int(r[1]) for r in rows}


def map_texts(df: DataFrame, kept: list[str], fields: list[T.StructField], kernel: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """Run ``kernel(bytes, offsets)`` over whole texts in bounded slices; ``kept`` columns stay in front."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *kernel(*flat(part.column("text")))], schema.names)

    return df.select(*kept, "text").mapInArrow(run, schema)


def scored(docs: DataFrame, modulus: int, held: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    df = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))

    def both(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        score = kernel(data, offs).astype(np.float64)
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return map_texts(df, ["doc_id", "held_out"], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], both)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
