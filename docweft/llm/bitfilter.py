"""A bit filter that keeps rows without a partner out of a shuffle, and packed texts.

The filter has every member's bit, so it never drops a row that has a partner; the
join that follows is what decides.  It has about eight bits for each key, between
2**``LEAST_BITS`` and 2**``MOST_BITS`` (128 MB) of them: with still more members it
lets more rows through, and nothing else changes.  Keys are of any type; Spark hashes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.textvec import SLICE_BYTES, release

LEAST_BITS, MOST_BITS = 20, 30
#: The filter is filled in so many ranges of slots, each by one task.
RANGES = 64
#: Distinct slots that a task gathers before it passes them on.
GATHER = 1 << 20


@dataclass
class BitFilter:
    """``bits``: one bit for each slot; a key's slot is its hash modulo their number."""

    bits: np.ndarray

    def slot(self, *key: Column | str) -> Column:
        """The slot of a key, as a column that ``maybe_in`` takes."""
        return F.pmod(F.xxhash64(*key), F.lit(8 * len(self.bits)))

    def maybe_in(self, slot: np.ndarray) -> np.ndarray:
        """False only for slots without a member."""
        return (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def bit_filter(keys: DataFrame, hashed: bool = False) -> BitFilter:
    """The filter of a (stored) table of keys, over all its columns; every range of slots is filled by one task.

    ``hashed`` keys are one long column that is a hash already: its lowest bits are the slot.
    """
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))
    part = size // RANGES
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("found", T.BinaryType())])

    def rows(found: dict[int, bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], schema.names)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.int64)
        for batch in batches:
            held = np.union1d(held, batch.column(0).to_numpy())
            if len(held) >= GATHER:
                yield rows(split(held))
                held = held[:0]
        yield rows(split(held))

    def split(slot: np.ndarray) -> dict[int, bytes]:
        edges = np.searchsorted(slot, np.arange(RANGES + 1) * part)
        return {i: (slot[edges[i] : edges[i + 1]] % part).astype(np.uint32).tobytes() for i in np.flatnonzero(np.diff(edges)).tolist()}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            for own, found in zip(batch.column("part").to_pylist(), batch.column("found").to_pylist(), strict=True):
                flags.setdefault(own, np.zeros(part, dtype=bool))[np.frombuffer(found, np.uint32)] = True
        yield rows({own: np.packbits(flag).tobytes() for own, flag in flags.items()})

    key = F.col(keys.columns[0]) if hashed else F.xxhash64(*keys.columns)
    seen = keys.select(F.pmod(key, F.lit(size)).alias("slot")).mapInArrow(slots, schema)
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in seen.repartition(RANGES, "part").mapInArrow(fill, schema).collect():  # the filter itself: size / 8 bytes
        out[row.part * part // 8 : (row.part + 1) * part // 8] = np.frombuffer(row.found, np.uint8)
    return BitFilter(out)


def packed_texts(docs: DataFrame, key: str | list[str], members: BitFilter) -> DataFrame:
    """The columns of ``docs`` but ``text``, and the compressed text (``packed``), of rows whose key may be a member; null texts are empty."""
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            part = batch.filter(pa.array(members.maybe_in(batch.column("_docweft_slot").to_numpy())))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([press.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())], schema.names)

    slot = members.slot(*([key] if isinstance(key, str) else key)).alias("_docweft_slot")
    return docs.select(*kept, slot, "text").mapInArrow(pack, schema)


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of a packed column, as bytes."""
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x) for x in column.to_pylist()], pa.binary())


def packed_slices(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose packed texts have at most ``SLICE_BYTES`` unpacked (one row at least)."""
    total = np.zeros(batch.num_rows + 1, dtype=np.int64)
    for c in columns:
        total[1:] += np.cumsum([zstandard.frame_content_size(x) for x in batch.column(c).to_pylist()], dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()
