"""Dense vectors of a fixed size as rows of chunks, merged in two levels so that no task sees the vectors of all tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a chunk.
CHUNK = 8192
SCHEMA = "salt int, chunk int, part binary"


def chunks(vector: np.ndarray, fan: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a task's vector that are not all zero, as rows (salt, chunk, part); salt is the task's branch of the tree, one of fan."""
    salt = TaskContext.get().partitionId() % fan
    for at in range(0, len(vector), CHUNK * 64):
        wide = vector[at : at + CHUNK * 64]
        parts = [(at // CHUNK + i // CHUNK, wide[i : i + CHUNK]) for i in range(0, len(wide), CHUNK)]
        parts = [(c, p) for c, p in parts if p.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([salt] * len(parts), pa.int32()), pa.array([c for c, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], names=["salt", "chunk", "part"])


def branches(df: DataFrame) -> int:
    """How many branches the tree over df's tasks has: the square root of their number."""
    return max(1, math.isqrt(df.rdd.getNumPartitions()))


def merge(parts: DataFrame, dtype: str, how: np.ufunc) -> DataFrame:
    """The elementwise merge of all vectors: by chunk and branch, then by chunk."""

    def on(table: pa.Table) -> pa.Table:
        rows = table.column("part").to_pylist()
        total = np.frombuffer(rows[0], dtype).copy()
        for r in rows[1:]:
            how(total, np.frombuffer(r, dtype), out=total)
        return pa.table({"salt": pa.array([0], pa.int32()), "chunk": table.column("chunk").slice(0, 1).cast(pa.int32()).combine_chunks(), "part": pa.array([total.tobytes()], pa.binary())})

    first = parts.groupBy("chunk", "salt").applyInArrow(on, SCHEMA)
    return first.groupBy("chunk").applyInArrow(on, SCHEMA).select("chunk", "part")


def gather(merged: DataFrame, size: int, dtype: str) -> np.ndarray:
    """The merged vector at the driver; its size must be bounded."""
    out = np.zeros(size, dtype)
    for r in merged.select("chunk", "part").toLocalIterator():
        part = np.frombuffer(r["part"], dtype)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
    return out


def add(parts: DataFrame, size: int, dtype: str = "<i8") -> np.ndarray:
    return gather(merge(parts, dtype, np.add), size, dtype)


def bits(keys: DataFrame, column: str, size: int) -> np.ndarray:
    """A bit for each of size (a power of two) buckets: set where the leading bits of a key in the column, a long, fall."""
    shift = np.uint64(64 - (size.bit_length() - 1))
    fan = branches(keys)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for batch in batches:
            own[(batch.column(0).to_numpy().view(np.uint64) >> shift).astype(np.int64)] = True
        yield from chunks(np.packbits(own), fan)

    return gather(merge(keys.select(F.col(column)).mapInArrow(on, SCHEMA), "u1", np.bitwise_or), size // 8, "u1")


def has(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bucket of each key (uint64) is set."""
    shift = np.uint64(64 - (8 * len(packed)).bit_length() + 1)
    at = (keys >> shift).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
