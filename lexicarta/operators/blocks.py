"""Feature rows as matrices, and sums over all of them.

A block is a run of rows held as one matrix: dense, or the three arrays of a
compressed sparse one.  Blocks are built once, kept in memory and disk, and
read by every pass over the data.  A pass gives each task the current
parameters (a broadcast variable, not a column of the plan), adds up one array
per task, and merges these arrays as a tree of bounded fan-in, so the driver
receives at most ``FAN_IN`` arrays and no row is made per feature value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values in one block (8 MB of doubles); a longer row is a block of its own.
BLOCK_VALUES = 1 << 20
#: Arrays that one task of the merge tree adds up.
FAN_IN = 16

_BLOCK = "part int, n bigint, width bigint, dense boolean, offsets binary, indices binary, data binary, y binary"


@dataclass
class Block:
    """``n`` rows with targets ``y``; sparse unless ``matrix`` is given."""

    y: np.ndarray
    matrix: np.ndarray | None = None
    rows: np.ndarray | None = None
    indices: np.ndarray | None = None
    data: np.ndarray | None = None

    def times(self, w: np.ndarray) -> np.ndarray:
        """X w for a vector or a matrix of columns."""
        if self.matrix is not None:
            return self.matrix @ w[: self.matrix.shape[1]] if w.shape[0] >= self.matrix.shape[1] else self.matrix[:, : w.shape[0]] @ w
        if w.ndim == 2:
            return np.stack([self.times(c) for c in w.T], 1)
        inside = self.indices < len(w)
        return np.bincount(self.rows[inside], self.data[inside] * w[self.indices[inside]], len(self.y))

    def transposed_times(self, r: np.ndarray, d: int) -> np.ndarray:
        """The first ``d`` rows of X' r for a vector or a matrix of columns."""
        if self.matrix is not None:
            out = np.zeros((d, *r.shape[1:]))
            out[: self.matrix.shape[1]] = (self.matrix.T @ r)[:d]
            return out
        if r.ndim == 2:
            return np.stack([self.transposed_times(c, d) for c in r.T], 1)
        inside = self.indices < d
        return np.bincount(self.indices[inside], self.data[inside] * r[self.rows[inside]], d)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(lengths, values) of a list column; a null list is empty."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def build(df: DataFrame, label: str, indices: str | None = "indices", values: str = "values") -> DataFrame:
    """Blocks of ``df``, persisted: sparse rows of two array columns, or with
    ``indices=None`` dense rows of one.  Rows without a label take no part,
    null values count as zero, null arrays as rows of zeros."""
    sparse = indices is not None
    columns = [F.col(label).cast("double").alias("y"), F.col(values).cast("array<double>").alias("values")]
    if sparse:
        columns.append(F.col(indices).cast("array<bigint>").alias("indices"))

    def work(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            lengths, data = _lists(batch.column(1))
            data = data.fill_null(0.0).to_numpy(zero_copy_only=False)
            index = _lists(batch.column(2))[1].to_numpy(zero_copy_only=False) if sparse else None
            ends = np.cumsum(lengths)
            lo = 0
            while lo < len(y):
                start = int(ends[lo] - lengths[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, start + BLOCK_VALUES, "right")))
                yield _packed(part, y[lo:hi], lengths[lo:hi], data[start: int(ends[hi - 1])],
                              None if index is None else index[start: int(ends[hi - 1])])
                lo = hi

    return df.select(*columns).where(F.col("y").isNotNull()).mapInArrow(work, _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


def _packed(part, y, lengths, data, index) -> pa.RecordBatch:
    dense = index is None and len(lengths) > 0 and bool((lengths == lengths[0]).all())
    if index is None and not dense:  # rows of different length
        index = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    width = int(lengths[0]) if dense else int(index.max(initial=-1)) + 1
    arrays = [np.ascontiguousarray(x, t).tobytes() for x, t in ((lengths, np.int64), (index if index is not None else [], np.int64),
                                                               (data, np.float64), (y, np.float64))]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([width], pa.int64()), pa.array([dense]),
         *[pa.array([a], pa.binary()) for a in arrays]], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(batches) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            lengths, indices, data, y = (np.frombuffer(batch.column(c)[k].as_buffer(), t)
                                         for c, t in zip(range(4, 8), (np.int64, np.int64, np.float64, np.float64)))
            if batch.column(3)[k].as_py():
                yield Block(y, matrix=data.reshape(len(y), -1))
            else:
                yield Block(y, rows=np.repeat(np.arange(len(y)), lengths), indices=indices, data=data)


@dataclass
class Shape:
    n: int
    width: int
    parts: int


def shape(blocks: DataFrame) -> Shape:
    """Rows, features and tasks of the blocks."""
    s = blocks.agg(F.sum("n").alias("n"), F.max("width").alias("width"), F.max("part").alias("part")).first()
    return Shape(int(s["n"] or 0), int(s["width"] or 0), int(s["part"]) + 1 if s["part"] is not None else 0)


def total(blocks: DataFrame, terms: Callable[[Block, object], np.ndarray], parameters: object, parts: int) -> np.ndarray:
    """The sum of ``terms(block, parameters)`` over all blocks.  Arrays are
    added in the order of tasks, so equal inputs give equal sums."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast(parameters)

    def task(batches):
        out = None
        for block in _blocks(batches):
            found = terms(block, shared.value)
            out = found if out is None else out + found
        if out is not None:
            yield _sums([TaskContext.get().partitionId()], [out])

    def merge(batches):
        at, out = None, None
        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(blob.as_buffer(), np.float64)
                if to != at and at is not None:
                    yield _sums([at], [out])
                out = found if to != at else out + found
                at = to
        if at is not None:
            yield _sums([at], [out])

    level = blocks.mapInArrow(task, "part int, sums binary")
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        dealt = level.select(F.floor(F.col("part") / FAN_IN).cast("int").alias("to"), "sums", "part").repartition(parts, "to")
        level = dealt.sortWithinPartitions("to", "part").select("to", "sums").mapInArrow(merge, "part int, sums binary")
    try:
        rows = sorted((r["part"], bytes(r["sums"])) for r in level.collect())  # at most FAN_IN arrays
    finally:
        shared.unpersist()
    out = np.frombuffer(rows[0][1], np.float64).copy()
    for _, blob in rows[1:]:
        out += np.frombuffer(blob, np.float64)
    return out


def _sums(parts: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["part", "sums"])
