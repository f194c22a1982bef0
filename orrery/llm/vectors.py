"""Rows of vectors as packs of integer components, for the operators on embeddings.

A pack is one row: a few thousand vectors of one length from one partition, as NumPy buffers. Packs are made
without a shuffle, hold any mix of labels and never more than a fixed number of bytes, so no label is a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 4096
BYTES = 4 << 20


def finite(vector: Column) -> Column:
    """True for a vector that is not null and has only finite components (NaN sorts above infinity in Spark)."""
    return vector.isNotNull() & F.forall(vector, lambda x: (x > float("-inf")) & (x < float("inf")))


def components(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, and all their components as floor(scale * x), flat."""
    size = np.diff(column.offsets.to_numpy())
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(raw * scale)
    if len(scaled) and np.abs(scaled).max() >= 2**27:
        raise OverflowError("a component of 2^27 or more after scaling: its scores would not fit into 64 bits")
    return size, scaled.astype(np.int32)


def packs_of(batch: pa.RecordBatch, scale: int, bytes_a_component: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(row numbers in the batch, length of the vectors, their components) of packs of one batch of `vector`s."""
    size, flat = components(batch.column("vector"), scale)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        most = int(max(1, min(ROWS, BYTES // max(1, d * bytes_a_component))))
        for i in range(0, len(rows), most):
            part = rows[i : i + most]
            yield part, int(d), flat[start[part][:, None] + np.arange(d)[None, :]]
