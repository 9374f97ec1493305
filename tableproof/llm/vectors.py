"""Sums of long count vectors over a table: each task counts its rows densely, slices meet by key.

A task hands on one row a key and slice, however many rows it read, and the sums are taken as a stream,
so neither a hot key nor the number of tasks makes a group that has to be held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 2048
SLICES = "key string, slice int, counts binary"


def vector_sums(rows: DataFrame, size: int, add: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]],
                max_bytes: int = 256 << 20) -> dict[str, np.ndarray]:
    """``add`` folds a task's batches to one int64 vector of ``size`` a key; the sums of all tasks by key.

    What comes back is keys times ``size`` numbers, whatever the table's size; more than ``max_bytes`` is refused."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, vector in add(batches).items():
            keys, at, parts = [], [], []
            for i in range(0, size, SLICE):
                part = vector[i:i + SLICE]
                if part.any():
                    keys.append(key)
                    at.append(i // SLICE)
                    parts.append(part.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(at, pa.int32()), pa.array(parts, pa.binary())], ["key", "slice", "counts"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                part, k = np.frombuffer(r["counts"], "<i8"), (r["key"], r["slice"])
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in sums], pa.string()), pa.array([s for _, s in sums], pa.int32()),
             pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["key", "slice", "counts"])

    spread = rows.mapInArrow(count, SLICES).repartition("key", "slice").mapInArrow(fold, SLICES)
    out: dict[str, np.ndarray] = {}
    for r in spread.toLocalIterator():
        if r["key"] not in out:
            if (len(out) + 1) * size * 8 > max_bytes:
                raise ValueError(f"more keys than {max_bytes} bytes of model hold")
            out[r["key"]] = np.zeros(size, np.int64)
        part = np.frombuffer(bytes(r["counts"]), "<i8")
        out[r["key"]][r["slice"] * SLICE: r["slice"] * SLICE + len(part)] += part
    return out
