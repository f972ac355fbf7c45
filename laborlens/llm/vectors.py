"""Arrow helpers of the vector operators: usable vectors as matrices, and sums of task results."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import gather

MOST_ENTRIES = 1 << 19  # components that a task works on at a time
LAST_TASKS = 8  # partial sums that the driver adds up


def matrices(batch: pa.RecordBatch, column: str, width: int | None = None,
             ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors as doubles), one width at a time and in bounded parts.

    Null and empty vectors and those with null or non-finite components are passed over, and with
    `width` those of any other width.
    """
    lists = batch.column(column)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    places = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(places)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])[places]
    fine = (np.diff(bad) == 0) & (sizes > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    for one in np.unique(sizes[fine]).tolist():
        if width is not None and one != width:
            continue
        rows = np.flatnonzero(fine & (sizes == one))
        step = max(1, MOST_ENTRIES // one)
        for k in range(0, len(rows), step):
            part = rows[k:k + step]
            yield part, flat[gather(places[part], sizes[part])].reshape(-1, one)


def keyed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """The two columns that tasks need, under fixed names; other columns are not read."""
    return vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def added(parts: DataFrame, tasks: int, dtype) -> dict[int, np.ndarray]:
    """Sums of the arrays `part` (binary) by `width`, of rows that `tasks` tasks have made.

    Added in tasks first, in two steps, so that neither a task nor the driver meets a number of
    arrays that grows with the data by more than its square root.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, part in zip(batch.column("width").to_pylist(), batch.column("part")):
                one = np.frombuffer(part.as_buffer(), dtype)
                sums[width] = sums[width] + one if width in sums else one.copy()
        yield as_parts(sums)

    for fan in (isqrt(tasks), LAST_TASKS):
        if fan < tasks and fan > 1:
            parts = parts.repartition(fan).mapInArrow(run, PARTS)
            tasks = fan
    sums: dict[int, np.ndarray] = {}
    for batch in parts.toArrow().to_batches():
        for width, part in zip(batch.column("width").to_pylist(), batch.column("part")):
            one = np.frombuffer(part.as_buffer(), dtype)
            sums[width] = sums[width] + one if width in sums else one.copy()
    return sums


PARTS = "width int, part binary"


def as_parts(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
        names=["width", "part"])
