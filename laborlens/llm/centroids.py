"""Clustering of integer vectors by scalar lookup tables.

Vectors become integers, floor(scale * component).  They are dealt into blocks once: a block keeps,
for each dimension, the integer values that occur in it and every vector's value as a place in that
list.  In a round, a table of squared differences is made for each dimension of a block: one row
per occurring value, one entry per centroid.  A vector's distances are sums of gathered table rows;
no subtraction is made per vector.  Tasks return sums and counts per centroid, all exact integers,
so the result does not depend on how rows are dealt.

Vectors of another width than the one asked for, null ones and those with null or non-finite
components are left out.  Repeated rows count as often as they are there; a null id is clustered
but never a first centroid, so without any id there are no rows.  With fewer vectors than centroids there are fewer centroids; an empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage
from .vectors import PARTS, added, as_parts, keyed, matrices

BLOCK_ROWS = 4096
MOST_VALUE = 1 << 26  # so that squared distances of 1,024 components fit into 63 bits
MOST_WIDTH = 1024


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    values = np.floor(scale * x)
    if values.size and np.abs(values).max() > MOST_VALUE:
        raise ValueError("a component times the scale is more than 2**26")
    return values.astype(np.int64)


def blocks(vectors: DataFrame, width: int, scale: int, key: str, vector: str) -> DataFrame:
    """(keys, values, counts, places): blocks of coded vectors, as bytes but for the keys.

    `values` are the occurring integers, dimension after dimension, `counts` how many each has, and
    `places` the rank of every vector's value, all vectors of a dimension next to each other.
    """
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in matrices(batch, "vector", width):
                for k in range(0, len(row), BLOCK_ROWS):
                    part = _integers(x[k:k + BLOCK_ROWS], scale)
                    places = np.empty((width, len(part)), np.uint16)
                    values, counts = [], np.empty(width, np.int32)
                    for d in range(width):
                        found, places[d] = np.unique(part[:, d], return_inverse=True)
                        values.append(found)
                        counts[d] = len(found)
                    keys = batch.column("key").take(pa.array(row[k:k + BLOCK_ROWS]))
                    yield pa.RecordBatch.from_arrays([
                        pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), keys),
                        *[pa.array([a.tobytes()], pa.binary())
                          for a in (np.concatenate(values), counts, places)],
                    ], names=["keys", "values", "counts", "places"])

    return keyed(vectors, key, vector).mapInArrow(
        run, f"keys array<{kind}>, values binary, counts binary, places binary")


class Block:
    """One row of `blocks`."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        of = lambda name, dtype: np.frombuffer(batch.column(name)[row].as_buffer(), dtype)
        self.ends = np.cumsum(of("counts", np.int32))
        self.values = of("values", np.int64)
        self.places = of("places", np.uint16).reshape(len(self.ends), -1)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance to it); ties go to the smaller number."""
        total = np.zeros((self.places.shape[1], len(centroids)), np.int64)
        start = 0
        for d, end in enumerate(self.ends.tolist()):
            table = (self.values[start:end, None] - centroids[None, :, d]) ** 2
            total += table[self.places[d]]
            start = end
        number = total.argmin(axis=1)
        return number, total[np.arange(len(total)), number]

    def sums(self, number: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of the vectors of each centroid."""
        out = np.empty((k, len(self.ends)), np.int64)
        start = 0
        for d, end in enumerate(self.ends.tolist()):
            # Occurrences of each (centroid, value), then values times occurrences.
            size = end - start
            seen = np.bincount(number * size + self.places[d], minlength=k * size).reshape(k, size)
            out[:, d] = seen @ self.values[start:end]
            start = end
        return out


def _round(coded: DataFrame, tasks: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, distances and componentwise sums of each centroid)."""
    k, width = centroids.shape
    sent = coded.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 2), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                number, distance = block.nearest(sent.value)
                total[:, 0] += np.bincount(number, minlength=k)
                np.add.at(total[:, 1], number, distance)
                total[:, 2:] += block.sums(number, k)
        yield as_parts({width: total.ravel()})

    found = added(coded.select("values", "counts", "places").mapInArrow(run, PARTS), tasks, np.int64)
    total = found[width].reshape(k, -1)
    return total[:, 0], total[:, 1], total[:, 2:]


def first_centroids(vectors: DataFrame, k: int, seed: int, width: int, scale: int, key: str,
                    vector: str) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:key`, in the order of the hashes."""
    usable = F.size("vector") == width
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    rows = (keyed(vectors, key, vector).where(F.col("key").isNotNull() & usable & fine)
            .select(digest.alias("digest"), "vector")
            .orderBy("digest", "vector").limit(k).collect())
    return _integers(np.array([r["vector"] for r in rows], float).reshape(-1, width), scale)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64,
            scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    if not 0 < width <= MOST_WIDTH:
        raise ValueError(f"{width} components: between 1 and {MOST_WIDTH} are possible")
    kind = dict(vectors.dtypes)[key]
    spark = vectors.sparkSession
    result = (f"key {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint,"
              " centroid_sha256 string")
    centroids = first_centroids(vectors, k, seed, width, scale, key, vector)
    if not len(centroids):
        return spark.createDataFrame([], result).withColumnRenamed("key", key)
    tasks = vectors.rdd.getNumPartitions()
    coded = cut_lineage(blocks(vectors, width, scale, key, vector))
    for _ in range(rounds):
        counts, _, sums = _round(coded, tasks, centroids)
        moved = centroids.copy()
        some = counts > 0
        moved[some] = sums[some] // counts[some, None]
        if (moved == centroids).all():
            break  # further rounds would change nothing
        centroids = moved
    _, inertia, _ = _round(coded, tasks, centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sent = spark.sparkContext.broadcast((centroids, inertia, digests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final, spread, names = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                number, distance = Block(batch, row).nearest(final)
                yield pa.RecordBatch.from_arrays([
                    batch.column("keys").slice(row, 1).flatten(), pa.array(number.astype(np.int32)),
                    pa.array(distance), pa.array(spread[number]),
                    pa.array(np.full(len(number), spread.sum())),
                    pa.DictionaryArray.from_arrays(pa.array(number), pa.array(names)).cast(pa.string()),
                ], names=["key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return coded.mapInArrow(run, result).withColumnRenamed("key", key)
