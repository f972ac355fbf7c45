"""Whitening of embeddings by shifted CholeskyQR.

Components become integers, x = floor(scale * c) + offset, so that sums are exact.  Passes over the
centred rows give Gram matrices: the first is shifted, so that its Cholesky factor exists whatever
the condition, and later passes orthogonalise what a triangular solve by the factors so far leaves,
until the Gram matrix is the identity.  The product of the factors is R of the centred rows; its
singular vectors are the components and its squared singular values, over n, their variances.  Only
Gram matrices and sums leave the tasks: their size is that of the width, at most MOST_WIDTH squared.

Null and empty vectors and those with null or non-finite components are dropped.  Vectors of
different widths are whitened apart, each width by its own rows.  Repeated rows count as often as
they are there; a null id is kept.  Directions without variance have no component, so a table whose
rows are all equal gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .vectors import PARTS, added, as_parts, keyed, matrices

MOST_WIDTH = 2048
MOST_PASSES = 8
LEAST_SPREAD = 1e-11  # of the largest singular value; what is less is rounding
EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Centre:
    """Exact sums of the integer rows of one width."""

    n: int
    sums: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        return self.n * x - self.sums


@dataclass(frozen=True)
class Whitening:
    """The fitted transformation for vectors of one width."""

    centre: Centre
    components: np.ndarray  # one row each, by falling variance
    variances: np.ndarray
    total_variance: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.deviations(x) / self.centre.n) @ self.components.T / np.sqrt(self.variances)


@dataclass(frozen=True)
class Scale:
    scale: int = 64
    offset: int = 1_000_000

    def integers(self, x: np.ndarray) -> np.ndarray:
        if x.size and max(-x.min(), x.max()) * self.scale >= 2.0**31:
            raise ValueError("a component times the scale is 2**31 or more")
        return np.floor(self.scale * x).astype(np.int64) + self.offset


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x times the inverse of the upper triangular r, by substitution column by column."""
    q = np.empty(x.shape, order="F")
    for j in range(r.shape[1]):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def factor(gram: np.ndarray, rows: int, whole: bool) -> np.ndarray:
    """Upper Cholesky factor; shifted by the rounding error of the Gram matrix if not `whole`."""
    d = len(gram)
    size = float(np.linalg.norm(gram, 2))
    shift = 11.0 * (rows * d + d * (d + 1)) * EPS * size
    shift = min(shift, 1e-6 * size)  # beyond some 10**8 rows the bound is looser than need be
    if whole:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def _sums(rows: DataFrame, tasks: int, scale: Scale) -> dict[int, Centre]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch, "vector"):
                width = x.shape[1]
                if width > MOST_WIDTH:
                    raise ValueError(f"vectors of {width} components, more than {MOST_WIDTH}")
                one = np.append(scale.integers(x).sum(axis=0), len(x))
                sums[width] = sums[width] + one if width in sums else one
        yield as_parts(sums)

    return {width: Centre(int(total[-1]), total[:-1])
            for width, total in added(rows.mapInArrow(run, PARTS), tasks, np.int64).items()}


def _gram(rows: DataFrame, tasks: int, scale: Scale, of) -> dict[int, np.ndarray]:
    """Gram matrices of `of[width](integer rows)` by width; `of` has no other width's entry."""
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch, "vector"):
                width = x.shape[1]
                if width in sent.value:
                    y = sent.value[width](scale.integers(x))
                    one = (y.T @ y).ravel()
                    sums[width] = sums[width] + one if width in sums else one
        yield as_parts(sums)

    found = added(rows.mapInArrow(run, PARTS), tasks, np.float64)
    return {width: g.reshape(int(len(g) ** 0.5), -1) for width, g in found.items()}


@dataclass(frozen=True)
class _Orthogonal:
    """Centred rows after the triangular solves so far."""

    centre: Centre
    factors: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = self.centre.deviations(x) / self.centre.n
        for r in self.factors:
            y = solved(y, r)
        return y


@dataclass(frozen=True)
class _Projected:
    """Whitened rows and a column of ones, so that their Gram matrix has their sums as well."""

    model: Whitening

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.model.project(x), np.ones(len(x))])


def fit(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding",
        scale: Scale = Scale()) -> dict[int, Whitening]:
    """The whitening of every width, from all usable vectors."""
    rows = keyed(vectors, key, vector)
    tasks = vectors.rdd.getNumPartitions()
    work = {width: _Orthogonal(centre, []) for width, centre in _sums(rows, tasks, scale).items()}
    model = {}
    totals: dict[int, float] = {}
    for turn in range(MOST_PASSES):
        if not work:
            break
        left = {}
        for width, gram in _gram(rows, tasks, scale, work).items():
            at = work[width]
            if turn == 0:
                totals[width] = float(np.trace(gram)) / at.centre.n
            if not gram.any():
                continue  # all rows are equal
            far = float(np.abs(gram - np.eye(width)).max())
            if (turn and far <= 1e-12 * width) or turn == MOST_PASSES - 1:
                model[width] = _finished(at, totals[width], components)
            else:
                # From the first pass on what is left is near orthonormal, but where directions lack.
                r = factor(gram, at.centre.n, whole=turn > 0)
                left[width] = _Orthogonal(at.centre, [*at.factors, r])
        work = left
    return {width: m for width, m in model.items() if len(m.variances)}


def _finished(at: _Orthogonal, total: float, most: int) -> Whitening:
    r = np.eye(len(at.centre.sums))
    for one in at.factors:
        r = one @ r
    _, spread, directions = np.linalg.svd(r)
    real = int((spread > LEAST_SPREAD * spread[0]).sum())
    k = min(most, real)
    return Whitening(at.centre, directions[:k], spread[:k] ** 2 / at.centre.n, total)


def identity_errors(vectors: DataFrame, model: dict[int, Whitening], key: str = "vec_id",
                    vector: str = "embedding", scale: Scale = Scale()) -> dict[int, float]:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity, by width."""
    rows = keyed(vectors, key, vector)
    found = _gram(rows, vectors.rdd.getNumPartitions(), scale,
                  {width: _Projected(one) for width, one in model.items()})
    out = {}
    for width, gram in found.items():
        n = gram[-1, -1]
        mean = gram[-1, :-1] / n
        covariance = gram[:-1, :-1] / n - np.outer(mean, mean)
        out[width] = float(np.abs(covariance - np.eye(len(mean))).max())
    return out


def _squares(deviations: np.ndarray) -> pa.Array:
    """Exact sums of squares; null beyond 63 bits."""
    most = int(np.abs(deviations).max()) if deviations.size else 0
    if most**2 * deviations.shape[1] < 1 << 63:
        return pa.array((deviations**2).sum(axis=1))
    exact = [sum(v * v for v in row) for row in deviations.tolist()]
    return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


def transform(vectors: DataFrame, model: dict[int, Whitening], key: str = "vec_id",
              vector: str = "embedding", scale: Scale = Scale()) -> DataFrame:
    """Per usable row and component: key, component (from 1), n, deviation, whitened, explained.

    `deviation` is the exact sum of (n * x - sums)**2, null where it does not fit into a long.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, c in matrices(batch, "vector"):
                one = sent.value.get(c.shape[1])
                if one is None:
                    continue
                x = scale.integers(c)
                k = len(one.variances)
                again = np.repeat(np.arange(len(row)), k)
                squares = _squares(one.centre.deviations(x))
                explained = one.variances / one.total_variance
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(row[again])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(row))),
                    pa.array(np.full(len(again), one.centre.n)), squares.take(pa.array(again)),
                    pa.array(one.project(x).ravel()), pa.array(np.tile(explained, len(row))),
                    pa.array(np.full(len(again), c.shape[1], np.int32)),
                ], names=["key", "component", "n", "deviation", "whitened", "explained", "width"])

    return keyed(vectors, key, vector).mapInArrow(
        run, f"key {kind}, component int, n bigint, deviation bigint, whitened double,"
             " explained double, width int").withColumnRenamed("key", key)
