"""Clustering and whitening against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.llm import centroids, whitening
from laborlens.llm.vectors import added, as_parts, PARTS

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
CLASHING = ("key", "vector", "component", "n", "width", "part", "cluster", "distance", "keys", "places")


def vectors(spark, rows, schema=VECTORS):
    df = spark.createDataFrame(rows, schema)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


def sample_rows(n=300, width=6, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 0.3).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    return rows + [rows[3], rows[3], (None, rows[4][1], None), (9, None, 1), (10, [], 1),
                   (11, [NAN] + rows[0][1][1:], 1), (12, [INF] + rows[0][1][1:], 1),
                   (13, [None] + rows[0][1][1:], 1)]


def usable(rows, width):
    return [(i, np.array(x, np.float32).astype(float)) for i, x, _ in rows
            if x and len(x) == width and all(v is not None and np.isfinite(v) for v in x)]


# --- clustering by lookup tables


def plain_clusters(rows, k, rounds, width, scale=1024, seed=3):
    kept = [(i, [int(v) for v in np.floor(scale * x)]) for i, x in usable(rows, width)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        middle = [[sum(col) // len(col) for col in zip(*[v for (_, v), a in zip(kept, at) if a == j])]
                  if j in at else c for j, c in enumerate(middle)]
    final = [nearest(v) for _, v in kept]
    spread = [sum(d for d, j in final if j == c) for c in range(len(middle))]
    return sorted((i if i is not None else -1, j, d, spread[j], sum(spread),
                   hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest())
                  for (i, _), (d, j) in zip(kept, final))


@pytest.mark.parametrize("k,rounds,seed", [(8, 10, 1), (5, 2, 2), (1, 1, 3), (400, 3, 4)])
def test_clusters_like_plain_rounds(spark, monkeypatch, k, rounds, seed):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 37)
    rows = sample_rows(seed=seed) + [(900, [1.0, 2.0], 1)]
    got = centroids.cluster(vectors(spark, rows).repartition(5), k=k, rounds=rounds, width=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    found = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect())
    assert found == plain_clusters(rows, k, rounds, 6)


def test_clusters_of_ties_few_rows_and_empty_tables(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [2.0, -2.0], 0), (3, [2.0, -2.0], 0)]
    got = centroids.cluster(vectors(spark, rows), k=8, width=2).collect()
    assert sorted(tuple(r) for r in got) == plain_clusters(rows, 8, 10, 2)
    for none in ([], [(1, None, 0)], [(None, [1.0, 1.0], 0)]):
        assert centroids.cluster(vectors(spark, none), k=2, width=2).count() == 0
    with pytest.raises(Exception, match="2\\*\\*26"):
        centroids.cluster(vectors(spark, [(1, [1e9, 0.0], 0)]), width=2)
    with pytest.raises(ValueError, match="components"):
        centroids.cluster(vectors(spark, rows), width=0)


def test_empty_centroids_stay(spark):
    # All vectors are alike, so that only the first of equal centroids is ever nearest.
    rows = [(k, [0.5, 0.25], 0) for k in range(6)]
    got = centroids.cluster(vectors(spark, rows), k=3, width=2).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}


def test_sums_of_many_tasks(spark):
    def run(batches):
        for batch in batches:
            yield as_parts({2: np.array([batch.num_rows, 1], np.int64)})
            yield as_parts({3: np.array([1], np.int64)})

    parts = spark.range(0, 1000, 1, 90).mapInArrow(run, PARTS)
    sums = added(parts, 90, np.int64)
    assert sums[2].tolist() == [1000, 90] and sums[3].tolist() == [90]


# --- whitening


def whitened(spark, rows, most=32, parts=4):
    df = vectors(spark, rows).repartition(parts)
    model = whitening.fit(df, most)
    return model, whitening.identity_errors(df, model), whitening.transform(df, model).collect()


def plain_whitening(rows, width):
    kept = usable(rows, width)
    x = np.array([np.floor(64 * v) for _, v in kept]) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return kept, n * x - sums, values[order], centred @ directions[:, order]


def test_whitening_like_eigenvectors(spark):
    rows = sample_rows()
    model, errors, got = whitened(spark, rows, most=4)
    kept, deviations, values, projected = plain_whitening(rows, 6)
    assert errors[6] < 1e-10 and set(model) == {6}
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {len(kept)}
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    for k, (i, _) in enumerate(kept):
        for c in range(4):
            r, wanted = by_id[i][c + 1], projected[k, c] / np.sqrt(values[c])
            assert r["deviation"] == int((deviations[k] ** 2).sum())
            assert abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9
            assert abs(abs(r["whitened"]) - abs(wanted)) < 1e-8
            if abs(wanted) > 1e-3:
                signs.setdefault(c, set()).add(np.sign(wanted) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in signs.values())  # the same sign for all rows


def test_whitening_where_directions_lack_variance(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(-50, 50, (2, 200)) / 64
    tiny = rng.permutation(200) < 1
    rows = [(k, [float(a[k]), float(2 * a[k]), 1.0, float(b[k]), float(tiny[k]) / 64], 0) for k in range(200)]
    model, errors, got = whitened(spark, rows)
    assert len(model[5].variances) == 3 and errors[5] < 1e-9  # of five columns one is constant, one twice another
    _, _, values, projected = plain_whitening(rows, 5)
    assert np.allclose(model[5].variances, values[:3], rtol=1e-9)
    assert len(got) == 600


def test_condition_numbers_that_one_factor_cannot_hold():
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(500, 8)))[0]
    x = q @ np.diag(10.0 ** -np.arange(8) * 1e3) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    factors, y = [], x
    for turn in range(6):
        factors.append(whitening.factor(y.T @ y, len(x), whole=turn > 0))
        y = whitening.solved(y, factors[-1])
    assert np.abs(y.T @ y - np.eye(8)).max() < 1e-12
    r = np.eye(8)
    for one in factors:
        r = one @ r
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(x)[1], rtol=1e-6)


def test_whitening_of_few_equal_and_mixed_rows(spark):
    assert whitened(spark, [])[2] == []
    assert whitened(spark, [(1, None, 0), (2, [], 0)])[2] == []
    assert whitened(spark, [(1, [0.5, 1.0], 0)])[2] == []  # one row has no variance
    assert whitened(spark, [(1, [0.5, 1.0], 0), (1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)])[2] == []
    rows = [(1, [0.5, 1.0], 0), (2, [1.5, 1.0], 0), (3, [0.0], 0), (4, [1.0], 0), (5, [7.0, 0.0, 0.0], 0)]
    got = whitened(spark, rows)[2]
    assert {(r["vec_id"], r["width"], r["n"], round(abs(r["whitened"]), 9)) for r in got} == {
        (1, 2, 2, 1.0), (2, 2, 2, 1.0), (3, 1, 2, 1.0), (4, 1, 2, 1.0)}
    with pytest.raises(Exception, match="2\\*\\*31"):
        whitening.fit(vectors(spark, [(1, [1e9], 0), (2, [0.0], 0)]))


def test_squares_beyond_63_bits_are_null():
    big = np.array([[1 << 31, 1 << 31], [1 << 31, 1]], np.int64)
    assert whitening._squares(big).to_pylist() == [None, (1 << 62) + 1]
