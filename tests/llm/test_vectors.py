"""Top-k search and vector near-duplicates against brute force; components and ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.llm import bitsliced, common, pq

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("id", "v", "n", "rep", "block", "score", "list"):
        df = df.withColumn(name, F.lit("x"))
    return df


def sample_rows(n=400, width=12, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, width))
    rows = []
    for k in range(n):
        x = base[k % len(base)] + rng.normal(size=width) * rng.choice([0, 0.01, 0.15, 0.4])
        rows.append((k, (x / np.linalg.norm(x)).astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1100, rows[3][1], None),
             (1200, None, 1), (1201, [], 1), (1202, [0.0] * width, 1), (1203, [NAN] + [1.0] * (width - 1), 1),
             (1204, [INF] + [1.0] * (width - 1), 1), (1205, [None] + [1.0] * (width - 1), 1),
             (1300, [1.0, 2.0], 1), (1301, [2.0, 4.0], 1), (1400, [-x for x in rows[0][1]], rows[0][2]),
             (None, rows[0][1], rows[0][2]), (5, rows[5][1], rows[5][2])]
    return rows


def fine(x):
    return x and all(v is not None and np.isfinite(v) for v in x)


def test_top_k_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 150)
    monkeypatch.setattr(bitsliced, "QUERY_ROWS", 3)
    rows = sample_rows()
    got = bitsliced.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    usable = [(i, [int(np.floor(1024.0 * np.float64(np.float32(v)))) for v in x])
              for i, x, _ in rows if i is not None and fine(x)]
    wanted = {}
    for i, q in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable
                        if j != i and len(v) == len(q))[:10]
        wanted.update({(i, r + 1): (j, -s) for r, (s, j) in enumerate(scored)})
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == wanted
    assert len(got) == len(wanted)


def test_top_k_ties_and_small_tables(spark):
    rows = [(100, [1.0, 0.0], 0), (7, [0.5, 0.0], 0), (3, [0.5, 9.0], 0), (5, [0.5, -1.0], 0), (200, [0.0, 0.0], 0)]
    got = bitsliced.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=2).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got)] == [
        (100, 1, 3), (100, 2, 5), (200, 1, 3), (200, 2, 5)]
    assert bitsliced.top_k(vectors(spark, []), F.lit(True)).count() == 0
    assert bitsliced.top_k(vectors(spark, [(100, [1.0], 0)]), F.lit(True)).count() == 0
    with pytest.raises(Exception, match="2\\*\\*26"):
        bitsliced.top_k(vectors(spark, [(1, [1e9], 0), (2, [1e9], 0)]), F.lit(True)).collect()


def test_bitmap_sums_are_inner_products():
    rng = np.random.default_rng(3)
    values = rng.integers(-1000, 1000, (130, 9))
    values[:, 4] = 7  # a component without any slice
    index = bitsliced.Slices(np.arange(130), values)
    for query in (rng.integers(-500, 500, 9), np.zeros(9, np.int64), np.full(9, -1)):
        rows, score = index.top(query.astype(np.int64), -1, 130)
        assert sorted(rows.tolist()) == list(range(130))
        assert (score == values[rows] @ query).all()


def brute_links(rows, least=0.93):
    nodes = [(i, np.array(x, np.float32).astype(float), c) for i, x, c in rows
             if i is not None and c is not None and fine(x) and any(x)]
    links = {}
    for a, (i, x, c) in enumerate(nodes):
        for j, y, d in nodes[:a]:
            if c == d and i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
    return links


def component_of(ids, links):
    out = {}
    for i in sorted(ids):
        if i in out:
            continue
        todo = [i]
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = i
                todo += links.get(at, ())
    return out


@pytest.mark.parametrize("sample", [8192, 16])
def test_product_quantised_links_like_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(pq, "BLOCK_ROWS", 40)
    rows = [r for r in sample_rows(seed=sample) if r[0] != 5] + [(5, [1.0] * 12, 1)]
    got = pq.near_duplicates(vectors(spark, rows), sample=sample).collect()
    assert len(got) == len(rows)
    links = brute_links(rows)
    wanted = component_of({i for i, _, _ in rows if i is not None}, links)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, None)
            continue
        assert r["n_links"] == len(links.get(r["vec_id"], ())), r
        assert r["component_id"] == wanted[r["vec_id"]]
        assert r["kept"] == (r["component_id"] == r["vec_id"])
    assert sum(map(len, links.values())) > 200  # the fixture has links to find


def test_copies_are_counted_without_pairs(spark):
    rows = [(k, [0.6, 0.8], 1) for k in range(300)] + [(k, [0.6, 0.81], 1) for k in range(300, 320)]
    got = pq.near_duplicates(vectors(spark, [*rows, rows[0]])).collect()
    assert len(got) == 321 and {r["n_links"] for r in got} == {319} and {r["component_id"] for r in got} == {0}
    assert pq.near_duplicates(vectors(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200 + k) for k in range(50)]
    edges += [(300 + rng.randrange(80), 300 + rng.randrange(80)) for _ in range(60)]
    edges += [(7, None), (None, None), (1, 2), (2, 1)]
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    links = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    assert {r["node"]: r["component"] for r in got} == component_of(links, links)
    assert len(got) == len(links)
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_gapless_rank(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("k"))
    got = common.gapless_rank(df, ["g"], ["k"], "r", buckets=7).collect()
    for g in range(3):
        ranks = [r["r"] for r in got if r["g"] == g]
        assert sorted(ranks) == list(range(len(ranks)))


def test_blocks_of_rows_are_small_and_sent_few_times(spark):
    assert bitsliced._query_blocks(6_150, 10) == 13  # not 49, one per 128 queries
    assert bitsliced._query_blocks(513, 1) == 5 and bitsliced._query_blocks(0, 1) == 1
    assert bitsliced._query_blocks(1_000_000, 1_000) == 245
    rows = spark.createDataFrame([(k, [k - 50, 32767]) for k in range(100)] + [(100, [1, 2, -32769])], "id long, v array<long>")
    found = {r["width"]: r for r in bitsliced._packed(rows, 1).collect()}
    assert (found[2]["itemsize"], len(found[2]["v"])) == (2, 100 * 2 * 2)
    assert (found[3]["itemsize"], len(found[3]["v"])) == (4, 3 * 4)
