"""The queries of the operators against DuckDB, where SQL can express them."""

import duckdb
import pytest

from laborlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_license_scan"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    place = {c[0]: k for k, c in enumerate(result.description)}
    wanted = sorted(repr([r[place[c]] for c in columns]) for r in result.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == wanted


def test_whitening_query_keeps_its_contract(spark):
    rows = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(rows) == 32 * vectors and {r["component"] for r in rows} == set(range(1, 33))
    assert max(r["identity_error"] for r in rows) < 1e-9 and {r["n"] for r in rows} == {vectors}
    first = {r["component"]: r["explained"] for r in rows}
    assert sorted(first.values(), reverse=True) == [first[k] for k in range(1, 33)]
