"""The views as Spark joins them: the rows of their SQL, and no text in an exchange but at the end."""

import duckdb
import pytest

from laborlens.plans import views

PARTS = [
    (1, "small widget", "Brand#1", "STANDARD", 1), (2, "new anvil", "Brand#20", "PROMO", 9),
    (3, "odd widget", "Brand#7", "OTHER", -3), (4, "red", "x", "SMALL", None), (5, None, None, None, 70_000),
    (6, "cold gizmo", "", "LARGE", 41), (7, " gear", "Brand#9", "MEDIUM", 0),
]


@pytest.fixture()
def odd(spark, tmp_path):
    tables = {
        "part": (PARTS, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"),
        "customer": ([(1, "C1", 3, "BUILDING"), (2, "C2", None, None)],
                     "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": ([(10, 1, "1-URGENT", "1996-01-31 10:00:00"), (11, 2, None, None)],
                   "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderdate string"),
        "lineitem": ([(10 + p[0] % 2, p[0], 5, p[0], 2.5, "R", "O", "1996-02-0%d 23:30:00" % p[0]) for p in PARTS],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                     "l_quantity double, l_returnflag string, l_linestatus string, l_shipdate string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        for c in ("o_orderdate", "l_shipdate"):
            if c in df.columns:
                df = df.withColumn(c, df[c].cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return tmp_path


def test_rows_of_odd_parts(spark, odd):
    con = duckdb.connect()
    for t in ("part", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(views.VIEWS["raw_rows"]).fetchall()))
    got = sorted(repr(tuple(r)) for r in views.view(spark, str(odd), "raw_rows").collect())
    assert got == want
    assert len(want) == len(PARTS)


def test_texts_come_after_the_last_join(spark, odd):
    for name in ("raw_rows", "titles"):
        plan = views.view(spark, str(odd), name)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Join Inner", 1)
        assert "Technician" in above and "Technician" not in below  # before, on the side of the parts
        assert "Hinjewadi" not in below and "part_code" in below
