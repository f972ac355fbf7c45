"""The fact store: insert, update or skip, and only touched partitions are read and written."""

import os

from pyspark.sql import functions as F

from laborlens.sources.stored import PREFIX, FactStore

FACTS = "record_identity_hash string, title string, n long"


def rows(store, spark):
    return sorted((r["record_identity_hash"], r["title"], r["n"]) for r in store.read(spark).collect())


def outcomes(store, spark, facts):
    got = store.upsert(spark.createDataFrame(facts, FACTS)).collect()
    return sorted((r["record_identity_hash"], r["outcome"]) for r in got)


def test_insert_update_and_skip(spark, tmp_path):
    store = FactStore(str(tmp_path / "facts"), updated=("n",))
    assert store.read(spark) is None
    assert outcomes(store, spark, [("00a", "x", 1), ("01b", None, None), (None, "lost", 1)]) == [
        ("00a", "INSERTED"), ("01b", "INSERTED")]
    assert outcomes(store, spark, [("00a", "changed", 2), ("01b", "y", None), ("0c", "z", 3), ("0c", "z", 3)]) == [
        ("00a", "UPDATED"), ("01b", "SKIPPED"), ("0c", "INSERTED")]
    assert rows(store, spark) == [("00a", "x", 2), ("01b", None, None), ("0c", "z", 3)]
    again = [("00a", "x", 2), ("0c", "z", 3)]
    assert outcomes(store, spark, again) == [("00a", "SKIPPED"), ("0c", "SKIPPED")]
    assert outcomes(store, spark, []) == []
    assert outcomes(store, spark, [("00a", "x", None)]) == [("00a", "UPDATED")]
    assert rows(store, spark)[0] == ("00a", "x", None)


def test_without_updated_columns_the_first_row_stays(spark, tmp_path):
    store = FactStore(str(tmp_path / "facts"))
    outcomes(store, spark, [("ff1", "first", 1)])
    assert outcomes(store, spark, [("ff1", "second", 2), ("ff2", "new", 1)]) == [
        ("ff1", "SKIPPED"), ("ff2", "INSERTED")]
    assert rows(store, spark) == [("ff1", "first", 1), ("ff2", "new", 1)]


def test_only_touched_partitions(spark, tmp_path):
    store = FactStore(str(tmp_path / "facts"), updated=("n",), digits=1)
    many = spark.range(400).select(F.sha2(F.col("id").cast("string"), 256).alias("record_identity_hash"),
                                   F.lit("t").alias("title"), F.lit(0).cast("long").alias("n"))
    store.upsert(many)
    files = lambda: {d: sorted(os.listdir(f"{store.path}/{d}"))
                     for d in os.listdir(store.path) if d.startswith(PREFIX)}
    before = files()
    assert len(before) == 16
    one = many.where("substr(record_identity_hash, 1, 1) = 'a'").limit(1).withColumn("n", F.lit(5).cast("long"))
    assert [r["outcome"] for r in store.upsert(one).collect()] == ["UPDATED"]
    after = files()
    assert {d for d in before if before[d] != after[d]} == {f"{PREFIX}=a"}
    assert store.read(spark).count() == 400 and store.read(spark).agg(F.sum("n")).first()[0] == 5
    plan = store.read(spark, ["a"], many)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{PREFIX}" in plan.replace("isnotnull(", "") and " = a" in plan


def test_a_demand_run_in_one_call(spark, tmp_path):
    from laborlens.operators.demand_run import demand_csv, run_demand
    from laborlens.sources.sinks import DEMAND_COLUMNS

    schema = ("posting_id string, source_id string, job_title string, district string, sector string,"
              " retrieved_at timestamp")
    jobs = spark.createDataFrame(
        [("1", "s", "Computer Operator", "Pune", "IT", None), ("2", "s", "Computer Operator", "pune ", "IT", None),
         ("3", "s", "Nothing known", "", None, None), ("4", "s", "Java Developer", "Thane", "IT", None)],
        schema).withColumn("retrieved_at", F.lit("2026-01-05 00:00:00").cast("timestamp"))
    folder, window = str(tmp_path / "run"), ("2026-01-01", "2026-01-31")
    first = run_demand(jobs.where("posting_id <> '2'"), None, folder, *window, source_id="s").first()
    assert (first["input_observations"], first["rows_updated"], first["rows_skipped"]) == (3, 0, 0)
    assert first["rows_created"] >= 1 and first["runs_created"] >= 1
    second = run_demand(jobs, None, folder, *window, source_id="s").first()
    assert (second["rows_created"], second["rows_updated"], second["runs_created"]) == (0, 1, 0)
    assert second["rows_skipped"] == first["rows_created"] - 1 and second["source_coverage"]["row_count"] == 4
    third = run_demand(jobs, None, folder, *window, source_id="s").first()
    assert (third["rows_created"], third["rows_updated"], third["rows_skipped"]) == (0, 0, first["rows_created"])
    table = demand_csv(spark, folder)
    assert table.columns == list(DEMAND_COLUMNS)
    assert table.where("lower(district) = 'pune'").agg(F.sum("job_count")).first()[0] == 2
