"""What collision queries write and exchange: packed identities, rows once, no wide row twice."""

from pyspark.sql import functions as F

from laborlens.functions.identity import packed, unpacked
from laborlens.operators import collisions, ingest, persist, validate
from laborlens.session import written_once


def raw(spark):
    rows = [(f"id{k % 4}" if k % 2 else f"{k % 4:064x}", f"j{k}", f"Title {k % 3}") for k in range(12)]
    known = spark.createDataFrame(rows, "record_identity_hash string, jobid string, jobtitle string")
    return known.select("*", *[F.lit(c).alias(c) for c in validate.RAW_COLUMNS if c not in known.columns])


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_identities_are_packed(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "", "é", "g" * 64, "a" * 63, None, "\x00" * 33]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", packed(F.col("t")).alias("p")).select("t", "p", unpacked(F.col("p")).alias("back"))
    rows = df.collect()
    assert [r["back"] for r in rows] == [r["t"] for r in rows]
    assert len(rows[0]["p"]) == 32 and len({bytes(r["p"]) for r in rows if r["p"] is not None}) == 8


def test_policy_groups_its_rows_once(spark):
    rows = raw(spark)
    got = collisions.collision_policy_of_rows(rows)
    assert exchanges(got) == 1  # before: one for the totals, one for the groups
    totals = rows.agg(F.count("*").alias("total_input_rows"),
                      F.countDistinct("record_identity_hash").alias("unique_identities"))
    want = collisions.collision_policy(collisions.collision_groups(rows), totals)
    assert got.columns == want.columns and got.collect() == want.collect()


def test_report_is_groups_with_values(spark):
    rows = raw(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = collisions.collision_report(rows)
        assert exchanges(report) <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    groups = collisions.collision_groups(rows)
    want = groups.join(collisions.collision_values(rows, groups), "identity_hash", "left")
    assert report.columns == want.columns
    assert sorted(map(repr, report.collect())) == sorted(map(repr, want.collect()))
    assert {r["reason"] for r in report.collect()} == {"Multiple variations: 3 titles"}


def test_rows_are_written_as_columns(spark):
    rows = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    back = written_once(rows.repartition(3))
    assert back.schema == rows.schema or back.dtypes == rows.dtypes
    assert back.inputFiles()[0].endswith(".zstd.parquet") and back.exceptAll(rows).count() == 0


def test_classes_are_the_groups_without_their_counts(spark):
    rows = raw(spark)
    classes = collisions.collision_classes(rows)
    assert exchanges(classes) == 1  # before: the rows once more, for counts that nothing reads
    groups = collisions.collision_groups(rows).select(*classes.columns)
    assert sorted(map(repr, classes.collect())) == sorted(map(repr, groups.collect()))


def test_prefixes_of_several_identities(spark):
    hashes = ["a" * 16 + "b" * 48, "a" * 16 + "c" * 48, "d" * 64]
    postings = spark.createDataFrame([(h, h[20:30]) for h in hashes * 2], "record_identity_hash string, posting_id string")
    groups = spark.createDataFrame([("a" * 16, "X"), ("e" * 16, "X"), ("d" * 16, " Y ")], "identity string, classification string")
    got = sorted(tuple(r) for r in persist.resolve_prefixes(groups, postings).collect())
    assert got == sorted([("b" * 10, "X", hashes[0], True), ("c" * 10, "X", hashes[1], True), ("d" * 10, "Y", hashes[2], False)])


def test_historical_ingest_counts_written_rows(spark):
    """Accounting and relationships do not touch what only the facts need."""
    rows = spark.createDataFrame([(True, "h1"), (True, "h1"), (False, None)], "accepted boolean, record_identity_hash string")
    whole = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in (
        "source_id", "source_record_id", "job_title", "employer_name", "location_text", "district", "state",
        "sector", "description", "posted_date", "retrieved_at", "status", "skills", "seats", "location")],
        F.raise_error(F.lit("not read")).cast("bigint").alias("ordinal"))
    groups = spark.createDataFrame([("h1", "X")], "identity_hash string, classification string")
    run = ingest.historical_ingest(whole, rows.where("false"), groups, counted=rows)
    assert run.accounting.first()["inserted_rows"] == 1 and run.relationships.count() == 1
