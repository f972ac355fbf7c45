"""Shapes of plans that matter at scale."""

from pyspark.sql import functions as F

from laborlens.operators import gap, geography, occupation, persist, skills
from laborlens.operators.scope import observation_scope


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, rows=300):
    """A third of all rows share one identity, one source and one title."""
    hot = F.col("id") % 3 == 0
    df = spark.range(rows).select(
        F.col("id").cast("string").alias("posting_id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("record_identity_hash"),
        F.when(hot, "big").otherwise("small").alias("source_id"),
        F.when(hot, "Java Developer").otherwise("Computer Operator").alias("job_title"),
        F.lit("SQL and Excel").alias("description"), F.lit("Java").alias("source_skills"),
        F.lit("Pune").alias("district"), F.lit("IT").alias("sector"),
        F.lit("2026-01-01").cast("timestamp").alias("retrieved_at"), F.col("id").alias("ordinal"),
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # show scans in full
    path = str(tmp_path / "postings")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_extraction_needs_no_exchange_and_prunes_columns(spark, tmp_path):
    df = stored(spark, tmp_path)
    d = skills.SkillDictionary.build()
    text = plan(skills.evidence_rows(skills.extract_skills(df, d)))
    assert "Exchange" not in text and "Join" not in text and "EvalPython" not in text
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "district" not in schema and "sector" not in schema


def test_skill_counts_shuffle_once(spark, tmp_path):
    df = stored(spark, tmp_path)
    counts = skills.count_by_skill(
        skills.extract_skills(df, skills.SkillDictionary.build(), snippets=False))
    assert plan(counts).count("Exchange hashpartitioning") == 1
    got = {r["skill_id"]: r["distinct_job_count"] for r in counts.collect()}
    assert got["SKL-DEV-JAVA-01"] == 300 and got["SKL-DB-SQL-01"] == 300


def test_scope_filters_reach_the_scan(spark, tmp_path):
    df = stored(spark, tmp_path)
    text = plan(observation_scope(df, "big", start="2026-01-01", end="2026-01-31"))
    assert "EqualTo(source_id,big)" in text and "LessThan(retrieved_at" in text


def test_first_per_key_is_pruned_before_the_shuffle(spark, tmp_path):
    df = stored(spark, tmp_path)
    first = persist.first_per_key(df)
    assert plan(first).count("WindowGroupLimit") == 2
    assert first.count() == 201
    assert first.where("record_identity_hash = 'hot'").first()["ordinal"] == 0


def test_row_local_resolvers(spark, tmp_path):
    df = stored(spark, tmp_path)
    for out in (occupation.with_occupation(df, "job_title"),
                geography.with_city_location(df, "district"),
                geography.with_district_location(df, "district")):
        assert "Exchange" not in plan(out) and "Join" not in plan(out)


def test_hot_source_keeps_all_rows(spark, tmp_path):
    df = stored(spark, tmp_path)
    table = gap.skill_demand(df, skills.SkillDictionary.build(), source_id="big")
    assert {r["total_jobs"] for r in table.collect()} == {100}
