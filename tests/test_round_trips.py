"""Files written and read again, and the order of ordered results."""

import json

import pytest
from pyspark.sql import functions as F

from laborlens.functions import parse
from laborlens.operators import demand, gap, governance, persist, search
from laborlens.operators.skills import SkillDictionary, evidence_rows, extract_skills
from laborlens.sources import readers, seeds, sinks


def write(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_own_ontology_file_feeds_extraction(spark, tmp_path):
    path = write(tmp_path / "skills.json", {"skills": [
        {"skill_id": "S1", "canonical_skill_name": "Welding", "aliases": ["mig welding"],
         "skill_category": "trade", "verification_status": "VERIFIED", "version": "1"},
        {"skill_id": "S2", "canonical_skill_name": "Cobol", "aliases": None,
         "skill_category": "it"}]})
    ontology = readers.ontology_json(spark, path, "skills")
    dictionary = SkillDictionary.from_df(ontology)
    assert [s.skill_id for s in dictionary.skills] == ["S1", "S2"]
    postings = spark.createDataFrame(
        [("p1", "MIG welding job", "some cobol", "Cobol, Welding")],
        "posting_id string, job_title string, description string, source_skills string")
    found = evidence_rows(extract_skills(postings, dictionary)).collect()
    assert {(r["canonical_skill_id"], r["evidence_type"]) for r in found} == {
        ("S1", "JOB_TITLE"), ("S2", "JOB_DESCRIPTION"), ("S1", "SOURCE_SKILL"), ("S2", "SOURCE_SKILL")}
    with pytest.raises(ValueError):
        SkillDictionary.from_df(ontology, most=1)


def test_trade_mapping_and_occupations(spark, tmp_path):
    path = write(tmp_path / "map.json", {"mappings": [
        {"canonical_trade_name": "Machinist", "skill_id": "S1", "mapping_status": "NEEDS_REVIEW",
         "evidence_source": "x"}]})
    row = readers.trade_mapping_json(spark, path, "skill_id").first()
    assert (row["trade"], row["skill_id"]) == ("Machinist", "S1")
    path = write(tmp_path / "occ.json", {"occupations": [
        {"occupation_id": "O1", "canonical_occupation_name": "Cook", "aliases": ["chef"], "sector": "Food"}]})
    row = readers.ontology_json(spark, path, "occupations").first()
    assert (row["occupation_id"], row["aliases"], row["seed_order"]) == ("O1", ["chef"], 0)


def test_reference_occupations(spark, tmp_path):
    (tmp_path / "nco.csv").write_text(
        "nco_code,occupation_title,division,group_name,source_reference,authoritative\n"
        '1111, Cook ,5,"Cooks, all",ref,TRUE\n2222,,5,g,r,false\n')
    rows = readers.reference_occupations_csv(spark, str(tmp_path / "nco.csv")).collect()
    assert [(r["nco_code"], r["occupation_title"], r["group_name"], r["is_authoritative"]) for r in rows] == [
        ("1111", "Cook", "Cooks, all", True)]


def test_profiling_read_and_plain_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("jobtitle,company\nEngineer,NA\nnull,Acme\n")
    columns = ("jobtitle", "company")
    blank = readers.raw_postings_csv(spark, str(tmp_path / "a.csv"), columns, blank_na=True).collect()
    assert [tuple(r) for r in blank] == [("Engineer", None), (None, "Acme")]
    plain = readers.raw_postings_csv(spark, str(tmp_path / "a.csv"), columns)
    assert [tuple(r) for r in plain.collect()] == [("Engineer", "NA"), ("null", "Acme")]


def test_exports_round_trip(spark, tmp_path):
    groups = spark.createDataFrame(
        [("abc", 2, "UNCERTAIN", 'He said "x", twice')],
        "identity string, collision_size int, classification string, reason string")
    for c in ("jobids", "uniq_ids", "job_titles", "companies", "locations", "post_dates", "confidence"):
        groups = groups.withColumn(c, F.lit(None).cast("string"))
    groups = groups.select("identity", "collision_size", "classification", "jobids", "uniq_ids",
                           "job_titles", "companies", "locations", "post_dates", "reason", "confidence")
    sinks.write_csv(groups, str(tmp_path / "g"))
    row = readers.collision_groups_csv(spark, str(tmp_path / "g")).first()
    assert (row["collision_size"], row["reason"]) == ("2", 'He said "x", twice')
    metrics = spark.createDataFrame([(3, 0.5)], "jobs_processed long, share double")
    sinks.write_json(metrics, str(tmp_path / "m"))
    back = readers.metrics_json(spark, str(tmp_path / "m"), "jobs_processed long, share double").first()
    assert tuple(back) == (3, 0.5)
    sinks.write_csv(sinks.export(seeds.skills_df(spark), "skills"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == len(seeds.SKILLS)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN|jobs|KeyError|skill_id"):
        sinks.export(metrics, "skills").collect()


def test_long_numbers_are_read_or_flagged(spark):
    row = spark.createDataFrame(
        [("₹12345678901.125 - ₹20000000000 PA", "99999999999 - 2 years", "9" * 40)],
        "s string, e string, huge string").select(
        parse.salary_first_two(F.col("s")).alias("a"), parse.salary_range(F.col("s")).alias("b"),
        parse.experience_first_two(F.col("e")).alias("c"),
        parse.oversized_salary(F.col("s")).alias("fits"),
        parse.oversized_salary(F.col("huge")).alias("d"),
        parse.oversized_experience(F.col("huge")).alias("f")).first()
    assert (float(row.a.low), float(row.a.high)) == (12345678901.125, 20000000000)
    assert float(row.b.high) == 20000000000
    assert (row.c.low, row.c.high) == (99999999999, 2)
    assert (row.fits, row.d, row.f) == (False, True, True)


def test_ambiguous_prefixes_are_rows(spark):
    facts = spark.createDataFrame(
        [("a" * 16 + "1" * 48, "p1"), ("a" * 16 + "2" * 48, "p2"), ("b" * 64, "p3")],
        "record_identity_hash string, posting_id string")
    groups = spark.createDataFrame(
        [("a" * 16, "a" * 16 + "1" * 48, "UNCERTAIN"), ("b" * 16, "b" * 64, "REPOSTING")],
        "identity string, identity_hash string, classification string")
    got = {(r["member_record_id"], r["ambiguous"]) for r in persist.resolve_prefixes(groups, facts).collect()}
    assert got == {("p1", True), ("p2", True), ("p3", False)}
    exact = persist.resolve_relationships(groups, facts).collect()
    assert {r["member_record_id"] for r in exact} == {"p1", "p3"}


def gap_rows(spark):
    rows = [("S3", "Java", "LOW_GAP", 5), ("S1", "SQL", "HIGH_GAP", 9), ("S2", "Perl", "HIGH_GAP", 50),
            ("S0", "Go", "NO_DATA", 0), ("S4", "C", "HIGH_GAP", 9)]
    return spark.createDataFrame(rows, "skill_id string, skill_name string, gap_status string, "
                                       "demand_distinct_job_count long").withColumns({
        "demand_normalized_distinct_job_count": F.lit(0.25), "has_supply_evidence": F.lit(False),
        "supply_trade_count": F.lit(0).cast("long"), "verification_status": F.lit("NEEDS_REVIEW")})


def test_recommendations_keep_their_order(spark):
    got = gap.recommendations(gap_rows(spark), limit=4, supplier="Two schools", institutes=2,
                              directory="Thane").collect()
    assert [r["skill_id"] for r in got][:3] == ["S2", "S1", "S4"]
    assert "Two schools (2 institutes); Thane-wide" in got[0]["reason"]
    assert gap.recommendations(gap_rows(spark)).count() == 5


def test_other_orders(spark):
    demand_rows = spark.createDataFrame(
        [("Pune", 3, 1), ("Thane", 9, 0), ("Nashik", 3, 0), ("Pune", 6, 0)],
        "district string, job_count long, apprenticeship_count long")
    got = demand.top_districts(demand_rows, 2).collect()
    assert [(r["district"], r["job_count"]) for r in got] == [("Pune", 9), ("Thane", 9)]
    skills = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)],
                                   "skill_id string, normalized_distinct_job_count double")
    assert [r["skill_id"] for r in gap.top_skills(skills, 3).collect()] == ["c", "a", "b"]
    assert [r["skill_id"] for r in gap.filter_gap(gap_rows(spark), "HIGH_GAP", "sq").collect()] == ["S1"]
    postings = spark.createDataFrame(
        [("p2", "Clerk", "2024-01-02"), ("p1", "Clerk", "2024-01-02"), ("p3", "Cook", "2024-01-03")],
        "posting_id string, job_title string, retrieved_at string").withColumns({
        "retrieved_at": F.col("retrieved_at").cast("timestamp"), "source_id": F.lit("s"),
        "district": F.lit("Pune"), "sector": F.lit("IT")})
    page = search.page_of_postings(postings, limit=2, offset=0).collect()
    assert [r["posting_id"] for r in page] == ["p3", "p1"]
    assert search.page_total(postings, "clerk").first()["total"] == 2


def test_registering_sources_twice_adds_nothing(spark):
    sources = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B")], "source_id string, source_name string")
    first = governance.sources_to_register(sources, sources.limit(0))
    assert first.count() == 2 and governance.sources_to_register(sources, first).count() == 0


def test_rows_of_many_files_are_numbered_in_order(spark, tmp_path):
    folder, told = tmp_path / "rows", []
    folder.mkdir()
    for name, rows in (("b.csv", 700), ("a.csv", 3), ("c.csv", 0), ("d.csv", 250)):
        lines = [f"{name}-{k},{'x' * (k % 40)}" for k in range(rows)]
        (folder / name).write_text("\n".join(["jobtitle,company", *lines]) + "\n", encoding="utf-8")
    for name in ("a.csv", "b.csv", "d.csv"):
        told += [line.split(",")[0] for line in (folder / name).read_text().splitlines()[1:]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        read = readers.raw_postings_csv(spark, str(folder), ("jobtitle", "company"))
        numbered = readers.with_ordinal(read)
        assert read.rdd.getNumPartitions() > 5 and numbered.columns == ["jobtitle", "company", "ordinal"]
        got = {r["ordinal"]: r["jobtitle"] for r in numbered.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[k] for k in range(len(got))] == told
