import json

from pyspark.sql import functions as F

from laborlens.operators import coverage, governance, ingest, persist, validate
from laborlens.sources import readers, seeds, sinks
from laborlens.streaming.ingest import bounded_duplicates, staged_stream, start_ingest

HEADER = ",".join(validate.RAW_COLUMNS)
LINES = [
    'Engineer,Acme,Pune,IT,"Uses ""Java""\nand SQL",2016-05-21 19:30:00 +0000,J1,u1,5,Java',
    "Engineer,Acme,Pune,IT,other,2016-05-22,J1,u2,7,",
    "Clerk,Acme,Mumbai,IT,text,yesterday,J2,u3,1,Excel",
    ",Acme,Mumbai,IT,text,2016-05-21,J3,u4,-2,Excel",
    "Painter,,,,,,,,,",
]


def raw_rows(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text(HEADER + "\n" + "\n".join(LINES) + "\n", encoding="utf-8")
    df = readers.raw_postings_csv(spark, str(path), multiline=True)
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def test_historical_rows(spark, tmp_path):
    raw = raw_rows(spark, tmp_path)
    assert raw.count() == 5
    normalized = validate.normalize_raw_rows(raw, "hist", F.current_timestamp())
    profile = validate.adapter_profile(normalized).first()
    assert (profile["input_rows"], profile["normalized_rows"], profile["rejected_rows"],
            profile["duplicate_identity_count"]) == (5, 3, 2, 1)
    tally = {r["reason"]: r["n"] for r in validate.reason_tally(normalized).collect()}
    assert tally == {"Malformed postdate: yesterday": 1, "Missing job title": 1,
                     "Malformed numberofpositions: -2": 1}
    accepted = normalized.where("accepted")
    none_stored = accepted.select("record_identity_hash").where("false")
    facts = persist.postings_to_insert(accepted, none_stored, status_override="EXPIRED")
    by_title = {r["job_title"]: r for r in facts.collect()}
    # first row's fields, last non-empty skills and seats
    assert str(by_title["Engineer"]["posted_date"]) == "2016-05-21"
    assert by_title["Engineer"]["source_skills"] == "Java" and by_title["Engineer"]["seats"] == 7
    assert by_title["Painter"]["status"] == "EXPIRED"
    accounts = persist.ingest_accounting(normalized, none_stored).first()
    assert (accounts["inserted_rows"], accounts["skipped_rows"], accounts["reconciled"]) == (
        2, 1, True)
    second = persist.ingest_accounting(normalized, accepted.select("record_identity_hash")).first()
    assert (second["inserted_rows"], second["skipped_rows"], second["reconciled"]) == (0, 3, True)


def test_snapshot_json(spark, tmp_path):
    record = {"source_record_id": "1", "job_title": "Clerk", "employer_name": "Acme",
              "sector": "IT", "experience_years": "2-4 years",
              "salary": "₹6,00,000 - ₹9,00,000 PA", "posted_date": "soon"}
    for name, kind in (("a", "UNVERIFIED_OR_SYNTHETIC"), ("b", "OFFICIAL")):
        (tmp_path / f"{name}.json").write_text(json.dumps({
            "classification": kind, "source_id": "snap", "records": [record, {"job_title": "x"}]}))
    records = readers.posting_snapshot_json(spark, str(tmp_path)).withColumn(
        "ordinal", F.monotonically_increasing_id())
    staged = ingest.staged_snapshot(records)
    good = staged.where("is_valid").first()
    assert (good["district"], good["experience_years_max"], float(good["salary_max"])) == (
        "Pune", 4, 900000)
    assert good["posted_day"] is None and good["posted_date_malformed"]
    bad = staged.where("NOT is_valid").first()
    assert bad["validation_errors"] == (
        "Missing source_record_id; Missing employer_name; Missing sector")
    jobs = ingest.jobs_from_staging(staged, staged.where("false"), "ordinal")
    counts = ingest.snapshot_counts(staged, jobs).first()
    assert tuple(counts) == (2, 2, 1, 1)


def test_institutes(spark, tmp_path):
    trade = {"trade_name": "Machinist", "intake": "20"}
    (tmp_path / "i.json").write_text(json.dumps({"source_id": "s", "institutes": [
        {"institute_name": "A", "institute_code": "1", "trades": [trade, trade]},
        {"institute_name": "B", "district": "Nashik", "trades": [trade]}]}))
    table = ingest.institutes(readers.institute_snapshot_json(spark, str(tmp_path)))
    assert {r["institute_name"]: r["is_valid"] for r in table.collect()} == {"A": True, "B": False}
    trades = ingest.institute_trades(table)
    assert trades.count() == 2 and trades.select("trade_identity_hash").distinct().count() == 2


class Feed:
    source_id = "open"

    def read(self, spark):
        raise NotImplementedError

    def normalize(self, raw):
        return raw

    def errors(self):
        return ingest.default_errors()


def policies(spark):
    return spark.createDataFrame(
        [("open", True, "AUTHORIZED_API", "ALLOWED", True, False),
         ("off", False, "AUTHORIZED_API", "ALLOWED", True, False),
         ("unknown", True, "UNKNOWN", "ALLOWED", True, False),
         ("robots", True, "LICENSED_DATA", "DISALLOWED", True, True),
         ("closed", True, "LICENSED_DATA", "ALLOWED", False, False)],
        "source_id string, enabled boolean, authorization_status string, robots_status string, "
        "api_available boolean, crawl_allowed boolean")


def test_gate(spark):
    actions = {r["source_id"]: r["action"]
               for r in governance.with_eligibility(policies(spark)).collect()}
    assert actions == {"open": "PROCEED", "off": "HALT", "unknown": "REJECT",
                       "robots": "RESPECT_ROBOTS", "closed": "DENIED"}


def test_governed_batch(spark):
    raw = spark.createDataFrame(
        [(1, "Clerk", "Pune"), (2, "Clerk", "Pune"), (3, "", "Pune"), (4, "Maid", "Thane")],
        "n int, job_title string, location_text string")
    out = ingest.governed_records(raw, Feed(), policies(spark), "n")
    assert {r["n"]: r["disposition"] for r in out.collect()} == {
        1: "STAGED", 2: "DUPLICATE", 3: "INVALID", 4: "STAGED"}


def test_stream_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_title string, location_text string, seen timestamp"

    def drop(*titles):
        spark.createDataFrame([(t, "Pune", None) for t in titles], schema).withColumn(
            "seen", F.lit("2026-01-01 00:00:00").cast("timestamp")
        ).write.mode("append").json(source)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).json(source)
        staged = bounded_duplicates(
            staged_stream(stream, Feed(), policies(spark)), F.col("seen"), "1 hour")
        start_ingest(staged, target, str(tmp_path / checkpoint)).awaitTermination()
        return spark.read.parquet(target).count()

    drop("Clerk", "Clerk", "Maid", "")
    assert run("c1") == 2
    drop("Clerk", "Painter")
    assert run("c1") == 3
    assert run("c2") == 3  # a fresh checkpoint replays everything and adds nothing


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "Java dev", None, "SQL", "Pune", "IT", "s")],
        "posting_id string, job_title string, description string, source_skills string, "
        "district string, sector string, source_id string",
    ).withColumn("retrieved_at", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    from laborlens.operators.skills import SkillDictionary

    export = sinks.skill_evidence_export(rows, SkillDictionary.build())
    sinks.write_csv(export, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert len(back.columns) == 11 and back.count() == 2
    assert {r["observation_period"] for r in back.collect()} == {"2026-01-02"}


def test_builtin_ontology_is_clean(spark):
    skills = coverage.ontology_errors(
        seeds.skills_df(spark), seeds.trade_skills_df(spark), "skill_id", "Skill")
    jobs = coverage.ontology_errors(
        seeds.occupations_df(spark), seeds.trade_occupations_df(spark), "occupation_id",
        "Occupation", "occupation_name")
    assert skills.count() == 0 and jobs.count() == 0
