import datetime
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from laborlens.functions import parse
from laborlens.functions.simhash import simhash64
from laborlens.operators import collisions, dedup, demand, geography, occupation
from laborlens.sources import seeds
from laborlens.sources.readers import reference_occupations


def one(spark, fn, value):
    df = spark.createDataFrame([(value,)], "v string")
    out = df.select(fn(F.col("v")).alias("x")).first()["x"]
    return tuple(out) if hasattr(out, "asDict") else out


def test_occupation_cases(spark):
    cases = {
        "Cosmetologist": "OCC-BEAUTY-01", "Basic Cosmetology": "OCC-BEAUTY-01",
        "Computer Operator": "OCC-COMP-01", "Computer Programming Assistant": "OCC-COMP-01",
        "Motor Vehicle Mechanic": "OCC-AUTO-01", "Automotive Mechanic": "OCC-AUTO-01",
        "Garment Technician": "OCC-FASHION-01",
        "ICT System Maintenance Technician": "OCC-ICT-01", "Painter General": "OCC-PAINT-01",
        **dict.fromkeys((
            "Lathe Machine Operator", "Machine Learning Engineer", "Graphic Designer",
            "Interior Designer", "UI UX Designer", "System Administrator",
            "Building Maintenance Technician", "Computer Science Intern", "Generic Operator",
            "Generic Technician")),
    }
    df = spark.createDataFrame([(t,) for t in cases] + [("  ",), (None,)], "t string")
    out = {r["t"]: r["occupation"] for r in occupation.with_occupation(df, "t").collect()}
    assert {t: out[t]["occupation_id"] for t in cases} == cases
    assert out[None]["status"] == "UNMAPPED" and out[None]["matched_text"] is None
    # a filter on the result is pushed below the resolver and still works
    hits = occupation.with_occupation(df, "t").where("occupation.occupation_id = 'OCC-AUTO-01'")
    assert hits.count() == 2


@pytest.mark.parametrize("text, level, share", [
    ("Pune", "EXACT_SINGLE", "EXCLUSIVE"), ("Pune, Maharashtra", "EXACT_SINGLE", "EXCLUSIVE"),
    ("Pimpri-Chinchwad", "EXACT_SINGLE", "EXCLUSIVE"),
    ("Pune / Mumbai", "MULTI_EXPLICIT", "SHARED"),
    ("Bengaluru/Bangalore , Mumbai , Chennai , Pune , Hyderabad / Secunderabad , "
     "Delhi/NCR(National Capital Region)", "MULTI_EXPLICIT", "SHARED"),
    ("PUNE Mumbai, Chennai Kolkata, Bangalore Hyderabad", "CITY_MENTION", "MENTIONED"),
    ("", "UNKNOWN", "UNKNOWN"), ("Atlantis", "UNKNOWN", "UNKNOWN"),
])
def test_city_locations(spark, text, level, share):
    df = spark.createDataFrame([(text,)], "t string")
    out = geography.with_city_location(df, "t").first()["location"]
    assert (out["location_evidence_level"], out["pune_exclusivity"]) == (level, share)
    assert out["has_pune_evidence"] == (share != "UNKNOWN")


def test_locality_option(spark):
    df = spark.createDataFrame([("Campbell",)], "t string")
    loose = geography.with_city_location(df, "t").first()["location"]
    tight = geography.with_city_location(df, "t", whole_word_localities=True).first()["location"]
    assert (loose["district"], tight["district"]) == ("Pune", None)


@pytest.mark.parametrize("text, district, level", [
    ("Pune", "Pune", "EXACT_SINGLE"), ("Maharashtra", None, "AMBIGUOUS"),
    ("Chhatrapati Sambhajinagar", "Aurangabad", "CITY_MENTION"),
    ("Andheri, Maharashtra", "Mumbai Suburban", "CITY_MENTION"),
    ("Pune and Nashik", None, "MULTI_EXPLICIT"), ("Bangalore", None, "UNKNOWN"),
    ("", None, "UNKNOWN"), ("Punekar", None, "UNKNOWN"),
])
def test_district_locations(spark, text, district, level):
    df = spark.createDataFrame([(text,)], "t string")
    out = geography.with_district_location(df, "t").first()["location"]
    assert (out["district"], out["location_evidence_level"]) == (district, level)


def test_divisions(spark):
    from laborlens.sources.gazetteer import districts_df

    table = {r["division"]: r["district_count"]
             for r in geography.districts_by_division(districts_df(spark)).collect()}
    assert sum(table.values()) == 36 and table["Konkan"] == 7 and table["Pune"] == 5


D = datetime.date


@pytest.mark.parametrize("fn, value, want", [
    (parse.posting_date, "2016-05-21 23:30:00 -0800", (D(2016, 5, 21), False)),
    (parse.posting_date, "2016-05-21", (D(2016, 5, 21), False)),
    (parse.posting_date, "2016-02-30", (None, True)), (parse.posting_date, " ", (None, False)),
    (parse.posting_date, "21/05/2016", (None, True)),
    (parse.posting_date, "2016-05-21 24:00:00", (None, True)),
    (parse.seats, "5.9", (5, False)), (parse.seats, "-1", (None, True)),
    (parse.seats, "nan", (None, True)), (parse.seats, "inf", (None, True)),
    (parse.seats, None, (None, False)), (parse.seats, "1e400", (None, True)),
    (parse.experience_first_two, "2-4 years", (2, 4)),
    (parse.experience_first_two, "Freshers", (None, None)),
    (parse.experience_range, "5+ years", (5, None)), (parse.experience_range, "3 yrs", (3, 3)),
    (parse.experience_range, "2 – 4 years", (2, 4)), (parse.experience_range, "any", (None, None)),
    (parse.flexible_date, "31/01/2016", D(2016, 1, 31)),
    (parse.flexible_date, "31-02-2016", None), (parse.flexible_date, "2016/1/5", D(2016, 1, 5)),
    (parse.iso_date, "soon", (None, True)),
])
def test_parsers(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_salary(spark):
    text = "₹6,00,000 - ₹9,00,000 PA"
    assert [float(x) for x in one(spark, parse.salary_first_two, text)] == [600000, 900000]
    low, high, currency = one(spark, parse.salary_range, "7 or 3 or 5")
    assert (float(low), float(high), currency) == (3, 7, "INR")
    assert one(spark, parse.salary_range, "") == (None, None, None)


def plain_simhash(text):
    words = re.findall("[a-z0-9]+", text.lower())
    grams = ["|".join(words[i:i + 3]) for i in range(max(len(words) - 2, 0))]
    if len(words) < 3:
        grams = ["|".join(words)]
    hashes = [int(hashlib.md5(g.encode()).hexdigest()[:16], 16) for g in grams]
    value = sum(1 << b for b in range(64)
                if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_simhash(spark):
    rng = random.Random(3)
    texts = ["!!!", "one", "one two", "É x ÿ"] + [
        " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(n)) for n in range(1, 60)]
    texts.append(" ".join(str(i % 977) for i in range(70_000)))  # beyond one counting chunk
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(simhash64(F.col("t"))).collect()]
    assert got == [plain_simhash(t) for t in texts]
    assert one(spark, simhash64, "") == 0 and one(spark, simhash64, None) == 0


@pytest.mark.parametrize("blocks, crowded", [(4, 4096), (6, 4096), (6, 3)])
def test_near_matches_are_exact(spark, blocks, crowded):
    rng = random.Random(11)
    values = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            v = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.append(v)
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(zip(signed, range(len(signed)))),
                               "fingerprint long, ordinal long")
    got = {r["fingerprint"]: r["matched_ordinal"]
           for r in dedup.earliest_near(df, 3, blocks, crowded).collect()}
    want = {}
    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 3:
            want[signed[j]] = min(want.get(signed[j], i), i)
    assert got == want and want


def test_duplicate_status(spark):
    data = [
        ("r0", "Software Engineer role in Pune for backend work", 0, None),
        ("r1", "software engineer role in pune for backend work ", 1, None),
        ("r2", "Software Engineer  role in Pune for backend work", 2, "r0"),
        ("r3", "Something else entirely, a painter of large cars", 3, None),
        ("r4", "", 4, None), ("r5", "", 5, None),
    ]
    df = spark.createDataFrame(data, "id string, title string, n long, token string")
    prints = dedup.fingerprints(df, "id", "n", ["title"])
    want = {"r0": "DISTINCT", "r1": "EXACT_MATCH", "r2": "NEAR_DUPLICATE", "r3": "DISTINCT",
            "r4": "DISTINCT", "r5": "EXACT_MATCH"}
    for shuffled in (prints, prints.orderBy(F.desc("ordinal"))):
        got = {r["record_id"]: r["status"] for r in dedup.duplicate_status(shuffled).collect()}
        assert got == want
    tokens = df.select(F.col("id").alias("record_id"), "token")
    reposts = dedup.duplicate_status(prints.join(tokens, "record_id"), posting_token="token")
    assert {r["record_id"]: r["status"] for r in reposts.collect()}["r2"] == "REPOST"


P, M = "Pune", "Mumbai"
DAY, LATER = "2016-05-21 19:30:00 +0000", "2016-06-15 10:00:00 +0000"


@pytest.mark.parametrize("a, b, want", [
    (("J1", "SE", "T", P, DAY), ("J1", "SE", "T", P, DAY), ("TRUE_DUPLICATE", "HIGH")),
    (("J1", "SE", "T", P, DAY), ("J2", " se ", "t", P, DAY), ("TRUE_DUPLICATE", "MEDIUM")),
    (("J1", "SE", "T", P, DAY), ("J1", "SE", "T", M, DAY), ("MULTI_LOCATION_POSTING", "HIGH")),
    (("J1", "SE", "T", P, DAY), ("J2", "SE", "T", M, DAY), ("MULTI_LOCATION_POSTING", "MEDIUM")),
    (("J1", "SE", "T", P, DAY), ("J2", "SE", "T", P, LATER), ("REPOSTING", "HIGH")),
    (("J1", "SE", "T", P, DAY), ("J2", "DA", "O", M, LATER), ("UNCERTAIN", "LOW")),
    (("J1", "", "", "", ""), ("J2", "", "", "", ""), ("TRUE_DUPLICATE", "MEDIUM")),
])
def test_collision_classes(spark, a, b, want):
    df = spark.createDataFrame(
        [("h", *a), ("h", *b), ("alone", *a)],
        "record_identity_hash string, jobid string, jobtitle string, company string, "
        "joblocation_address string, postdate string",
    ).withColumns({c: F.lit("") for c in ("industry", "jobdescription", "skills",
                                          "numberofpositions", "uniq_id")})
    out = collisions.collision_groups(df).collect()
    assert [(r["classification"], r["confidence"]) for r in out] == [want]
    if want[0] == "UNCERTAIN":
        assert out[0]["reason"] == (
            "Multiple variations: 2 titles, 2 companies, 2 locations, 2 dates")


POSTING = ("posting_id string, source_id string, job_title string, district string, "
           "sector string, retrieved_at timestamp_ntz")


def test_district_demand_and_upsert(spark):
    at = datetime.datetime(2026, 3, 31, 23, 59, 59)
    late = datetime.datetime(2026, 4, 1)
    jobs = spark.createDataFrame([
        ("1", "s", "Computer Operator", "Pune", "IT", at),
        ("2", "s", "Computer Operator", " pune ", "IT", at),
        ("3", "s", "Unknown Person", "Pune", "IT", at), ("4", "s", "Machinist", "Pune", " ", at),
        ("5", "s", "Machinist", None, "IT", at), ("6", "s", "Machinist", "Pune", "IT", late),
    ], POSTING)
    trades = jobs.withColumnRenamed("job_title", "trade_title").where("posting_id = '1'")
    period = ("2026-01-01", "2026-03-31")
    cells = demand.demand_cells(jobs, trades, start=period[0], end=period[1])
    table = demand.district_demand(cells, *period)
    rows = table.collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["occupation_id"], row["job_count"], row["apprenticeship_count"]) == (
        "OCC-COMP-01", 2, 1)
    evidence = row["evidence"]
    assert (evidence["total_job_postings_evaluated"], evidence["unmapped_job_postings"],
            evidence["unknown_district_job_postings"], evidence["unknown_sector_job_postings"]
            ) == (5, 1, 1, 1)
    empty = table.where("false")
    first = demand.upsert(empty, table)
    assert demand.upsert_counts(first).first()["rows_created"] == 1
    again = demand.upsert_counts(demand.upsert(first.drop("upsert_status"), table)).first()
    assert tuple(again) == (0, 0, 1)
    counters = demand.run_counters(cells).first()
    assert (counters["input_observations"], counters["eligible_observations"],
            counters["mapped_observations"], counters["districts"]) == (5, 3, 2, 1)


def test_reference_mapping(spark):
    raw = spark.createDataFrame([
        (0, "5241", "Beautician and related", "Service", "Beauticians", "ref", "true"),
        (1, "7223", "Lathe machine setter-operator", "Metal", "Machinists", "ref", "false"),
        (2, " ", "dropped", "", "", "", "true"),
    ], "entry_order long, nco_code string, occupation_title string, division string, "
       "group_name string, source_reference string, authoritative string")
    reference = reference_occupations(raw)
    assert reference.count() == 2
    asked = spark.createDataFrame([
        ("beautician related", None, None), ("lathe machine operator", None, "OCC-MACH-01"),
        ("astronaut", None, None), ("", None, None)],
        "title string, skills string, canonical_occupation_id string")
    out = {r["title"]: r for r in occupation.map_to_reference(
        asked, reference, seeds.occupations_df(spark)).collect()}
    assert out["beautician related"]["nco_code"] == "5241"
    assert out["beautician related"]["verification_status"] == "VERIFIED"
    assert out["lathe machine operator"]["nco_code"] is None
    assert out["lathe machine operator"]["method"] == "TOKEN_SIMILARITY"
    assert (out["astronaut"]["method"], out["astronaut"]["confidence"]) == ("LOW_CONFIDENCE", 0.0)
    assert out[""]["method"] == "NONE"
    nothing = occupation.crosswalk(reference.where("false"), seeds.occupations_df(spark)).collect()
    assert len(nothing) == 7 and {r["method"] for r in nothing} == {"NO_REFERENCE"}
