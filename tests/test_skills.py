import random

import pytest
from pyspark.sql import functions as F

from laborlens.operators import demand, gap, skills, velocity
from laborlens.sources.seeds import Skill

COLUMNS = "posting_id string, job_title string, description string, source_skills string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_word_boundaries_and_overlap(spark):
    d = skills.SkillDictionary.build()
    df = spark.createDataFrame(
        [
            ("a", "JavaScript Developer", "ASP.NET and C++ with Core Java", None),
            ("b", "Java EE / J2EE lead", "uses .NET, java\nee", None),
            ("c", None, "", "  "),
        ],
        COLUMNS,
    )
    found = {(r["posting_id"], r["evidence_type"], r["canonical_skill_id"])
             for r in rows(skills.evidence_rows(skills.extract_skills(df, d)))}
    assert found == {
        ("a", "JOB_TITLE", "SKL-DEV-JAVASCRIPT-01"),
        ("a", "JOB_DESCRIPTION", "SKL-DEV-CPP-01"),
        ("a", "JOB_DESCRIPTION", "SKL-DEV-JAVA-01"),
        ("b", "JOB_TITLE", "SKL-DEV-J2EE-01"),
        ("b", "JOB_DESCRIPTION", "SKL-DEV-DOTNET-01"),
        ("b", "JOB_DESCRIPTION", "SKL-DEV-JAVA-01"),
    }


def scan(text, phrases):
    """Longest phrase at each word start, left to right, no overlap."""
    low, at, out = text.lower(), 0, []

    def word(i):
        return 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    while at < len(low):
        fits = [p for p in phrases if low.startswith(p, at) and not word(at - 1)
                and not word(at + len(p))]
        if fits:
            best = max(fits, key=len)
            out.append((at, best))
            at += len(best)
        else:
            at += 1
    return out


def test_extraction_against_a_scan(spark):
    d = skills.SkillDictionary.build()
    rng = random.Random(7)
    pieces = ["Java", "java ee", "J2EE", "SQL", "MySQL", "C++", "c#", ".NET", "ASP", "Excel",
              "ms excel", " ", "  ", ",", "/", "_", "é", "Sap", "ERP", "(ERP)", "x", "\n", "﷐"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(30))
             for _ in range(150)]
    df = spark.createDataFrame([(str(i), None, t, None) for i, t in enumerate(texts)], COLUMNS)
    got = {}
    for r in rows(skills.evidence_rows(skills.extract_skills(df, d))):
        got.setdefault(int(r["posting_id"]), []).append(
            (r["canonical_skill_id"], r["source_skill_text"], r["match_confidence"],
             r["evidence_text"]))
    for i, t in enumerate(texts):
        want, seen = [], set()
        for at, phrase in scan(t, list(d.text)):
            skill, canonical = d.text[phrase]
            if skill.skill_id not in seen:
                seen.add(skill.skill_id)
                context = t[max(at - 40, 0):at + len(phrase) + 40]
                want.append((skill.skill_id, phrase, "HIGH" if canonical else "MEDIUM",
                             " ".join(context.split())))
        assert got.get(i, []) == want, t


def test_segments_equivalences_and_boost(spark):
    d = skills.SkillDictionary.with_common_equivalences()
    df = spark.createDataFrame(
        [("a", "Excel user", None, "excel sheet, Customer Care | MS  office;/ Java")], COLUMNS)
    extracted = skills.extract_skills(df, d, boost=True)
    found = {(r["canonical_skill_id"], r["evidence_type"]): r["match_confidence"]
             for r in rows(skills.evidence_rows(extracted))}
    assert found == {
        ("SKL-OFFICE-EXCEL-01", "SOURCE_SKILL"): "HIGH",  # seen in two fields
        ("SKL-OFFICE-EXCEL-01", "JOB_TITLE"): "HIGH",
        ("SKL-COMP-01", "SOURCE_SKILL"): "MEDIUM",
        ("SKL-DEV-JAVA-01", "SOURCE_SKILL"): "MEDIUM",
    }
    assert [r["raw_text"] for r in rows(skills.unmatched_rows(extracted))] == ["Customer Care"]
    profile = rows(skills.job_profiles(extracted))[0]
    assert (profile["total_mentions"], profile["matched_skills"],
            profile["cross_field_confirmed"]) == (4, 3, 1)


def test_gap_classes_sum_to_skills(spark):
    ontology = tuple(Skill(f"S{i}", n, (), "t") for i, n in enumerate(
        ("common", "medium", "rare", "absent", "taught")))
    d = skills.SkillDictionary.build(ontology)
    data = [(str(i), "common taught" if i < 20 else "medium" if i < 23 else "rare" if i < 24
             else "none", None, None) for i in range(250)]
    df = spark.createDataFrame(data, COLUMNS).withColumns(
        {"source_id": F.lit("s"), "district": F.lit("Pune"), "sector": F.lit("IT")})
    demand = gap.skill_demand(df, d)
    supply = gap.skill_supply(spark.createDataFrame([("T", "S4")], "trade string, skill_id string"))
    table = gap.skill_gap(demand, supply)
    assert {r["skill_name"]: r["gap_status"] for r in rows(table)} == {
        "common": "HIGH_GAP", "medium": "MEDIUM_GAP", "rare": "LOW_GAP", "absent": "NO_DATA",
        "taught": "NEEDS_REVIEW"}
    assert [r["gap_status"] for r in rows(table)] == [
        "HIGH_GAP", "MEDIUM_GAP", "NEEDS_REVIEW", "LOW_GAP", "NO_DATA"]
    assert sum(r["skills"] for r in rows(gap.gap_summary(table))) == 5
    text = {r["skill_name"]: r["recommendation"] for r in rows(gap.recommendations(table))}
    assert text["common"] == "Investigate training supply availability for common"
    assert text["taught"] == "Verify supply data for taught"


def test_demand_of_no_postings(spark):
    d = skills.SkillDictionary.build()
    df = spark.createDataFrame([], COLUMNS + ", source_id string, district string, sector string")
    table = rows(gap.skill_demand(df, d))
    assert len(table) == len(d.skills)
    assert all(r["total_jobs"] == 0 and r["normalized_distinct_job_count"] == 0.0 for r in table)


def test_velocity_labels(spark):
    counts = {"java": (4, 3), "sql": (3, 4), "php": (4, 4), "linux": (2, 9)}
    data = []
    for word, (now, before) in counts.items():
        data += [(f"{word}n{i}", word, "2024-02-10 12:00:00") for i in range(now)]
        data += [(f"{word}b{i}", word, "2024-01-31 23:59:59") for i in range(before)]
    df = spark.createDataFrame(data, "posting_id string, job_title string, t string").withColumns(
        {"retrieved_at": F.to_timestamp("t"), "source_id": F.lit("s"), "district": F.lit("d"),
         "sector": F.lit("x")})
    out = velocity.skill_velocity(
        df, skills.SkillDictionary.build(), ("2024-02-01", "2024-02-29"),
        ("2024-01-01", "2024-01-31"), description=None, source_skills=None)
    assert {r["skill_id"]: r["velocity"] for r in rows(out)} == {
        "SKL-DEV-JAVA-01": "RISING", "SKL-DB-SQL-01": "FALLING", "SKL-DEV-PHP-01": "STABLE",
        "SKL-INFRA-LINUX-01": "INSUFFICIENT_DATA"}


def test_candidates_keep_raw_spellings(spark):
    df = spark.createDataFrame(
        [("a", "Android dev", "ANDROID, android", "Sales, sales"), ("b", None, "android", "Sales")],
        COLUMNS)
    out = {r["candidate_skill"]: r for r in rows(
        skills.discover_candidates(df, skills.SkillDictionary.build()))}
    assert out["android"]["observed_forms"] == "ANDROID, Android, android"
    assert (out["android"]["job_count"], out["android"]["mention_count"]) == (2, 4)
    assert (out["sales"]["job_count"], out["sales"]["mention_count"]) == (2, 0)


def test_tech_pattern_equals_the_plain_alternation():
    import re

    from laborlens.sources.seeds import TECH_TOKENS

    rng = random.Random(5)
    trie = re.compile(skills.tech_token_pattern().replace("(?iU)", "(?i)"))
    flat = re.compile(r"(?i)\b(?:" + "|".join(re.escape(t) for t in TECH_TOKENS) + r")\b")
    pieces = list(TECH_TOKENS) + ["x", ".", " ", "-", "server", "native", "asp", "js", "script"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "."]) for _ in range(6))
        assert trie.findall(text) == flat.findall(text), text


def test_counts_match_each_distinct_text_once(spark):
    from laborlens.operators import gap, texts

    rows = [("java developer", "needs sql", "Java, x")] * 50 + [("java developer", None, "")] * 7 + [(None, "", None)] * 3
    df = spark.createDataFrame(rows, "job_title string, description string, source_skills string")
    d = skills.SkillDictionary.build()
    alone = {tuple(r) for r in skills.count_by_skill(skills.extract_skills(df, d, (), snippets=False)).collect()}
    grouped = texts.distinct_texts(df, texts.TEXT_FIELDS)
    found = skills.extract_skills(grouped, d, (texts.COPIES,), "title", snippets=False)
    assert grouped.count() == 3
    assert {tuple(r) for r in skills.count_by_skill(found, copies=texts.COPIES).collect()} == alone
    java = gap.skill_demand(df, d).where("skill_id = 'SKL-DEV-JAVA-01'").first()
    assert (java["distinct_job_count"], java["mention_count"], java["total_jobs"]) == (57, 107, 60)
    total = skills.corpus_metrics(df, d).first()
    assert (total["jobs_processed"], total["jobs_with_source_skills"], total["jobs_with_description"],
            total["unmatched_mentions"]) == (60, 50, 50, 50)
    for out in (gap.skill_demand(df, d), skills.corpus_metrics(df, d), skills.probe_tokens(df, d)):
        assert "HashAggregate(keys=[job_title" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit,value", [("MOST_TEXTS", 50_000), ("MOST_TEXTS", 2), ("MOST_CHARACTERS", 5)])
def test_repeated_texts_are_matched_once(spark, monkeypatch, limit, value):
    kinds = [("Java", "core java and SQL", "java, odd"), (None, None, None), ("", " ", ","), ("Java", None, None)]
    rows = spark.createDataFrame(
        [(k, *kinds[k % 4]) for k in range(40)],
        "posting_id long, job_title string, description string, source_skills string")
    dictionary = skills.SkillDictionary.with_common_equivalences()
    plain = skills.extract_skills(rows, dictionary, boost=True)
    matched, real = [], skills.extract_skills
    monkeypatch.setattr(skills, "extract_skills", lambda df, *a, **k: matched.append(df.count()) or real(df, *a, **k))
    monkeypatch.setattr(f"laborlens.operators.texts.{limit}", value)
    once = skills.extract_repeated(rows, dictionary, boost=True)
    assert matched == [4 if value > 5 else 40]
    assert once.columns == plain.columns and sorted(map(repr, once.collect())) == sorted(map(repr, plain.collect()))


def test_titles_of_a_district_are_resolved_once(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(["Pune", " Pune", None][k % 3], ["x", ""][k % 2], ["Machinist", "Painter General", None, ""][k % 4], "s")
         for k in range(48)], "district string, sector string, job_title string, source_id string")
    resolved, real = [], demand.with_occupation
    monkeypatch.setattr(demand, "with_occupation", lambda df, *a: resolved.append(df.count()) or real(df, *a))
    cells = demand.demand_cells(rows, None).collect()
    assert resolved == [8] and sum(r["n"] for r in cells) == 48
