"""Several dictionaries in one pass give what each gives alone."""

import random

from laborlens.operators import skills, tagged
from laborlens.plans.queries import QUERIES
from laborlens.sources.seeds import Skill

POSTINGS = "posting_id string, job_title string, description string, source_skills string"
FIRST = (Skill("A", "b c", ("a",), "x"), Skill("B", "java", ("c#",), "x"), Skill("C", "data", (), "x"))
SECOND = (Skill("A", "a b", ("c",), "x"), Skill("B", "core java", ("a b c d",), "x"),
          Skill("D", "data entry", ("c", ".net"), "x"), Skill("E", "entry data entry", (), "x"))


def test_overlapping_dictionaries(spark):
    rng = random.Random(11)
    words = ["a", "b", "c", "d", "core", "Java", "data", "ENTRY", "c#", ".net", "asp.net", "x"]
    rows = []
    for k in range(200):
        text = rng.choice([" ", " ", "  ", "/"]).join(rng.choices(words, k=rng.randrange(12)))
        rows.append((str(k), " ".join(rng.choices(words, k=rng.randrange(5))), text,
                     ",".join(rng.choices([*words, "data entry", "core  java", " "], k=3))))
    rows += [("n", None, None, None), ("e", "", "", ""), ("m", "﷐ a b", "a﷐java", "a")]
    postings = spark.createDataFrame(rows, POSTINGS)
    runs = {"first": skills.SkillDictionary.build(FIRST), "second": skills.SkillDictionary.build(SECOND),
            "none": skills.SkillDictionary.build(())}
    counts = tagged.tagged_counts(postings, runs)
    for name, dictionary in runs.items():
        found = {r["skill_id"]: r.asDict() for r in tagged.summary(counts, name, dictionary).collect()}
        if dictionary.text:
            alone = skills.skill_summary(skills.extract_skills(postings, dictionary, snippets=False), dictionary)
            for r in alone.collect():
                assert (found[r["skill_id"]]["distinct_job_count"], found[r["skill_id"]]["mention_count"]) == (
                    r["distinct_job_count"], r["mention_count"]), (name, r)
            wanted = skills.corpus_metrics(postings, dictionary).first().asDict()
            total = tagged.totals(counts, name).first().asDict()
            assert total == {k: wanted[k] for k in total}
        else:
            assert found == {} and tagged.totals(counts, name).first()["jobs_processed"] == len(rows)


def test_heads_end_at_word_boundaries():
    assert tagged._heads("asp.net mvc") == ["asp.net mvc", "asp.net", "asp."[:3]]
    assert tagged._heads("c++") == ["c++", "c+", "c"]


def test_reports_scan_the_postings_once(spark, monkeypatch):
    scans = []
    real = tagged.cut_lineage
    monkeypatch.setattr(tagged, "cut_lineage", lambda df: scans.append(
        df._jdf.queryExecution().executedPlan().toString()) or real(df))
    report = QUERIES["coverage_metrics"](spark, "/root/testdata/sf0.001")
    assert len(scans) == 1 and scans[0].count("Scan parquet") <= 8
    assert "Scan parquet" not in report._jdf.queryExecution().executedPlan().toString()
