"""Skill evidence by a join with phrases: equal to the extraction by literals, at any size."""

import random
import time

import pytest
from pyspark.sql import functions as F

from laborlens.operators import phrases, skills
from laborlens.sources.seeds import Skill

POSTINGS = "posting_id string, job_title string, description string, source_skills string"
ONTOLOGY = "seed_order int, skill_id string, canonical_skill_name string, aliases array<string>"


def ontology(spark, known):
    return spark.createDataFrame(
        [(k, s.skill_id, s.skill_name, list(s.aliases)) for k, s in enumerate(known)], ONTOLOGY)


def both(spark, known, rows, equivalences=None):
    postings = spark.createDataFrame(rows, POSTINGS)
    spellings = (spark.createDataFrame(list(equivalences.items()), "observed string, target string")
                 if equivalences else None)
    joined = phrases.evidence_by_join(postings, phrases.phrase_table(ontology(spark, known), spellings))
    literal = skills.evidence_rows(skills.extract_skills(
        postings, skills.SkillDictionary.build(tuple(known), equivalences)))
    assert sorted(joined.columns) == sorted(literal.columns)
    listed = lambda df: sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    return listed(joined), listed(literal)


def test_random_texts_with_overlaps_and_signs(spark):
    rng = random.Random(3)
    known = [Skill("A", "data entry", ("data", "Data  Entry Operator"), "c"),
             Skill("B", "Entry", ("entry operator", "c++"), "c"), Skill("C", "C", ("c#", ".net"), "c"),
             Skill("D", "operator data", ("net", "a/b", "a b"), "c"), Skill("E", "data", (), "c")]
    words = ["data", "Entry", "OPERATOR", "c", "C++", "c#", ".net", "net", "asp", "a", "b", "x_1", "é"]
    marks = [" ", " ", " ", "  ", "/", ".", ",", "\n", "-", ""]
    rows = []
    for k in range(150):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(25)))
        title = " ".join(rng.choices(words, k=rng.randrange(5)))
        segments = rng.choice([",", ";", " | "]).join(rng.choices(["data", " Data  entry", "c#", "other"], k=3))
        rows.append((str(k), title, text, segments))
    rows += [("none", None, None, None), ("empty", "", "", ""), ("marks", "+++", ", , ", ",,")]
    joined, literal = both(spark, known, rows, {"Other": "c", "c#": "data", "lost": "no such phrase"})
    assert joined == literal and len(joined) > 300


@pytest.mark.parametrize("text,found", [
    ("JavaScript Developer", {"S2"}), ("ASP.NET", set()), (".NET and java", {"S1", "S3"}),
    ("Core Java, java", {"S1"}), ("C++", {"S4"}), ("C++11", set()), ("xC++", set()), ("java_ee", set())])
def test_word_boundaries(spark, text, found):
    known = [Skill("S1", "Java", ("core java",), "c"), Skill("S2", "JavaScript", (), "c"),
             Skill("S3", ".NET", (), "c"), Skill("S4", "C++", (), "c")]
    table = phrases.phrase_table(ontology(spark, known))
    rows = spark.createDataFrame([("1", text, None, None)], POSTINGS)
    assert {r["canonical_skill_id"] for r in phrases.evidence_by_join(rows, table).collect()} == found


def test_ontology_beyond_literals(spark):
    most = skills.MOST_SKILLS
    big = spark.range(3 * most).select(
        F.col("id").cast("int").alias("seed_order"), F.format_string("S%d", "id").alias("skill_id"),
        F.format_string("skill %d", "id").alias("canonical_skill_name"),
        F.array(F.format_string("s%dx", "id")).alias("aliases"))
    with pytest.raises(ValueError, match="phrases"):
        skills.SkillDictionary.from_df(big)
    rows = [(str(k), f"skill {k} wanted", f"needs s{k + 1}x, SKILL {k + 2}; not skill{k}", None)
            for k in range(0, 3 * most - 2, 997)]
    began = time.perf_counter()
    found = phrases.evidence_by_join(spark.createDataFrame(rows, POSTINGS), phrases.phrase_table(big))
    built = time.perf_counter() - began
    got = {(r["posting_id"], r["canonical_skill_id"]) for r in found.collect()}
    assert got == {(p, f"S{int(p) + k}") for p, *_ in rows for k in range(3)}
    assert built < 30 and len(found._jdf.queryExecution().logical().toString()) < 200_000


def test_no_phrases_and_no_postings(spark):
    known = [Skill("A", " ", (), "c")]
    table = phrases.phrase_table(ontology(spark, known))
    assert table.count() == 0
    assert phrases.evidence_by_join(spark.createDataFrame([("1", "a", "b", "c")], POSTINGS), table).count() == 0
    some = phrases.phrase_table(ontology(spark, [Skill("A", "a", (), "c")]))
    assert phrases.evidence_by_join(spark.createDataFrame([], POSTINGS), some).count() == 0


def test_two_skills_of_one_spelling(spark):
    known = [Skill("A", "one", ("same", "two"), "c"), Skill("B", "two", ("same",), "c")]
    got = {r["phrase"]: (r["skill_id"], r["canonical"])
           for r in phrases.phrase_table(ontology(spark, known)).collect()}
    assert got == {"one": ("A", 1), "two": ("B", 1), "same": ("B", 0)}


@pytest.mark.parametrize("most", [50_000, 3])
def test_repeated_texts_go_through_the_join_once(spark, monkeypatch, most):
    known = [Skill("A", "data entry", ("data",), "c"), Skill("B", "c++", ("c",), "c")]
    kinds = [("Data Entry", "needs c++ and data", "c, other"), (None, None, None), ("", "", ""),
             ("C", None, "data;c++"), (None, "c", None)]
    rows = spark.createDataFrame([(str(k), *kinds[k % 5]) for k in range(60)], POSTINGS)
    table = phrases.phrase_table(ontology(spark, known))
    plain = phrases.evidence_by_join(rows, table)
    joined, real = [], phrases.matches
    monkeypatch.setattr(phrases, "matches", lambda df, *a: joined.append(df.count()) or real(df, *a))
    monkeypatch.setattr("laborlens.operators.texts.MOST_TEXTS", most)
    once = phrases.evidence_by_join(rows, table, repeated=True)
    assert joined == [5 if most > 5 else 60]
    assert once.columns == plain.columns and sorted(map(repr, once.collect())) == sorted(map(repr, plain.collect()))
