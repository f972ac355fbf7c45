"""A text's tokens are made once, however many phrases it holds."""

import time

from laborlens.operators import phrases, skills
from laborlens.sources.seeds import Skill


def test_many_matches_in_one_long_text(spark):
    """Before, the whole text was cut into tokens anew for each match."""
    n = 600
    known = [Skill(f"S{k}", f"skill {k}x", (), "c") for k in range(n)]
    ontology = spark.createDataFrame(
        [(k, s.skill_id, s.skill_name, []) for k, s in enumerate(known)],
        "seed_order int, skill_id string, canonical_skill_name string, aliases array<string>")
    text = " ".join(f"w{j}, Skill {j // 50}X and é" if j % 50 == 0 else f"w{j}" for j in range(50 * n))
    rows = spark.createDataFrame(
        [("1", "skill 7x or skill 3x", text, "skill 9x; other"), ("2", None, "no match", None)],
        "posting_id string, job_title string, description string, source_skills string")
    began = time.perf_counter()
    joined = phrases.evidence_by_join(rows, phrases.phrase_table(ontology)).collect()
    took = time.perf_counter() - began
    literal = skills.evidence_rows(skills.extract_skills(rows, skills.SkillDictionary.build(tuple(known)))).collect()
    listed = lambda found: sorted(repr(sorted(r.asDict().items())) for r in found)
    assert listed(joined) == listed(literal) and len(joined) == n + 3
    assert took < 15
