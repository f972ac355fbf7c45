"""The set-similarity join of titles with a reference, against scoring every pair."""

import random
import re

import pytest

from laborlens.operators import occupation

TITLES = "title string, skills string, canonical_occupation_id string"
REFERENCE = ("entry_order long, nco_code string, occupation_title string, division string, group_name string,"
             " source_reference string, is_authoritative boolean")
OCCUPATIONS = "occupation_id string, occupation_name string, aliases array<string>, source_reference string"


def tokens(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def plain(title, skills, occ, reference, scopes):
    if not title:
        return 0.0, None
    words, other = tokens(title), tokens(skills)
    inside = [e for e in reference if scopes.get(occ, set()) & (tokens(e[2]) | tokens(e[4]))]
    scored = [(0.7 * jaccard(words, tokens(e[2])) + 0.3 * jaccard(other, tokens(e[4])), -e[0])
              for e in inside or reference]
    score, order = max(scored, default=(0.0, 0))
    return (score, -order) if score > 0 else (0.0, None)


@pytest.mark.parametrize("few", [0, 10_000])
def test_every_title_gets_its_best_entry(spark, monkeypatch, few):
    monkeypatch.setattr(occupation, "COMMON_TOKENS", 5)
    monkeypatch.setattr(occupation, "FEW_ENTRIES", few)
    rng = random.Random(6)
    words = ["operator", "senior", "machine", "tool", "data", "entry", "welder", "gas", "of", "it", "nurse", "x1"]
    phrase = lambda most: " ".join(rng.choices(words, [9, 6, 4, 3, 2, 2, 1, 1, 5, 3, 1, 1],
                                               k=rng.randrange(most)))
    reference = [(k, str(k), phrase(6), "", phrase(4), "r", bool(k % 2)) for k in range(80)]
    occupations = [("O1", "Machine Operator", ["welder"], "gas"), ("O2", "Unheard", ["of that"], "zzz"),
                   ("O3", "Nothing", [], "shared")]
    scopes = {"O1": tokens("machine operator welder gas"), "O2": tokens("unheard of that zzz"),
              "O3": tokens("nothing shared")}
    asked = {(phrase(7), rng.choice([None, "", phrase(5)]), rng.choice([None, "O1", "O2", "O3", "O9"]))
             for _ in range(300)}
    asked |= {(None, "data", None), ("", "data", "O1"), ("???", "data entry", None), ("no such", None, None)}
    asked = sorted(asked, key=repr)
    got = occupation.map_to_reference(
        spark.createDataFrame(asked + asked[:9], TITLES), spark.createDataFrame(reference, REFERENCE),
        spark.createDataFrame(occupations, OCCUPATIONS)).collect()
    assert len(got) == len(asked)
    found = {(r["title"], r["skills"], r["canonical_occupation_id"] if r["title"] else None): r for r in got}
    for title, skills, occ in asked:
        score, order = plain(title, skills, occ, reference, scopes)
        row = found[title, skills, occ if title else None]
        assert abs(row["confidence"] - score) <= 5.1e-5, (title, skills, occ)
        assert row["nco_title"] == (reference[order][2] if score >= 0.35 else None)
    assert sum(r["method"] == "TOKEN_SIMILARITY" for r in got) > 50
    assert sum(r["method"] == "LOW_CONFIDENCE" and r["confidence"] > 0 for r in got) > 5


def test_without_a_reference(spark):
    got = occupation.map_to_reference(
        spark.createDataFrame([("a", "b", None), (None, None, None)], TITLES),
        spark.createDataFrame([], REFERENCE), spark.createDataFrame([], OCCUPATIONS)).collect()
    assert {(r["title"], r["method"], r["confidence"]) for r in got} == {("a", "NO_REFERENCE", 0.0), (None, "NONE", 0.0)}
