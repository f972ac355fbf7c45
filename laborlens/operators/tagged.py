"""Several skill dictionaries matched in one pass over the postings.

All phrases of all dictionaries become one trie, read at every place where a phrase can begin.  Of
the phrases that fit there one is a prefix of the other, so the longest one stands for all of them:
a table made once per phrase tells for each dictionary which of its own phrases that is.  Each
dictionary then resolves overlaps for itself, as `skills.extract_skills` does with its own pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import (
    _MARK, _OTHER_MARK, bind, collapse, split_source_skills, sql_text,
)
from ..session import cut_lineage
from .skills import SkillDictionary, _trie_pattern
from .texts import COPIES, distinct_texts

ENTRY = "array<struct<d:int,id:string,confidence:string,size:int>>"
MEASURES = ("distinct_job_count", "mention_count", "high_confidence", "medium_confidence", "low_confidence",
            "text_mentions", "jobs_processed", "jobs_with_skill_evidence", "unmatched_mentions")


def _literal(table: dict[str, list[tuple[int, str, str, int]]]) -> Column:
    """map<phrase, entries>: what a phrase says to each dictionary."""
    def entry(d: int, skill_id: str, confidence: str, size: int) -> str:
        return (f"named_struct('d', {d}, 'id', {sql_text(skill_id)}, 'confidence', {sql_text(confidence)},"
                f" 'size', {size})")

    rows = ", ".join(f"{sql_text(p)}, array({', '.join(entry(*e) for e in found)})"
                     for p, found in table.items())
    return F.expr(f"map({rows})") if rows else F.expr(f"CAST(map() AS map<string,{ENTRY}>)")


def _heads(phrase: str) -> list[str]:
    """The phrase and its beginnings that end at a word boundary, the longest first."""
    ends = [k for k in range(1, len(phrase)) if not re.match(r"\w", phrase[k])]
    return [phrase, *(phrase[:k] for k in reversed(ends))]


def _text_table(dictionaries: list[SkillDictionary]) -> dict[str, list[tuple[int, str, str, int]]]:
    out: dict[str, list] = {}
    for phrase in sorted({p for d in dictionaries for p in d.text}):
        for number, d in enumerate(dictionaries):
            head = next((h for h in _heads(phrase) if h in d.text), None)
            if head is not None:
                skill, canonical = d.text[head]
                out.setdefault(phrase, []).append(
                    (number, skill.skill_id, "HIGH" if canonical else "MEDIUM", len(head)))
    return out


def _segment_table(dictionaries: list[SkillDictionary]) -> dict[str, list[tuple[int, str, str, int]]]:
    out: dict[str, list] = {}
    for number, d in enumerate(dictionaries):
        for phrase, (skill, _, confidence) in d.segment.items():
            out.setdefault(phrase, []).append((number, skill.skill_id, confidence, 1))
    return out


def _text_matches(text: Column, table: dict) -> Column:
    """array<struct<start, entries>>: every place where a phrase begins, in order."""
    pattern = _trie_pattern(list(table), r"(?<!\w)(?=(") + "))"
    lookup = _literal(table)
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER_MARK)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(F.regexp_replace(clean, pattern, _MARK), _MARK, -1), F.length)
        return bind(gaps, lambda g: F.transform(found, lambda p, i: F.struct(
            F.aggregate(F.slice(g, 1, i + 1), F.lit(0), lambda a, x: a + x).alias("start"),
            F.coalesce(F.element_at(lookup, F.lower(p)), F.array().cast(ENTRY)).alias("entries"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    none = F.array().cast(f"array<struct<start:int,entries:{ENTRY}>>")
    return F.coalesce(bind(found, lambda f: F.when(F.size(f) > 0, placed(f))), none)


def _own(matches: Column, d: int, field: int) -> Column:
    """(d, id, confidence, field): what a dictionary keeps, each skill's first match."""
    mine = F.filter(
        F.transform(matches, lambda m: F.struct(
            m["start"].alias("start"), F.get(F.filter(m["entries"], lambda e: e["d"] == d), 0).alias("e"))),
        lambda m: m["e"].isNotNull())
    kept = F.aggregate(
        mine,
        F.struct(F.lit(0).alias("end"), F.array().cast(
            "array<struct<start:int,e:struct<d:int,id:string,confidence:string,size:int>>>").alias("kept")),
        lambda acc, m: F.when(m["start"] >= acc["end"], F.struct(
            (m["start"] + m["e"]["size"]).alias("end"), F.concat(acc["kept"], F.array(m)).alias("kept")))
        .otherwise(acc),
        lambda acc: F.transform(acc["kept"], lambda m: m["e"]))
    return bind(kept, lambda entries: _firsts(entries, field))


def _firsts(entries: Column, field: int) -> Column:
    ids = F.transform(entries, lambda e: e["id"])
    return F.transform(
        F.filter(entries, lambda e, i: F.array_position(ids, e["id"]) == i + 1),
        lambda e: F.struct(e["d"].alias("d"), e["id"].alias("skill_id"),
                           e["confidence"].alias("confidence"), F.lit(field).alias("field")))


def tagged_counts(
    postings: DataFrame, dictionaries: dict[str, SkillDictionary], title: str = "job_title",
    description: str = "description", source_skills: str = "source_skills",
) -> DataFrame:
    """(dictionary, skill_id, MEASURES): one scan, each distinct text matched once.

    The row with a null skill holds a dictionary's totals over postings.  Written out, as several
    reports read it; it has one row per dictionary and skill.
    """
    own = list(dictionaries.values())
    text, segment = _text_table(own), _segment_table(own)
    lookup = _literal(segment)
    texts = distinct_texts(postings, {"title": title, "description": description, "source_skills": source_skills})
    rows = texts.select(
        COPIES, _text_matches(F.col("title"), text).alias("m1"),
        _text_matches(F.col("description"), text).alias("m2"),
        F.transform(split_source_skills(F.col("source_skills")), lambda s: F.coalesce(
            F.element_at(lookup, collapse(s)), F.array().cast(ENTRY))).alias("segments"))

    def of(d: int) -> Column:
        segments = F.flatten(F.transform("segments", lambda s: F.filter(s, lambda e: e["d"] == d)))
        return F.concat(bind(segments, lambda s: _firsts(s, 0)), _own(F.col("m1"), d, 1), _own(F.col("m2"), d, 2))

    def told(d: int) -> Column:
        """Entries of one dictionary, then its totals of the posting."""
        def with_total(found: Column) -> Column:
            ids = F.transform(found, lambda e: e["skill_id"])
            zero = F.lit(0)
            each = F.transform(found, lambda e, i: F.struct(
                e["d"].alias("d"), e["skill_id"].alias("skill_id"),
                (F.array_position(ids, e["skill_id"]) == i + 1).cast("int").alias("distinct_job_count"),
                F.lit(1).alias("mention_count"),
                *[(e["confidence"] == level).cast("int").alias(f"{level.lower()}_confidence")
                  for level in ("HIGH", "MEDIUM", "LOW")],
                (e["field"] > 0).cast("int").alias("text_mentions"), zero.alias("jobs_processed"),
                zero.alias("jobs_with_skill_evidence"), zero.alias("unmatched_mentions")))
            unmatched = F.size(F.filter("segments", lambda s: ~F.exists(s, lambda e: e["d"] == d)))
            total = F.struct(
                F.lit(d).alias("d"), F.lit(None).cast("string").alias("skill_id"),
                *[zero.alias(m) for m in MEASURES[:6]], F.lit(1).alias("jobs_processed"),
                (F.size(found) > 0).cast("int").alias("jobs_with_skill_evidence"),
                unmatched.alias("unmatched_mentions"))
            return F.concat(each, F.array(total))
        return bind(of(d), with_total)

    entries = F.concat(*[told(d) for d in range(len(own))])
    counts = (rows.select(COPIES, F.explode(entries).alias("x")).groupBy("x.d", "x.skill_id")
              .agg(*[F.sum(F.col(f"x.{m}") * F.col(COPIES)).alias(m) for m in MEASURES]))
    names = F.array(*[F.lit(name) for name in dictionaries])
    return cut_lineage(counts.select(F.get(names, F.col("d")).alias("dictionary"), "skill_id", *MEASURES))


def summary(counts: DataFrame, name: str, dictionary: SkillDictionary) -> DataFrame:
    """Per skill of the dictionary: skill_name, distinct_job_count, mention_count."""
    own = counts.where((F.col("dictionary") == name) & F.col("skill_id").isNotNull())
    seed = dictionary.to_df(counts.sparkSession).select("skill_id", "skill_name")
    return seed.join(own, "skill_id", "left").select(
        "skill_id", "skill_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in MEASURES[:2]])


def totals(counts: DataFrame, name: str) -> DataFrame:
    """One row of corpus totals, named as in `skills.corpus_metrics`."""
    zero = lambda m: F.coalesce(F.sum(m), F.lit(0))
    return counts.where(F.col("dictionary") == name).agg(
        zero("jobs_processed").alias("jobs_processed"), zero("mention_count").alias("total_evidence_rows"),
        zero("jobs_with_skill_evidence").alias("jobs_with_skill_evidence"),
        zero("text_mentions").alias("text_matched_mentions"),
        *[zero(m).alias(m) for m in ("unmatched_mentions", "high_confidence", "medium_confidence",
                                     "low_confidence")])
