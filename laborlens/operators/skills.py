"""Skill evidence: which canonical skills a posting names, where, and how surely.

Extraction is row-local.  The phrase dictionary becomes one trie-shaped regular expression
and two literal maps, so a scan of postings turns into evidence without any shuffle, join or
Python worker; the only exchanges in this module carry partial counts, of skills or of the distinct
texts that counts are made of.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import (
    bind, collapse, is_blank, literal_array, literal_map, split_source_skills, squeeze,
    text_between,
)
from ..sources.seeds import (
    COMMON_EQUIVALENCES, SKILLS, TECH_TOKENS, TITLE_NOISE, Skill, skills_df,
)
from .texts import COPIES, TEXT_FIELDS, distinct_texts, once_per_text

EVIDENCE_TYPE = (
    "struct<source_skill_text:string,canonical_skill_id:string,canonical_skill_name:string,"
    "extraction_method:string,match_confidence:string,evidence_text:string,evidence_type:string>"
)
MOST_SKILLS = 4000  # skills of an ontology that may become literals
CONTEXT = 40  # characters of context on each side of a match


def _norm(text: str) -> str:
    return " ".join(text.lower().split())


def _trie_pattern(
    phrases: list[str], before: str = r"(?<!\w)", after: str = r"(?!\w)",
    longest_first: bool = True,
) -> str:
    """One alternation of all phrases between two boundary assertions.

    Shared prefixes are tested once, so the cost per position does not grow with the
    dictionary.  Of several phrases that fit at a position one is a prefix of the other;
    ``longest_first`` says which of them wins.
    """
    root: dict = {}
    for phrase in phrases:
        node = root
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        options = [_quote(ch) + emit(child) for ch, child in sorted(node.items()) if ch]
        if "" in node:
            options.insert(len(options) if longest_first else 0, after)
        return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

    return "(?iU)" + before + emit(root)


def _quote(ch: str) -> str:
    return ch if ch.isalnum() or ord(ch) > 127 or ch in " _" else "\\" + ch


@dataclass(frozen=True)
class SkillDictionary:
    """Phrases and their skills, ready to be used as literals in a plan."""

    skills: tuple[Skill, ...]
    text: dict[str, tuple[Skill, bool]]  # phrase -> (skill, is canonical name)
    segment: dict[str, tuple[Skill, str, str]]  # phrase -> (skill, method, confidence)

    @classmethod
    def build(
        cls, skills: tuple[Skill, ...] = SKILLS, equivalences: dict[str, str] | None = None
    ) -> "SkillDictionary":
        names = {_norm(s.skill_name): s for s in skills}
        aliases = {_norm(a): s for s in skills for a in s.aliases}
        text = {p: (s, False) for p, s in aliases.items()}
        text.update({p: (s, True) for p, s in names.items()})
        segment = {p: (s, "SOURCE_SKILL_ALIAS", "MEDIUM") for p, s in aliases.items()}
        segment.update({p: (s, "SOURCE_SKILL_EXACT", "HIGH") for p, s in names.items()})
        for observed, target in (equivalences or {}).items():
            hit = text.get(_norm(target))
            if hit:
                segment[_norm(observed)] = (hit[0], "SOURCE_SKILL_ALIAS", "MEDIUM")
        text.pop("", None)
        segment.pop("", None)
        return cls(tuple(skills), text, segment)

    @classmethod
    def from_df(
        cls, ontology: DataFrame, equivalences: dict[str, str] | None = None,
        most: int = MOST_SKILLS,
    ) -> "SkillDictionary":
        """From an ontology table, such as ``readers.ontology_json(spark, path, "skills")``.

        The dictionary becomes literals of the plan, so the table is read on the driver; one of
        more than ``most`` skills is an error.  ``phrases.evidence_by_join`` takes any number.
        """
        rows = ontology.orderBy("seed_order").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"an ontology of more than {most} skills does not fit into a plan;"
                             " phrases.evidence_by_join takes it as a table")
        return cls.build(
            tuple(
                Skill(r["skill_id"], r["canonical_skill_name"], tuple(r["aliases"] or ()),
                      r["skill_category"], r["verification_status"] or "NEEDS_REVIEW")
                for r in rows
            ),
            equivalences,
        )

    @classmethod
    def with_common_equivalences(cls, skills: tuple[Skill, ...] = SKILLS) -> "SkillDictionary":
        return cls.build(skills, COMMON_EQUIVALENCES)

    @property
    def pattern(self) -> str:
        return _trie_pattern(list(self.text))

    def text_map(self) -> Column:
        return literal_map(
            {
                phrase: {
                    "id": skill.skill_id, "name": skill.skill_name,
                    "method": "EXACT" if canonical else "ALIAS",
                    "confidence": "HIGH" if canonical else "MEDIUM",
                }
                for phrase, (skill, canonical) in self.text.items()
            }
        )

    def segment_map(self) -> Column:
        return literal_map(
            {
                phrase: {"id": skill.skill_id, "name": skill.skill_name, "method": method,
                         "confidence": confidence}
                for phrase, (skill, method, confidence) in self.segment.items()
            }
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        return skills_df(spark, self.skills)


def _first_per_skill(entries: Column) -> Column:
    """Keep the first entry of each skill; ``entries`` is array<struct<..., hit>>."""
    return bind(
        F.transform(entries, lambda e: e["hit"]["id"]),
        lambda ids: F.filter(
            entries, lambda e, i: F.array_position(ids, e["hit"]["id"]) == i + 1
        ),
    )


def _segments(source_skills: Column, dictionary: SkillDictionary) -> Column:
    lookup = dictionary.segment_map()
    return F.transform(
        split_source_skills(source_skills),
        lambda s: bind(
            collapse(s),
            lambda n: F.struct(
                s.alias("raw"), n.alias("norm"), F.element_at(lookup, n).alias("hit")
            ),
        ),
    )


def _segment_evidence(segments: Column) -> Column:
    matched = F.filter(segments, lambda s: s["hit"].isNotNull())
    return F.transform(
        bind(matched, _first_per_skill),
        lambda e: F.struct(
            e["raw"].alias("source_skill_text"),
            e["hit"]["id"].alias("canonical_skill_id"),
            e["hit"]["name"].alias("canonical_skill_name"),
            e["hit"]["method"].alias("extraction_method"),
            e["hit"]["confidence"].alias("match_confidence"),
            e["raw"].alias("evidence_text"),
            F.lit("SOURCE_SKILL").alias("evidence_type"),
        ),
    )


def _total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))


def _context(text: Column, matches: Column, gaps: Column, index: Column) -> Column:
    """Text around the match at ``index``: everything before it is gaps and earlier matches."""

    def cut(start: Column) -> Column:
        stop = start + F.length(F.get(matches, index)) + CONTEXT
        first = F.greatest(start - CONTEXT, F.lit(0))
        return squeeze(F.substring(text, first + 1, stop - first))

    before = _total_length(F.slice(gaps, F.lit(1), index + 1)) + _total_length(
        F.slice(matches, F.lit(1), index)
    )
    return bind(before, cut)


def _text_evidence(
    text: Column, dictionary: SkillDictionary, field: str, snippets: bool
) -> Column:
    pattern, lookup = dictionary.pattern, dictionary.text_map()
    prefix = {"JOB_TITLE": "TITLE_", "JOB_DESCRIPTION": "DESCRIPTION_"}[field]

    def rows(matches: Column, firsts: Column, gaps: Column | None) -> Column:
        return F.transform(
            firsts,
            lambda e: F.struct(
                e["phrase"].alias("source_skill_text"),
                e["hit"]["id"].alias("canonical_skill_id"),
                e["hit"]["name"].alias("canonical_skill_name"),
                F.concat(F.lit(prefix), e["hit"]["method"]).alias("extraction_method"),
                e["hit"]["confidence"].alias("match_confidence"),
                (F.lit(None).cast("string") if gaps is None
                 else _context(text, matches, gaps, e["index"])).alias("evidence_text"),
                F.lit(field).alias("evidence_type"),
            ),
        )

    def entries(norms: Column) -> Column:
        found = F.transform(
            F.array_distinct(norms),
            lambda p: F.struct(
                p.alias("phrase"), F.element_at(lookup, p).alias("hit"),
                (F.array_position(norms, p).cast("int") - 1).alias("index"),
            ),
        )
        return bind(F.filter(found, lambda e: e["hit"].isNotNull()), _first_per_skill)

    def per_match(matches: Column) -> Column:
        firsts = bind(F.transform(matches, F.lower), entries)
        if snippets:
            body = bind(
                firsts,
                lambda f: bind(text_between(text, pattern), lambda gaps: rows(matches, f, gaps)),
            )
        else:
            body = bind(firsts, lambda f: rows(matches, f, None))
        return F.when(F.size(matches) > 0, body)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(f"array<{EVIDENCE_TYPE}>")
    return F.coalesce(bind(found, per_match), empty)


def _annotate(evidence: Column) -> Column:
    """Add the position, whether it is the posting's first of its skill, and the field count.

    A posting holds at most one entry per (skill, field), so counting a skill's entries counts
    its fields, and counting the flagged entries counts distinct postings without a distinct.
    """
    return bind(
        F.transform(evidence, lambda e: e["canonical_skill_id"]),
        lambda ids: F.transform(
            evidence,
            lambda e, i: F.struct(
                e["source_skill_text"].alias("source_skill_text"),
                e["canonical_skill_id"].alias("canonical_skill_id"),
                e["canonical_skill_name"].alias("canonical_skill_name"),
                e["extraction_method"].alias("extraction_method"),
                e["match_confidence"].alias("match_confidence"),
                e["evidence_text"].alias("evidence_text"),
                e["evidence_type"].alias("evidence_type"),
                (F.array_position(ids, e["canonical_skill_id"]) == i + 1).alias("first_for_job"),
                F.size(
                    F.filter(ids, lambda x: x == e["canonical_skill_id"])
                ).alias("field_count"),
            ),
        ),
    )


def extract_skills(
    postings: DataFrame,
    dictionary: SkillDictionary,
    keep: tuple[str, ...] = ("posting_id",),
    title: str | None = "job_title",
    description: str | None = "description",
    source_skills: str | None = "source_skills",
    snippets: bool = True,
    boost: bool = False,
) -> DataFrame:
    """``keep`` columns plus ``evidence`` and ``unmatched`` arrays, one row per posting.

    Source-skill segments come first, then title, then description.  ``boost`` raises the
    confidence of a skill seen in two or more fields (LOW to MEDIUM, otherwise HIGH).
    ``snippets=False`` skips the context text when only counts are needed.
    """
    df = postings.select(
        *keep,
        (_segments(F.col(source_skills), dictionary) if source_skills else F.lit(None))
        .alias("_segments"),
        *[F.col(c).alias(f"_{c}") for c in (title, description) if c],
    )
    parts = []
    if source_skills:
        parts.append(_segment_evidence(F.col("_segments")))
    if title:
        parts.append(_text_evidence(F.col(f"_{title}"), dictionary, "JOB_TITLE", snippets))
    if description:
        parts.append(
            _text_evidence(F.col(f"_{description}"), dictionary, "JOB_DESCRIPTION", snippets)
        )
    evidence = bind(F.concat(*parts) if len(parts) > 1 else parts[0], _annotate)
    if boost:
        evidence = F.transform(
            evidence,
            lambda e: e.withField(
                "match_confidence",
                F.when(e["field_count"] < 2, e["match_confidence"])
                .when(e["match_confidence"] == "LOW", "MEDIUM").otherwise("HIGH"),
            ),
        )
    unmatched = (
        F.transform(
            F.filter(F.col("_segments"), lambda s: s["hit"].isNull()),
            lambda s: F.struct(s["raw"].alias("raw_text"), s["norm"].alias("normalized_text")),
        )
        if source_skills
        else F.array().cast("array<struct<raw_text:string,normalized_text:string>>")
    )
    return df.select(*keep, evidence.alias("evidence"), unmatched.alias("unmatched"))


def extract_repeated(
    postings: DataFrame, dictionary: SkillDictionary, keep: tuple[str, ...] = ("posting_id",),
    title: str | None = "job_title", description: str | None = "description",
    source_skills: str | None = "source_skills", **options: bool,
) -> DataFrame:
    """``extract_skills`` of postings whose texts repeat: each distinct text is matched once."""
    names = [c for c in (title, description, source_skills) if c]

    def worked(rows: DataFrame) -> DataFrame:
        return extract_skills(rows, dictionary, tuple(rows.columns), title, description,
                              source_skills, **options)

    rows = postings.select(*dict.fromkeys((*keep, *names)))
    return once_per_text(rows, names, worked).select(*keep, "evidence", "unmatched")


def evidence_rows(extracted: DataFrame, keep: tuple[str, ...] = ("posting_id",)) -> DataFrame:
    """One row per evidence entry."""
    return extracted.select(*keep, F.explode("evidence").alias("e")).select(*keep, "e.*")


def unmatched_rows(extracted: DataFrame, keep: tuple[str, ...] = ("posting_id",)) -> DataFrame:
    """One row per source-skill segment that names no known skill."""
    return extracted.select(*keep, F.explode("unmatched").alias("u")).select(
        *keep, F.lit("SOURCE_SKILL").alias("source_field"), "u.*"
    )


def job_profiles(extracted: DataFrame, key: str = "posting_id") -> DataFrame:
    """Per-posting counts, computed from the arrays in place (no grouping)."""
    ev = F.col("evidence")
    return extracted.select(
        key,
        F.size(ev).cast("bigint").alias("total_mentions"),
        F.size(F.filter(ev, lambda e: e["first_for_job"])).cast("bigint").alias("matched_skills"),
        F.size("unmatched").cast("bigint").alias("unmatched_mentions"),
        F.size(F.filter(ev, lambda e: e["first_for_job"] & (e["field_count"] >= 2)))
        .cast("bigint").alias("cross_field_confirmed"),
        F.array_join(
            F.array_sort(F.array_distinct(F.transform(ev, lambda e: e["evidence_type"]))), ","
        ).alias("fields_contributing"),
        F.lit(True).alias("is_complete"),
    )


def count_by_skill(
    extracted: DataFrame, by: tuple[str, ...] = (), copies: str | None = None
) -> DataFrame:
    """One pass over postings to per-skill counts.

    The null-skill group stands for postings without evidence, so totals over all postings
    come from the same small result.  ``posting_starts`` counts each posting exactly once.
    ``copies`` names a column of how many postings a row stands for.
    """
    times = F.col(copies) if copies else F.lit(1)
    rows = extracted.select(
        *by, times.alias("_times"), F.posexplode_outer("evidence").alias("pos", "e"))

    def count_if(test: Column) -> Column:
        return F.sum(F.when(test, F.col("_times")).otherwise(0).cast("bigint"))

    conf, kind = F.col("e.match_confidence"), F.col("e.evidence_type")
    return rows.groupBy(*by, F.col("e.canonical_skill_id").alias("skill_id")).agg(
        count_if(F.col("e.first_for_job")).alias("distinct_job_count"),
        count_if(F.col("e.canonical_skill_id").isNotNull()).alias("mention_count"),
        count_if(conf == "HIGH").alias("high_confidence"),
        count_if(conf == "MEDIUM").alias("medium_confidence"),
        count_if(conf == "LOW").alias("low_confidence"),
        count_if(kind == "JOB_TITLE").alias("title_mentions"),
        count_if(kind == "JOB_DESCRIPTION").alias("description_mentions"),
        count_if(kind == "SOURCE_SKILL").alias("source_skill_mentions"),
        count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("posting_starts"),
    )


COUNTS = (
    "distinct_job_count", "mention_count", "high_confidence", "medium_confidence",
    "low_confidence", "title_mentions", "description_mentions", "source_skill_mentions",
)


def skill_summary(
    extracted: DataFrame, dictionary: SkillDictionary, copies: str | None = None
) -> DataFrame:
    """Every known skill with its counts, zero-filled; skills outside the seed come last."""
    spark = extracted.sparkSession
    counts = count_by_skill(extracted, copies=copies).where(F.col("skill_id").isNotNull())
    seed = dictionary.to_df(spark).select("skill_id", "skill_name")
    return (
        seed.join(counts, "skill_id", "full")
        .select(
            "skill_id",
            F.coalesce("skill_name", "skill_id").alias("skill_name"),
            F.col("skill_name").isNull().alias("outside_seed"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        )
        .orderBy(
            "outside_seed",
            F.when(F.col("outside_seed"), -F.col("distinct_job_count")), "skill_id",
        )
    )


def corpus_metrics(
    postings: DataFrame, dictionary: SkillDictionary, **fields: str | None
) -> DataFrame:
    """One row: posting, evidence and mention totals over the whole corpus, one scan."""
    names = {f: fields.get(f, c) for f, c in TEXT_FIELDS.items()}

    def present(column: str) -> Column:
        return ~is_blank(F.col(column)) if names[column] else F.lit(False)

    flagged = distinct_texts(postings, names).withColumns(
        {"_has_source": present("source_skills"), "_has_description": present("description")}
    )
    extracted = extract_skills(
        flagged, dictionary, keep=("_has_source", "_has_description", COPIES), snippets=False,
        **{f: f if c else None for f, c in names.items()}
    )
    ev = F.col("evidence")

    def total(count: Column) -> Column:
        return F.coalesce(F.sum(count * F.col(COPIES)), F.lit(0))

    def jobs(test: Column) -> Column:
        return total(test.cast("int"))

    def entries(test) -> Column:
        return total(F.size(F.filter(ev, test)))

    return extracted.agg(
        total(F.lit(1)).alias("jobs_processed"),
        jobs(F.col("_has_source")).alias("jobs_with_source_skills"),
        jobs(F.col("_has_description")).alias("jobs_with_description"),
        total(F.size(ev)).alias("total_evidence_rows"),
        jobs(F.size(ev) > 0).alias("jobs_with_skill_evidence"),
        entries(lambda e: e["evidence_type"] != "SOURCE_SKILL").alias("text_matched_mentions"),
        total(F.size("unmatched")).alias("unmatched_mentions"),
        entries(lambda e: e["match_confidence"] == "HIGH").alias("high_confidence"),
        entries(lambda e: e["match_confidence"] == "MEDIUM").alias("medium_confidence"),
        entries(lambda e: e["match_confidence"] == "LOW").alias("low_confidence"),
    ).withColumn(
        "total_mentions_observed", F.col("text_matched_mentions") + F.col("unmatched_mentions")
    )


def top_unmatched(extracted: DataFrame, n: int = 30) -> DataFrame:
    return (
        unmatched_rows(extracted, keep=())
        .where(F.col("normalized_text") != "")
        .groupBy(F.col("normalized_text").alias("phrase")).count()
        .orderBy(F.desc("count"), "phrase").limit(n)
    )


def top_words(texts: DataFrame, column: str, stop_words: list[str] = []) -> DataFrame:
    """Corpus word counts without stop words."""
    from ..functions.text import corpus_words

    words = texts.select(F.explode(corpus_words(F.col(column))).alias("word"))
    if stop_words:
        words = words.where(~F.col("word").isin(stop_words))
    return words.groupBy("word").count()


# --- candidate discovery -----------------------------------------------------------------

def tech_token_pattern(longest_first: bool = False) -> str:
    """The technical-token regex.

    By default word boundaries and alternative order follow the source system, where ``c++``,
    ``c#`` and a bare ``.net`` cannot end or start at a boundary and short alternatives hide
    longer ones.  ``longest_first`` repairs both.
    """
    tokens = list(dict.fromkeys(TECH_TOKENS))
    if longest_first:
        return _trie_pattern(tokens)
    # in the token list a short form that can end before a space or dot precedes its extensions
    return _trie_pattern(tokens, r"\b", r"\b", longest_first=False)


def _form_counts(rows: DataFrame, source_kind: str) -> DataFrame:
    """(candidate, raw form) counts from an array of structs ``norm, raw`` per distinct text.

    A posting adds one to ``jobs`` at its first occurrence of a candidate only, so distinct
    postings are a plain sum and a hot candidate never lands in one task unaggregated.
    """
    flagged = bind(
        F.transform(F.col("found"), lambda f: f["norm"]),
        lambda norms: F.transform(
            F.col("found"),
            lambda f, i: F.struct(
                f["norm"].alias("candidate"), f["raw"].alias("form"),
                (F.array_position(norms, f["norm"]) == i + 1).cast("int").alias("first"),
            ),
        ),
    )
    return (
        rows.select(COPIES, F.explode(flagged).alias("f"))
        .groupBy(F.lit(source_kind).alias("source_kind"), "f.candidate", "f.form")
        .agg(F.sum(COPIES).alias("mentions"), F.sum(F.col("f.first") * F.col(COPIES)).alias("jobs"))
    )


def _merge_forms(form_counts: DataFrame, forms: int) -> DataFrame:
    """Counts per candidate and its first ``forms`` raw spellings in sorted order."""
    ranked = form_counts.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("source_kind", "candidate").orderBy("form")),
    )
    return ranked.groupBy("source_kind", "candidate").agg(
        F.sum("mentions").alias("mentions"),
        F.sum("jobs").alias("jobs"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("rank") <= forms, F.col("form")))), ", "
        ).alias("forms"),
    )


def probe_tokens(
    postings: DataFrame, dictionary: SkillDictionary, forms: int = 8, longest_first: bool = False
) -> DataFrame:
    """All unknown technical tokens and source categories with counts and spellings."""
    known = literal_array(dictionary.text)
    noise = literal_array(TITLE_NOISE)
    text = F.concat_ws(
        " ", F.coalesce("job_title", F.lit("")), F.coalesce("description", F.lit(""))
    )
    found = F.regexp_extract_all(text, F.lit(tech_token_pattern(longest_first)), F.lit(0))
    tokens = F.transform(found, lambda m: F.struct(collapse(m).alias("norm"), m.alias("raw")))
    segments = F.transform(
        split_source_skills(F.col("source_skills")),
        lambda s: F.struct(collapse(s).alias("norm"), s.alias("raw")),
    )

    def unknown(entries: Column, *lists: Column) -> Column:
        def wanted(e: Column) -> Column:
            keep = e["norm"] != ""
            for values in lists:
                keep = keep & ~F.array_contains(values, e["norm"])
            return keep

        return F.filter(entries, wanted)

    texts = distinct_texts(postings, {"job_title": "job_title", "description": "description"})
    categories = distinct_texts(postings, {"source_skills": "source_skills"})
    tech = texts.select(COPIES, unknown(tokens, known, noise).alias("found"))
    categories = categories.select(COPIES, unknown(segments, known).alias("found"))
    return _merge_forms(
        _form_counts(tech, "TITLE_OR_DESC_TOKEN").unionByName(
            _form_counts(categories, "SOURCE_SKILL_CATEGORY")
        ),
        forms,
    )


def discover_candidates(
    postings: DataFrame, dictionary: SkillDictionary, top_n: int | None = 30,
    min_mentions: int = 2, longest_first: bool = False,
) -> DataFrame:
    """New skill candidates: unknown source categories merged with unknown technical tokens.

    Category candidates carry a mention count of 0, as the source system reports them.
    """
    probed = probe_tokens(postings, dictionary, 5, longest_first).where(
        F.col("mentions") >= min_mentions
    )
    is_tech = F.col("source_kind") == "TITLE_OR_DESC_TOKEN"
    tech_mark = "title/desc tech token"  # fixed value
    merged = (
        probed.groupBy(F.col("candidate").alias("candidate_skill"))
        .agg(
            F.max("jobs").alias("job_count"),
            F.max(F.when(is_tech, F.col("mentions")).otherwise(0)).alias("mention_count"),
            F.max(F.when(is_tech, F.col("forms"))).alias("tech_forms"),
            F.max(F.when(~is_tech, F.col("forms"))).alias("category_forms"),
        )
        .select(
            "candidate_skill",
            F.concat_ws(" | ", "category_forms", "tech_forms").alias("observed_forms"),
            "job_count",
            "mention_count",
            F.when(F.col("tech_forms").isNull(), "")
            .when(F.col("category_forms").isNull(), tech_mark)
            .otherwise(f" | {tech_mark}").alias("example_source_skills"),
            F.lit("NEEDS_REVIEW").alias("verification_status"),
            F.when(F.col("category_forms").isNull(), "TITLE_OR_DESC_TOKEN")
            .otherwise("SOURCE_SKILL_CATEGORY").alias("recommended_action"),
        )
        .orderBy(F.desc("job_count"), "candidate_skill")
    )
    return merged if top_n is None else merged.limit(top_n)


def review_rows(probed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Probe rows joined to a decision table (candidate, action, ids, reason, confidence).

    A name seen both as a token and as a category is reviewed once, as the token.
    """
    first = F.row_number().over(
        Window.partitionBy("candidate").orderBy(F.desc("source_kind"))
    )
    undecided = F.lit("NEEDS_REVIEW")
    return (
        probed.withColumn("_n", first).where("_n = 1").drop("_n")
        .join(decisions, "candidate", "left")
        .select(
            F.col("candidate").alias("candidate_skill"),
            F.col("forms").alias("observed_forms"),
            F.col("jobs").alias("distinct_jobs"),
            F.col("mentions").alias("mention_count"),
            "source_kind",
            undecided.alias("current_status"),
            F.coalesce("action", undecided).alias("recommended_action"),
            F.coalesce("canonical_skill_name", F.lit("")).alias("canonical_skill_name"),
            F.coalesce("canonical_skill_id", F.lit("")).alias("canonical_skill_id"),
            F.coalesce("reason", F.lit("")).alias("reason"),
            F.coalesce("confidence", undecided).alias("confidence"),
        )
        .orderBy(F.desc("distinct_jobs"), "candidate_skill")
    )


def review_summary(review: DataFrame) -> DataFrame:
    return review.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("candidates"))
