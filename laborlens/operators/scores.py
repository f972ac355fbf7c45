"""Measures the design documents specify: demand score, skill weight, course coverage, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import demand_run_id
from ..functions.scoring import completeness, coverage_severity
from ..functions.text import strip
from .demand import RULE_VERSION, demand_cells
from .scope import district_key, observation_scope
from .skills import SkillDictionary, count_by_skill, extract_skills
from .texts import COPIES, TEXT_FIELDS, distinct_texts

SCORE_RULE_VERSION = "score-v1"
VOLUME, RECENCY, APPRENTICESHIP = 0.50, 0.30, 0.20  # fixed values


def demand_score(
    demand: DataFrame, recency: DataFrame, digits: int = 6
) -> DataFrame:
    """Score 0..100 per (district, occupation) with its components.

    Volume and apprenticeship are counts over their largest value; ``recency`` supplies
    (district_key, occupation_id, recent_jobs) and its signal is the recent part of the
    postings.  A component without data is null and its weight is left out, never faked.
    """
    peak = demand.agg(
        F.max("job_count").alias("max_jobs"), F.max("apprenticeship_count").alias("max_appr")
    )
    volume = F.try_divide(F.col("job_count"), F.col("max_jobs"))
    apprenticeship = F.try_divide(F.col("apprenticeship_count"), F.col("max_appr"))
    recent = F.try_divide(F.coalesce("recent_jobs", F.lit(0)), F.col("job_count"))
    parts = [(VOLUME, "volume_signal"), (RECENCY, "recency_signal"),
             (APPRENTICESHIP, "apprenticeship_signal")]
    weighted = sum(
        (F.coalesce(w * F.col(c), F.lit(0.0)) for w, c in parts[1:]),
        F.coalesce(parts[0][0] * F.col(parts[0][1]), F.lit(0.0)),
    )
    weights = sum(
        (F.when(F.col(c).isNotNull(), w).otherwise(0.0) for w, c in parts[1:]),
        F.when(F.col(parts[0][1]).isNotNull(), parts[0][0]).otherwise(0.0),
    )
    return (
        demand.withColumn("district_key", district_key(F.col("district")))
        .join(recency, ["district_key", "occupation_id"], "left")
        .crossJoin(F.broadcast(peak))  # one row by construction
        .select(
            "district", "occupation_id", "job_count", "apprenticeship_count",
            F.bround(volume, digits).alias("volume_signal"),
            F.bround(recent, digits).alias("recency_signal"),
            F.bround(apprenticeship, digits).alias("apprenticeship_signal"),
        )
        .withColumn("demand_score", F.bround(F.try_divide(100 * weighted, weights), 2))
        .withColumn("rule_version", F.lit(SCORE_RULE_VERSION))
    )


def recent_jobs(
    postings: DataFrame, since: str, end: str, **scope
) -> DataFrame:
    """Mapped postings per (district, occupation) retrieved from ``since`` through ``end``."""
    cells = demand_cells(postings, None, start=since, end=end, **scope)
    return (
        cells.where("is_mapped")
        .groupBy(district_key(F.col("district")).alias("district_key"), "occupation_id")
        .agg(F.sum("n").alias("recent_jobs"))
    )


def skill_weight(demand: DataFrame, digits: int = 6) -> DataFrame:
    """Frequency over the largest frequency: an analytical weight, not a probability."""
    peak = demand.agg(F.max("distinct_job_count").alias("max_jobs"))
    return demand.crossJoin(F.broadcast(peak)).select(
        "skill_id", "distinct_job_count",
        F.coalesce(
            F.bround(F.try_divide("distinct_job_count", "max_jobs"), digits), F.lit(0.0)
        ).alias("skill_demand_weight"),
    )


def course_coverage(course_skills: DataFrame, demanded: DataFrame) -> DataFrame:
    """Per course: share of the demanded skills it teaches, covered and missing lists, severity.

    ``demanded`` is the list of demanded skills (one row per skill of the ontology).
    """
    wanted = demanded.select("skill_id").distinct().agg(
        F.array_sort(F.collect_list("skill_id")).alias("wanted")
    )
    taught = course_skills.groupBy("course").agg(F.collect_set("skill_id").alias("taught"))
    covered = F.array_sort(F.array_intersect("wanted", "taught"))
    missing = F.array_sort(F.array_except("wanted", "taught"))
    return (
        taught.crossJoin(F.broadcast(wanted))  # one row by construction
        .select(
            "course",
            F.array_join(covered, ",").alias("covered_skills"),
            F.array_join(missing, ",").alias("missing_skills"),
            F.size(covered).cast("bigint").alias("covered_count"),
            F.size(missing).cast("bigint").alias("missing_count"),
            F.bround(F.try_divide(100.0 * F.size(covered), F.size("wanted")), 2)
            .alias("coverage_percent"),
        )
        .withColumn("gap_severity", coverage_severity(F.col("coverage_percent")))
    )


def training_actions(
    gap: DataFrame, course_skills: DataFrame, occupation_jobs: DataFrame,
    occupation_training: DataFrame, high: float = 0.05, strong: float = 0.10, low_supply: int = 1,
) -> DataFrame:
    """Three rules, each row with the evidence it rests on.

    CURRICULUM_REVIEW: a course and a skill demanded above ``high`` that it does not cover.
    CAPACITY_REVIEW: an occupation with at least the share ``high`` of the mapped jobs and at most
    ``low_supply`` places that train for it.  NEW_COURSE_EXPLORATION: a skill demanded above
    ``strong`` that no course covers.

    ``course_skills`` (course, skill_id), ``occupation_jobs`` (occupation_id, job_count),
    ``occupation_training`` (occupation_id, training_count).
    """
    share = F.col("demand_normalized_distinct_job_count")
    demanded = gap.where(share >= high).select(
        "skill_id", F.col("demand_distinct_job_count").alias("job_count"), share.alias("share"))
    none = F.lit(None).cast("string")
    # One row of wanted skills, bounded by the ontology, meets each course once.
    wanted = demanded.agg(F.collect_list(F.struct("skill_id", "job_count")).alias("wanted"))
    taught = course_skills.groupBy("course").agg(F.collect_set("skill_id").alias("taught"))
    curriculum = (
        taught.crossJoin(F.broadcast(wanted))
        .select("course", F.explode(F.filter(
            "wanted", lambda w: ~F.array_contains(F.col("taught"), w["skill_id"]))).alias("w"))
        .select(
            F.lit("CURRICULUM_REVIEW").alias("action"), "course", none.alias("occupation_id"),
            F.col("w.skill_id").alias("skill_id"), F.col("w.job_count").alias("job_count"),
            F.lit(None).cast("bigint").alias("supply_count"),
            F.format_string("%d jobs ask for %s; %s does not cover it", F.col("w.job_count"),
                            F.col("w.skill_id"), F.col("course")).alias("evidence"),
        )
    )
    total = occupation_jobs.agg(F.sum("job_count").alias("all_jobs"))
    places = F.coalesce("training_count", F.lit(0)).cast("bigint")
    capacity = (
        occupation_jobs.crossJoin(F.broadcast(total))
        .where(F.col("job_count") >= high * F.col("all_jobs"))
        .join(occupation_training, "occupation_id", "left").where(places <= low_supply)
        .select(
            F.lit("CAPACITY_REVIEW").alias("action"), none.alias("course"), "occupation_id",
            none.alias("skill_id"), "job_count", places.alias("supply_count"),
            F.format_string("%d jobs for %s; %d places train for it", "job_count",
                            "occupation_id", places).alias("evidence"),
        )
    )
    exploration = (
        demanded.where(F.col("share") >= strong)
        .join(course_skills.select("skill_id").distinct(), "skill_id", "left_anti")
        .select(
            F.lit("NEW_COURSE_EXPLORATION").alias("action"), none.alias("course"),
            none.alias("occupation_id"), "skill_id", "job_count",
            F.lit(0).cast("bigint").alias("supply_count"),
            F.format_string("%d jobs ask for %s; no course covers it", "job_count", "skill_id")
            .alias("evidence"),
        )
    )
    return curriculum.unionByName(capacity).unionByName(exploration)


# Status when neither the source nor its dates tell.
SOURCE_TYPE_STATUS = {
    "SUPPLEMENTARY_HISTORICAL": "EXPIRED", "PRIMARY_LIVE": "ACTIVE",
    "PRIMARY_HISTORICAL": "EXPIRED",
}


def derived_status(
    reported: Column, end_date: Column, source_type: Column, as_of: Column
) -> Column:
    """``struct(status, rule)``: reported, else from the end date, else from the source type."""
    by_type = F.lit(None).cast("string")
    for name, status in SOURCE_TYPE_STATUS.items():
        by_type = F.when(source_type == name, status).otherwise(by_type)
    by_date = F.when(end_date.isNotNull(), F.when(end_date >= as_of, "ACTIVE")
                     .otherwise("EXPIRED"))
    return F.struct(
        F.coalesce(reported, by_date, by_type).alias("status"),
        F.when(reported.isNotNull(), "SOURCE_REPORTED").when(end_date.isNotNull(), "END_DATE")
        .when(by_type.isNotNull(), "SOURCE_TYPE").alias("rule"),
    )


def district_skill_demand(
    postings: DataFrame, dictionary: SkillDictionary, start: str, end: str,
    rule_version: str = RULE_VERSION, **scope,
) -> DataFrame:
    """Skill demand rows per district: ids, counts, share of the district's postings, provenance.

    Postings are scanned once for the skills and once, narrow, for the totals.  A district of
    several spellings shows the first of them.  ``demand_score`` stays null under this rule version.
    """
    scoped = observation_scope(postings, start=start, end=end, **scope).withColumn(
        "district_key", district_key(F.col("district")))
    texts = distinct_texts(scoped, TEXT_FIELDS, by=("district_key",))
    extracted = extract_skills(texts, dictionary, ("district_key", COPIES), "title", snippets=False)
    counts = count_by_skill(extracted, by=("district_key",), copies=COPIES).where(
        F.col("district_key").isNotNull() & F.col("skill_id").isNotNull())
    totals = scoped.where(F.col("district_key").isNotNull()).groupBy("district_key").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.min(strip(F.col("district"))).alias("district"))
    first, last = (F.lit(d).cast("date") for d in (start, end))
    named = [scope.get("source_id"), scope.get("sector")]
    run = demand_run_id(
        f"skill-demand:{rule_version}", F.col("district"), first, last,
        F.array(*[F.lit(s if isinstance(s, str) else ",".join(sorted(s))) for s in named if s])
        .cast("array<string>"))
    return counts.join(totals, "district_key").withColumn("run_id", run).select(
        F.concat_ws("-", F.substring("run_id", 1, 16), "district_key", "skill_id").alias("id"),
        "run_id", "district", "skill_id", F.lit(None).cast("string").alias("sector"),
        first.alias("observation_period_start"), last.alias("observation_period_end"),
        "distinct_job_count", "mention_count", "total_jobs",
        F.bround(F.try_divide("distinct_job_count", "total_jobs"), 6).alias("normalized_count"),
        F.lit(None).cast("double").alias("demand_score"),
        completeness(F.col("total_jobs")).alias("data_completeness_status"),
        F.lit("DERIVED").alias("provenance_state"), F.lit(rule_version).alias("rule_version"),
    )


def monthly_status(postings: DataFrame) -> DataFrame:
    """Postings per month and status."""
    return postings.groupBy(
        F.to_date(F.date_trunc("month", "posted_date")).alias("month"), "status"
    ).agg(F.count(F.lit(1)).alias("postings"))
