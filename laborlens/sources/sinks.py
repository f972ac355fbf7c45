"""Writers: flat CSV and JSON exports and idempotent appends.

Every writer leaves one file per task; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.skills import SkillDictionary, evidence_rows, extract_repeated


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def skill_evidence_export(
    postings: DataFrame, dictionary: SkillDictionary, source_id: str | None = None
) -> DataFrame:
    """The eleven columns of the evidence export."""
    if source_id:
        postings = postings.where(F.col("source_id") == source_id)
    period = F.to_date("retrieved_at").cast("string").alias("observation_period")
    dated = postings.withColumn("observation_period", period)
    keep = ("posting_id", "district", "sector", "source_id", "observation_period")
    return evidence_rows(extract_repeated(dated, dictionary, keep=keep), keep).select(
        F.col("canonical_skill_id").alias("skill_id"),
        F.col("canonical_skill_name").alias("skill_name"),
        F.col("posting_id").alias("job_posting_id"),
        "evidence_type", "match_confidence", "extraction_method", "evidence_text", "district",
        "sector", "source_id", "observation_period",
    )


# Output columns of the exports, in file order.
DEMAND_COLUMNS = (
    "id", "run_id", "district", "occupation_id", "observation_period_start",
    "observation_period_end", "job_count", "apprenticeship_count", "demand_score",
    "data_completeness_status", "provenance_state", "rule_version",
)
SKILL_DEMAND_COLUMNS = (
    "skill_id", "skill_name", "distinct_job_count", "mention_count",
    "normalized_distinct_job_count", "high_confidence", "medium_confidence", "low_confidence",
    "title_mentions", "description_mentions", "source_skill_mentions", "verification_status",
)
GAP_COLUMNS = (
    "skill_id", "skill_name", "gap_status", "demand_distinct_job_count", "demand_mention_count",
    "demand_normalized_distinct_job_count", "has_supply_evidence", "verification_status",
)
SUMMARY_COLUMNS = (
    "skill_id", "skill_name", "distinct_job_count", "mention_count", "source_skill_mentions",
    "title_mentions", "description_mentions", "high_confidence", "medium_confidence",
    "low_confidence",
)
CANDIDATE_COLUMNS = (
    "candidate_skill", "job_count", "mention_count", "recommended_action", "verification_status",
    "observed_forms", "example_source_skills",
)
REVIEW_COLUMNS = (
    "candidate_skill", "observed_forms", "distinct_jobs", "mention_count", "current_status",
    "recommended_action", "canonical_skill_name", "canonical_skill_id", "reason", "confidence",
)
SOURCE_COLUMNS = (
    "source_id", "source_name", "organization", "url", "category", "access_method",
    "freshness_class", "last_fetched_at", "coverage", "reliability_notes",
)


# Columns of the dimension export.
DIMENSION_COLUMNS = ("skill_id", "skill_name", "verification_status")
OCCUPATION_COLUMNS = (
    "occupation_id", "occupation_name", "aliases", "sector", "source_reference", "verification_status",
)
PROFILE_COLUMNS = ("column_name", "null_count", "null_percentage", "unique_count", "example_values")
COLLISION_COLUMNS = (
    "identity", "collision_size", "classification", "jobids", "uniq_ids", "job_titles", "companies",
    "locations", "post_dates", "reason", "confidence",
)
COVERAGE_COLUMNS = (
    "skill_id", "skill_name", "before_job_count", "after_job_count", "before_mention_count",
    "after_mention_count", "coverage_status",
)
EXPORTS = {
    "demand": DEMAND_COLUMNS, "skill_demand": SKILL_DEMAND_COLUMNS, "skill_gap": GAP_COLUMNS,
    "skill_summary": SUMMARY_COLUMNS, "skill_candidates": CANDIDATE_COLUMNS,
    "ontology_review": REVIEW_COLUMNS, "sources": SOURCE_COLUMNS, "skills": DIMENSION_COLUMNS,
    "occupations": OCCUPATION_COLUMNS, "column_profile": PROFILE_COLUMNS,
    "collision_groups": COLLISION_COLUMNS, "coverage": COVERAGE_COLUMNS,
}


def export(df: DataFrame, name: str) -> DataFrame:
    """The columns of an export, structs and arrays as JSON text so that CSV can hold them.

    A column that ``df`` lacks is an error, so an export never loses one silently.
    """
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (F.to_json(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c))
            .alias(c)
            for c in EXPORTS[name]
        ]
    )


def staged(df: DataFrame, valid: str = "is_valid") -> DataFrame:
    """Rows for the staging table: raw JSON of the record and its processing status."""
    return df.withColumn(
        "raw_json", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    ).withColumn(
        "processing_status", F.when(F.col(valid), "staged").otherwise("failed")
    )
