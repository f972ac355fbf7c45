"""Skill demand, training supply, the gap between them, and rule-based recommendations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.identity import skill_run_id
from ..functions.scoring import GAP_ORDER, gap_class, gap_rank, share
from ..functions.text import percent_text
from .demand import RULE_VERSION
from .scope import observation_scope
from .skills import COUNTS, SkillDictionary, count_by_skill, extract_skills
from .texts import COPIES, TEXT_FIELDS, distinct_texts


def _everything() -> Window:
    # only ever used over tables with one row per known skill
    return Window.partitionBy(F.lit(0))


def skill_demand(
    postings: DataFrame,
    dictionary: SkillDictionary,
    source_id: str | None = None,
    district: str | None = None,
    sector: str | list[str] | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    rule_version: str = RULE_VERSION,
    exact_district: bool = False,
    **fields: str | None,
) -> DataFrame:
    """Every known skill with distinct postings, mentions, share and breakdowns.

    Postings are scanned once, each distinct text is matched once.  Totals over all postings are summed from the same per-skill
    counts (the null-skill group stands for postings without evidence) and repeated on each
    row: ``total_jobs``, ``jobs_with_skill_evidence``, ``total_evidence_rows``.
    """
    spark = postings.sparkSession
    scoped = observation_scope(postings, source_id, district, sector, start, end, exact_district)
    names = {f: fields.get(f, c) for f, c in TEXT_FIELDS.items()}
    texts = distinct_texts(scoped, names)
    counts = count_by_skill(
        extract_skills(texts, dictionary, keep=(COPIES,), snippets=False,
                       **{f: f if c else None for f, c in names.items()}), copies=COPIES)
    seed = dictionary.to_df(spark).select("skill_id", "skill_name", "verification_status")
    run = skill_run_id(
        rule_version, district or "ALL", source_id or "ALL",
        str(start or date.min), str(end or date.max), sector,
    )
    everything = _everything()
    merged = seed.join(counts, "skill_id", "full").withColumns(
        {
            "total_jobs": F.coalesce(F.sum("posting_starts").over(everything), F.lit(0)),
            "jobs_with_skill_evidence": F.coalesce(
                F.sum(F.when(F.col("skill_id").isNotNull(), F.col("posting_starts")))
                .over(everything), F.lit(0)
            ),
            "total_evidence_rows": F.coalesce(F.sum("mention_count").over(everything), F.lit(0)),
        }
    )
    return (
        merged.where(F.col("skill_name").isNotNull())
        .select(
            "skill_id", "skill_name",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
            "verification_status", "total_jobs", "jobs_with_skill_evidence",
            "total_evidence_rows", run.alias("run_id"), F.lit(rule_version).alias("rule_version"),
        )
        .withColumn(
            "normalized_distinct_job_count",
            F.coalesce(share(F.col("distinct_job_count"), F.col("total_jobs"), 6), F.lit(0.0)),
        )
        .orderBy(F.desc("distinct_job_count"), "skill_id")
    )


def demand_metrics(demand: DataFrame) -> DataFrame:
    """One row of report counters from a skill-demand table."""
    return demand.agg(
        F.max("total_jobs").alias("total_jobs_evaluated"),
        F.max("jobs_with_skill_evidence").alias("jobs_with_skill_evidence"),
        F.count_if(F.col("distinct_job_count") > 0).alias("skills_with_evidence"),
        F.max("total_evidence_rows").alias("total_evidence_rows"),
    )


def top_skills(demand: DataFrame, n: int = 5) -> DataFrame:
    return demand.orderBy(F.desc("normalized_distinct_job_count"), "skill_id").limit(n)


def with_evidence(demand: DataFrame) -> DataFrame:
    """Skills that some posting names."""
    return demand.where(F.col("distinct_job_count") > 0)


def filter_gap(gap: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    """Gap rows of one status whose skill name holds ``text``, in any case."""
    if status:
        gap = gap.where(F.col("gap_status") == status)
    if text:
        gap = gap.where(F.contains(F.lower("skill_name"), F.lit(text.lower())))
    return gap


def skill_supply(trade_skills: DataFrame, by: str = "skill_id") -> DataFrame:
    """Trades that teach each skill (or occupation): list and count.

    The bridge is a curated table; its distinct trades per skill fit a report cell.
    """
    return (
        trade_skills.where(F.col(by).isNotNull() & F.col("trade").isNotNull())
        .groupBy(by)
        .agg(
            F.array_sort(F.collect_set("trade")).alias("trades"),
            F.count(F.lit(1)).alias("trade_count"),
        )
    )


def supply_totals(trade_skills: DataFrame, institutes_trades: DataFrame) -> DataFrame:
    """One row: distinct trades in the bridge, institutes and summed intake of the snapshot."""
    trades = trade_skills.agg(F.countDistinct("trade").alias("total_trades"))
    intake = institutes_trades.agg(
        F.countDistinct("institute_code").alias("institute_count"),
        F.coalesce(F.sum(F.col("intake").try_cast("int")), F.lit(0)).alias("total_intake"),
    )
    return trades.crossJoin(intake)  # one row each


def skill_gap(
    demand: DataFrame, supply: DataFrame, high: float = 0.05, medium: float = 0.01
) -> DataFrame:
    """Demand against supply per skill, worst gaps first."""
    return (
        demand.join(supply, "skill_id", "left")
        .withColumn("has_supply_evidence", F.col("trade_count").isNotNull())
        .withColumn(
            "gap_status",
            gap_class(
                F.col("distinct_job_count"), F.col("normalized_distinct_job_count"),
                F.col("has_supply_evidence"), F.col("total_jobs"), high, medium,
            ),
        )
        .select(
            "skill_id", "skill_name", "gap_status",
            F.col("distinct_job_count").alias("demand_distinct_job_count"),
            F.col("mention_count").alias("demand_mention_count"),
            F.col("normalized_distinct_job_count").alias("demand_normalized_distinct_job_count"),
            "has_supply_evidence",
            F.array_join("trades", " | ").alias("supply_trades"),
            F.coalesce("trade_count", F.lit(0)).alias("supply_trade_count"),
            "high_confidence", "medium_confidence", "low_confidence",
            "verification_status", "total_jobs",
        )
        .orderBy(gap_rank(F.col("gap_status")), F.desc("demand_distinct_job_count"), "skill_id")
    )


def gap_summary(gap: DataFrame) -> DataFrame:
    """Skills per status; all five statuses are present."""
    statuses = gap.sparkSession.createDataFrame([(s,) for s in GAP_ORDER], "gap_status string")
    counts = gap.groupBy("gap_status").agg(F.count(F.lit(1)).alias("n"))
    return statuses.join(counts, "gap_status", "left").select(
        "gap_status", F.coalesce("n", F.lit(0)).alias("skills")
    )


# Recommendation wording per gap status.  Arguments: 1 skill name, 2 postings,
# 3 share text, 4 supply note, 5 evaluated postings, 6 supplier, 7 its institutes, 8 directory.
RECOMMENDATION_RULES = (
    ("HIGH_GAP_SUPPLIED",
     "Review / validate training supply for %1$s",
     "High demand evidence (%2$d jobs, %3$s share) but DVET supply evidence is unverified "
     "(NEEDS_REVIEW). Cannot recommend capacity changes until supply is validated.",
     "%2$d distinct jobs reference this skill (%3$s of evaluated jobs). %4$s",
     "MEDIUM",
     "Cross-verify DVET trade mappings against authoritative directory; validate if programmes "
     "actually cover this skill."),
    ("HIGH_GAP",
     "Investigate training supply availability for %1$s",
     "High demand evidence (%2$d jobs, %3$s share) with NO DVET supply evidence in current "
     "snapshot. Current snapshot covers only %6$s (%7$s); %8$s-wide training "
     "landscape is UNKNOWN.",
     "%2$d distinct jobs reference this skill (%3$s of evaluated jobs). %4$s",
     "MEDIUM",
     "Commission a supply mapping study against authoritative DVET directory before proposing "
     "new programmes."),
    ("MEDIUM_GAP",
     "Targeted capacity review for %1$s",
     "Moderate demand evidence (%2$d jobs, %3$s share). %4$s",
     "%2$d distinct jobs reference this skill (%3$s of evaluated jobs). %4$s",
     "LOW",
     "Assess whether existing programmes partially cover this skill; validate against full DVET "
     "directory."),
    ("NEEDS_REVIEW",
     "Verify supply data for %1$s",
     "DVET supply evidence exists but is unverified (NEEDS_REVIEW). Demand-supply alignment "
     "cannot be determined.",
     "Supply evidence present from %6$s snapshot. %2$d demand jobs. %4$s",
     "LOW",
     "Cross-verify DVET trade mappings against authoritative directory and current intake "
     "records."),
    ("NO_DATA",
     "Collect more data on %1$s",
     "No demand or supply evidence available for this skill in current observation window.",
     "Zero distinct jobs with this skill in %5$s evaluated jobs. %4$s",
     "LOW",
     "Include in next ingestion batch; widen observation window; expand source coverage."),
    ("LOW_GAP",
     "Monitor %1$s demand trend",
     "Low demand evidence (%2$d jobs, %3$s share). %4$s",
     "%2$d distinct jobs reference this skill at low volume (%3$s). %4$s",
     "LOW",
     "Monitor over next observation window before acting."),
)
SUPPLY_NOTE = (
    "DVET supply evidence present from %2$s (%3$s, %1$d trades). NOT verified against "
    "full %4$s directory. NOT extrapolated district-wide."
)
NO_SUPPLY_NOTE = "No DVET supply evidence in current snapshot (%1$s only)."
SUPPLIER, INSTITUTES, DIRECTORY = "ITI Haveli", 1, "Pune"


def recommendation_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(RECOMMENDATION_RULES),
        "rule string, recommendation_f string, reason_f string, evidence_f string, "
        "priority string, next_action string",
    )


def recommendations(
    gap: DataFrame, limit: int | None = None, source: str = "historical-postings",
    freshness: str = "HISTORICAL", evaluated: Column | None = None, supplier: str = SUPPLIER,
    institutes: int = INSTITUTES, directory: str = DIRECTORY,
) -> DataFrame:
    """One recommendation per gap row, in the order of the gap table; the first ``limit`` when set.

    ``supplier``, ``institutes`` and ``directory`` say whose training supply the gap was built on.
    """
    count = F.lit(f"{institutes} institute" + "s" * (institutes != 1))
    supplied, jobs = F.col("has_supply_evidence"), F.col("demand_distinct_job_count")
    rule = F.when(
        (F.col("gap_status") == "HIGH_GAP") & supplied, "HIGH_GAP_SUPPLIED"
    ).otherwise(F.col("gap_status"))
    note = F.when(supplied, F.format_string(
        SUPPLY_NOTE, F.col("supply_trade_count"), F.lit(supplier), count, F.lit(directory)
    )).otherwise(F.format_string(NO_SUPPLY_NOTE, F.lit(supplier)))
    order = (gap_rank(F.col("gap_status")), F.desc("demand_distinct_job_count"), F.col("skill_id"))
    ordered = gap if limit is None else gap.orderBy(*order).limit(limit)
    percent = percent_text(F.col("demand_normalized_distinct_job_count"))
    total = F.lit("N/A") if evaluated is None else evaluated.cast("string")
    args = (F.col("skill_name"), jobs, percent, note, total, F.lit(supplier), count,
            F.lit(directory))
    return ordered.withColumn("rule", rule).join(
        recommendation_rules(gap.sparkSession), "rule"
    ).orderBy(*order).select(
        "skill_id", "skill_name",
        F.printf(F.col("recommendation_f"), *args).alias("recommendation"),
        F.printf(F.col("reason_f"), *args).alias("reason"),
        F.printf(F.col("evidence_f"), *args).alias("evidence"),
        "priority",
        F.lit("LOW").alias("confidence"),
        F.lit(source).alias("source"),
        F.lit(freshness).alias("freshness"),
        F.when(jobs == 0, "NO_DATA").otherwise("OBSERVED").alias("evidence_status"),
        F.when(supplied, "NEEDS_REVIEW").otherwise("NO_SUPPLY_EVIDENCE").alias("supply_status"),
        F.col("verification_status").alias("data_quality"),
        "next_action",
    )
