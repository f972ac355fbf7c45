"""District x occupation demand, run counters, and the idempotent upsert of demand rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import demand_run_id
from ..functions.scoring import completeness
from ..functions.text import is_blank, strip
from ..session import cut_lineage
from ..sources.seeds import OCCUPATIONS, TOKEN_RULES, occupations_df
from .occupation import with_occupation
from .scope import district_key, observation_scope

RULE_VERSION = "mvp-v1-no-score"  # fixed value


def demand_cells(
    postings: DataFrame | None,
    apprenticeships: DataFrame | None,
    source_id: str | None = None,
    sector: str | list[str] | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    occupations=OCCUPATIONS,
    rules=TOKEN_RULES,
) -> DataFrame:
    """Counts per (kind, district spelling, sector known, occupation, status): one pass.

    Every demand figure derives from this small table.  Rows of one title are counted in the task
    that reads them and each distinct title of a district is resolved once.  ``scope`` keeps the
    source and sector that were asked for, so that run ids differ by them.
    """
    wanted = [source_id, sector if sector is None or isinstance(sector, str) else ",".join(sorted(sector))]
    scope = F.array(*[F.lit(s) for s in wanted if s]).cast("array<string>")
    parts = []
    for kind, df, title in (
        ("JOB", postings, "job_title"), ("APPRENTICESHIP", apprenticeships, "trade_title")
    ):
        if df is not None:
            scoped = observation_scope(df, source_id, None, sector, start, end)
            parts.append(
                scoped.select(F.lit(kind).alias("kind"), "district", "sector",
                              F.col(title).alias("title"))
            )
    facts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    spelled = F.nullif(strip(F.col("district")), F.lit(""))
    usable = F.col("district").isNotNull() & F.col("has_sector")
    resolved = with_occupation(
        facts.select(
            "kind", spelled.alias("district"), (~is_blank(F.col("sector"))).alias("has_sector"),
            "title",
        ).groupBy("kind", "district", "has_sector", "title").agg(F.count(F.lit(1)).alias("n")),
        "title", occupations, rules,
    )
    return (
        resolved.select(
            "kind", "district", "has_sector",
            F.when(usable, F.col("occupation.occupation_id")).alias("occupation_id"),
            F.when(usable, F.col("occupation.status")).alias("status"), "n",
        )
        .groupBy("kind", "district", "has_sector", "occupation_id", "status")
        .agg(
            F.sum("n").alias("n"),
            # filters on these stay above the aggregate; a filter on the key itself would be
            # pushed down and repeat the whole title resolution inside a predicate
            F.bool_or(F.col("occupation_id").isNotNull()).alias("is_mapped"),
            F.bool_or(F.col("district").isNotNull()).alias("has_district"),
        )
        .withColumn("scope", scope)
    )


def _tally(kind: str, test: Column | None = None) -> Column:
    chosen = F.col("kind") == kind
    if test is not None:
        chosen = chosen & test
    return F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0))


def _evidence(test_name: str) -> Column | None:
    has_district, mapped = F.col("has_district"), F.col("is_mapped")
    return {
        "total": None,
        "unknown_district": ~has_district,
        "unknown_sector": has_district & ~F.col("has_sector"),
        "mapped": mapped,
        "unmapped": has_district & F.col("has_sector") & ~mapped,
        "needs_review": mapped & (F.col("status") == "NEEDS_REVIEW"),
    }[test_name]


_WINDOW_WIDE = ("total", "unknown_district")
_LOCAL = ("unknown_sector", "mapped", "unmapped", "needs_review")


def district_demand(
    cells: DataFrame,
    start: date | str,
    end: date | str,
    rule_version: str = RULE_VERSION,
    district: str | None = None,
    occupations=OCCUPATIONS,
) -> DataFrame:
    """One row per (district, occupation) with job and apprenticeship counts and evidence.

    Totals and unknown-district counts are window wide; the other evidence counts belong to
    the district.  Spellings that differ in case or outer space are one district, shown under
    their first spelling.  ``demand_score`` stays null under this rule version.  The small cell
    table is checkpointed, so this runs one job when called.
    """
    spark = cells.sparkSession
    cells = cut_lineage(cells)  # three aggregates read it; resolve the titles once
    kinds = (("JOB", "job"), ("APPRENTICESHIP", "appr"))
    totals = cells.agg(
        *[_tally(k, _evidence(name)).alias(f"{name}_{short}")
          for k, short in kinds for name in _WINDOW_WIDE]
    )
    keyed = cells.where("has_district").withColumn(
        "district_key", district_key(F.col("district"))
    )
    if district:
        keyed = keyed.where(F.col("district_key") == district.strip().lower())
    local = keyed.groupBy("district_key").agg(
        F.min("district").alias("district"),
        F.any_value("scope").alias("scope"),  # the same in all cells of a run
        *[_tally(k, _evidence(name)).alias(f"{name}_{short}")
          for k, short in kinds for name in _LOCAL],
    )
    counts = (
        keyed.where("is_mapped")
        .groupBy("district_key", "occupation_id")
        .agg(_tally("JOB").alias("job_count"),
             _tally("APPRENTICESHIP").alias("apprenticeship_count"))
    )
    sectors = occupations_df(spark, occupations).select("occupation_id", "sector")
    first, last = (F.lit(str(d)).cast("date") for d in (start, end))
    run = demand_run_id(rule_version, F.col("district"), first, last, F.col("scope"))
    return (
        counts.join(local, "district_key")
        .join(sectors, "occupation_id", "left")
        .crossJoin(F.broadcast(totals))  # one row by construction
        .withColumn("run_id", run)
        .select(
            F.concat(
                F.substring("run_id", 1, 16), F.lit("-"), F.col("district_key"), F.lit("-"),
                F.col("occupation_id"),
            ).alias("id"),
            "run_id", "district", "occupation_id", "sector",
            first.alias("observation_period_start"), last.alias("observation_period_end"),
            "job_count", "apprenticeship_count",
            F.lit(None).cast("double").alias("demand_score"),
            completeness(F.col("total_job") + F.col("total_appr"))
            .alias("data_completeness_status"),
            F.struct(
                F.col("total_job").alias("total_job_postings_evaluated"),
                F.col("mapped_job").alias("mapped_job_postings"),
                F.col("unmapped_job").alias("unmapped_job_postings"),
                F.col("unknown_district_job").alias("unknown_district_job_postings"),
                F.col("unknown_sector_job").alias("unknown_sector_job_postings"),
                F.col("needs_review_job").alias("needs_review_mapping_job_postings"),
                F.col("total_appr").alias("total_apprenticeships_evaluated"),
                F.col("mapped_appr").alias("mapped_apprenticeships"),
                F.col("unmapped_appr").alias("unmapped_apprenticeships"),
                F.col("unknown_district_appr").alias("unknown_district_apprenticeships"),
                F.col("unknown_sector_appr").alias("unknown_sector_apprenticeships"),
                F.col("needs_review_appr").alias("needs_review_mapping_apprenticeships"),
                F.lit("DETERMINISTIC_EXACT_AND_SUBSTRING_ALIAS")
                .alias("occupation_mapping_method"),
                F.lit("UNAVAILABLE").alias("demand_score_method"),
            ).alias("evidence"),
            F.lit("DERIVED").alias("provenance_state"),
            F.lit(rule_version).alias("rule_version"),
        )
    )


def run_counters(cells: DataFrame) -> DataFrame:
    """One row: how the postings of a run were classified."""
    jobs = F.col("kind") == "JOB"
    eligible = F.col("has_district") & F.col("has_sector")
    return cells.agg(
        _tally("JOB").alias("input_observations"),
        _tally("JOB", eligible).alias("eligible_observations"),
        _tally("JOB", _evidence("mapped")).alias("mapped_observations"),
        _tally("JOB", _evidence("unmapped")).alias("unmapped_observations"),
        _tally("JOB", _evidence("unknown_district")).alias("unknown_district_observations"),
        _tally("JOB", _evidence("needs_review")).alias("needs_review_mapping_observations"),
        F.countDistinct(F.when(jobs, district_key(F.col("district")))).alias("districts"),
        F.countDistinct(F.when(jobs, F.col("occupation_id"))).alias("occupations"),
    )


def run_rows(demand: DataFrame) -> DataFrame:
    """The run log: one completed run per distinct run id of a demand table."""
    return demand.select(
        "run_id",
        F.col("observation_period_start").alias("input_data_start_date"),
        F.col("observation_period_end").alias("input_data_end_date"),
        "rule_version",
        F.lit("COMPLETED").alias("status"),
    ).distinct()


def source_coverage(sources: DataFrame) -> DataFrame:
    """The registry's part of a demand report: name and freshness of each source considered."""
    return sources.select("source_id", "source_name", "freshness_class")


COMPARED = (
    "district", "occupation_id", "sector", "observation_period_start", "observation_period_end",
    "job_count", "apprenticeship_count", "demand_score", "data_completeness_status",
    "rule_version",
)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id",
           compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """Merged snapshot with ``upsert_status`` KEPT / CREATED / SKIPPED / UPDATED.

    The compared fields decide SKIPPED; an UPDATED row takes every incoming value.
    """
    columns = existing.columns
    old, new = existing.alias("old"), incoming.select(*columns).alias("new")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    status = (
        F.when(F.col(f"new.{key}").isNull(), "KEPT")
        .when(F.col(f"old.{key}").isNull(), "CREATED")
        .when(same, "SKIPPED")
        .otherwise("UPDATED")
    )
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    from_new = F.col("upsert_status").isin("CREATED", "UPDATED")
    return joined.withColumn("upsert_status", status).select(
        *[F.when(from_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
          for c in columns],
        "upsert_status",
    )


def upsert_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        *[F.count_if(F.col("upsert_status") == s).alias(f"rows_{s.lower()}")
          for s in ("CREATED", "UPDATED", "SKIPPED")]
    )


def demand_for_period(
    demand: DataFrame, runs: DataFrame, start: str, end: str, rule_version: str = RULE_VERSION
) -> DataFrame:
    """Demand rows of all runs of one period and rule, districts in order, big counts first."""
    chosen = runs.where(
        (F.col("input_data_start_date") == F.lit(start).cast("date"))
        & (F.col("input_data_end_date") == F.lit(end).cast("date"))
        & (F.col("rule_version") == rule_version)
    ).select("run_id")
    return demand.join(chosen, "run_id", "left_semi").orderBy(
        "district", F.desc("job_count"), "id"
    )


def top_districts(demand: DataFrame, n: int = 5) -> DataFrame:
    """Districts with the most mapped postings, names breaking ties."""
    return (
        demand.groupBy("district").agg(
            F.sum("job_count").alias("job_count"),
            F.sum("apprenticeship_count").alias("apprenticeship_count"))
        .orderBy(F.desc("job_count"), "district").limit(n)
    )


def top_demand(
    demand: DataFrame, district: str | None = None, occupation_id: str | None = None,
    limit: int = 50,
) -> DataFrame:
    if district:
        demand = demand.where(F.col("district") == district)
    if occupation_id:
        demand = demand.where(F.col("occupation_id") == occupation_id)
    return demand.orderBy(F.desc("job_count"), "id").limit(limit)
