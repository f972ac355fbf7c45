"""A demand run as one call: classify once, compute, store, and report what became of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ..sources.seeds import OCCUPATIONS
from ..sources.stored import INSERTED, SKIPPED, UPDATED, FactStore
from . import demand

# Columns that a later run of the same id brings up to date.
REFRESHED = (
    "job_count", "apprenticeship_count", "demand_score", "data_completeness_status", "evidence",
    "rule_version",
)


def stores(folder: str) -> tuple[FactStore, FactStore]:
    """(demand rows, run log) of a folder."""
    rows = FactStore(f"{folder}/demand", key="id", updated=REFRESHED,
                     compared=tuple(c for c in demand.COMPARED))
    return rows, FactStore(f"{folder}/runs", key="run_id", updated=("status",))


def run_demand(
    postings: DataFrame, apprenticeships: DataFrame | None, folder: str, start: str, end: str,
    source_id: str | None = None, sector: str | None = None, district: str | None = None,
    rule_version: str = demand.RULE_VERSION,
) -> DataFrame:
    """One row: the run's counters, rows created, updated and skipped, runs created, coverage.

    Postings are read once, into the small cell table that counters and demand both come from.
    Rows and the run log are stored under ``folder``; the same run again creates and updates
    nothing.
    """
    cells = cut_lineage(demand.demand_cells(postings, apprenticeships, source_id, sector, start, end))
    counters = demand.run_counters(cells)
    rows = demand.district_demand(cells, start, end, rule_version, district, OCCUPATIONS)
    kept, log = stores(folder)
    outcomes = kept.upsert(rows)
    runs = log.upsert(demand.run_rows(rows))
    counted = outcomes.agg(*[
        F.count_if(F.col("outcome") == o).alias(f"rows_{name}")
        for o, name in ((INSERTED, "created"), (UPDATED, "updated"), (SKIPPED, "skipped"))])
    created = runs.agg(F.count_if(F.col("outcome") == INSERTED).alias("runs_created"))
    covered = F.struct(F.lit(source_id).alias("source_id"), F.col("input_observations").alias("row_count"))
    return counters.crossJoin(counted).crossJoin(created).select(  # one row each
        F.lit(source_id).alias("source_id"), F.lit(rule_version).alias("rule_version"),
        F.lit(start).alias("period_start"), F.lit(end).alias("period_end"), *counters.columns,
        "rows_created", "rows_updated", "rows_skipped", "runs_created", covered.alias("source_coverage"))


def demand_csv(spark, folder: str) -> DataFrame:
    """The stored demand rows in the columns of the export."""
    from ..sources.sinks import DEMAND_COLUMNS

    return stores(folder)[0].read(spark).select(*DEMAND_COLUMNS)
