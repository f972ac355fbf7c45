"""Ingestion routes: historical rows, governed raw feeds, posting and institute snapshots."""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identity import (
    content_hash, institute_identity, staged_job_identity, staging_id, trade_identity,
)
from ..functions.parse import experience_first_two, iso_date, salary_first_two
from ..functions.text import is_blank
from .governance import decision
from .persist import (
    first_per_key, ingest_accounting, postings_to_insert, relationships_to_insert,
    resolve_relationships,
)
from .validate import reasons


class Connector(Protocol):
    """A source as DataFrames: what to read, how a raw row becomes a record, what is wrong."""

    source_id: str

    def read(self, spark: SparkSession) -> DataFrame: ...

    def normalize(self, raw: DataFrame) -> DataFrame: ...

    def errors(self) -> Column: ...


def default_errors() -> Column:
    """Records need a title and a location."""
    return reasons(
        (F.coalesce("job_title", F.lit("")) == "", "missing job_title"),
        (F.coalesce("location_text", F.lit("")) == "", "missing location_text"),
    )


def governed_records(
    raw: DataFrame, connector: Connector, policies: DataFrame, ordinal: str
) -> DataFrame:
    """Records with their gate action, content hash, errors and ``disposition``.

    BLOCKED when the source may not be ingested, INVALID with errors, DUPLICATE after the first
    row of a content hash (by the unique ``ordinal``), else STAGED.  Duplicates are found from each hash's first ordinal, so
    a payload repeated any number of times combines on the map side.
    """
    action, eligible = decision(policies, connector.source_id)

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "source_id": F.lit(connector.source_id), "action": F.lit(action),
            "eligible": F.lit(eligible)})

    raw_columns = [c for c in raw.columns if c != ordinal]
    hashed = connector.normalize(raw.withColumn("content_hash", content_hash(*raw_columns)))
    records = labelled(hashed).withColumn("validation_errors", connector.errors())
    if not eligible:  # nothing of it is looked at further
        return records.withColumn("disposition", F.lit("BLOCKED"))
    clean = F.size("validation_errors") == 0
    firsts = (
        records.where(clean).groupBy("content_hash").agg(F.min(ordinal).alias("_first"))
        .select(F.col("_first").alias(ordinal), F.lit(True).alias("_is_first"))
    )
    return records.join(firsts, ordinal, "left").withColumn(
        "disposition",
        F.when(~clean, "INVALID").when(F.col("_is_first"), "STAGED").otherwise("DUPLICATE"),
    ).drop("_is_first")


def governed_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source_id", "action", "disposition").agg(
        F.count(F.lit(1)).alias("records")
    )


def staged_snapshot(records: DataFrame) -> DataFrame:
    """Snapshot records as staging rows: validity, errors, ids, and parsed fields.

    A malformed posting date stays null with a flag.  The first row of each staging id wins.
    """
    errors = reasons(
        *[(F.coalesce(F.col(c), F.lit("")) == "", f"Missing {c}") for c in (
            "source_record_id", "job_title", "employer_name", "district", "sector")]
    )
    defaulted = records.withColumns(
        {
            "district": F.coalesce("district", F.lit("Pune")),
            "state": F.coalesce("state", F.lit("Maharashtra")),
        }
    )
    valid = F.size("_errors") == 0
    staged = defaulted.withColumn("_errors", errors).withColumns(
        {
            "staging_id": staging_id(F.col("source_id"), F.col("source_record_id")),
            "is_valid": valid,
            "validation_errors": F.nullif(F.array_join("_errors", "; "), F.lit("")),
            "processing_status": F.when(valid, "normalized").otherwise("failed"),
            "job_identity_hash": F.when(
                valid,
                staged_job_identity(
                    F.col("source_id"), F.col("source_record_id"), F.col("job_title"),
                    F.col("employer_name"),
                ),
            ),
            "_experience": experience_first_two(F.col("experience_years")),
            "_salary": salary_first_two(F.col("salary")),
            "_posted": iso_date(F.col("posted_date")),
        }
    )
    return staged.select(
        "*",
        F.col("_experience.low").alias("experience_years_min"),
        F.col("_experience.high").alias("experience_years_max"),
        F.col("_salary.low").alias("salary_min"), F.col("_salary.high").alias("salary_max"),
        F.lit("INR").alias("salary_currency"),
        F.col("_posted.value").alias("posted_day"),
        F.col("_posted.malformed").alias("posted_date_malformed"),
    ).drop("_errors", "_experience", "_salary", "_posted")


def jobs_from_staging(staged: DataFrame, existing_jobs: DataFrame, ordinal: str) -> DataFrame:
    """Typed rows to append: valid, first of their identity, not stored yet."""
    valid = staged.where("is_valid")
    return first_per_key(valid, "job_identity_hash", ordinal).join(
        existing_jobs.select("job_identity_hash"), "job_identity_hash", "left_anti"
    )


def snapshot_counts(staged: DataFrame, to_append: DataFrame) -> DataFrame:
    total = staged.agg(
        F.count(F.lit(1)).alias("total_records_processed"),
        F.countDistinct("staging_id").alias("staged"),
        F.count_if(~F.col("is_valid")).alias("errors"),
    )
    return total.crossJoin(to_append.agg(F.count(F.lit(1)).alias("normalized")))  # one row each


def institutes(snapshot: DataFrame, district: str = "Pune") -> DataFrame:
    """Institutes with identity and contract errors; another district is an error."""
    errors = reasons(
        *[(is_blank(F.col(c)), f"{c}: required non-blank string")
          for c in ("institute_name", "institute_code", "district", "state")],
        (F.col("district") != district, F.concat(
            F.lit(f"district must be '{district}', got '"), F.col("district"), F.lit("'"))),
    )
    defaulted = snapshot.withColumns(
        {
            "institute_code": F.coalesce("institute_code", "institute_name"),
            "district": F.coalesce("district", F.lit("Pune")),
            "state": F.coalesce("state", F.lit("Maharashtra")),
        }
    )
    return defaulted.withColumns(
        {
            "validation_errors": errors,
            "record_identity_hash": institute_identity(
                F.col("institute_code"), F.col("institute_name"), F.col("district")
            ),
        }
    ).withColumn("is_valid", F.size("validation_errors") == 0)


def institute_trades(valid_institutes: DataFrame, missing: str = "") -> DataFrame:
    """Trades of valid institutes; the position inside the institute is part of the identity."""
    return (
        valid_institutes.where("is_valid")
        .select("source_id", "institute_code", "institute_name", "district", "state",
                F.posexplode("trades").alias("position", "t"))
        .select(
            "source_id", "institute_code", "institute_name", "district", "state", "position",
            "t.*",
            trade_identity(
                F.col("institute_code"), F.col("t.trade_name"), F.col("t.unit_category"),
                F.col("t.intake"), F.col("position"), missing,
            ).alias("trade_identity_hash"),
        )
        .where(~is_blank(F.col("trade_name")))
    )


class InstituteUpsert(NamedTuple):
    """Rows to append on both levels, the rejected institutes, and one row of counts."""

    institutes: DataFrame
    trades: DataFrame
    rejected: DataFrame
    counts: DataFrame


def institute_upsert(
    checked: DataFrame, stored: DataFrame, stored_trades: DataFrame, missing: str = ""
) -> InstituteUpsert:
    """Insert-or-skip of institutes and their trades.

    ``checked`` comes from :func:`institutes`; ``stored`` has the known record_identity_hash,
    ``stored_trades`` the known trade_identity_hash.  Trades of a known institute are added too.
    """
    identity, trade = "record_identity_hash", "trade_identity_hash"
    valid = checked.where("is_valid").dropDuplicates([identity])
    trades = institute_trades(valid, missing).dropDuplicates([trade])
    fresh = valid.join(stored.select(identity), identity, "left_anti")
    fresh_trades = trades.join(stored_trades.select(trade), trade, "left_anti")
    rejected = checked.where("not is_valid")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    counts = count(fresh, "institutes_created")
    for df, name in ((valid, "institutes"), (fresh_trades, "trades_created"), (trades, "trades"),
                     (rejected, "institutes_rejected")):
        counts = counts.crossJoin(count(df, name))  # one row each
    return InstituteUpsert(fresh, fresh_trades, rejected, counts.select(
        "institutes_created",
        (F.col("institutes") - F.col("institutes_created")).alias("institutes_skipped"),
        "institutes_rejected", "trades_created",
        (F.col("trades") - F.col("trades_created")).alias("trades_skipped")))


class HistoricalIngest(NamedTuple):
    """What a run would append, and its accounting; nothing is written, which makes a dry run."""

    facts: DataFrame
    relationships: DataFrame
    accounting: DataFrame


def historical_ingest(
    normalized: DataFrame, existing: DataFrame, groups: DataFrame,
    stored_relationships: DataFrame | None = None, ordinal: str = "ordinal",
    counted: DataFrame | None = None, **facts,
) -> HistoricalIngest:
    """From normalised rows to facts, relationships and accounting.

    ``normalized`` has every raw row with ``accepted``, its identity and ``ordinal``; ``groups`` are
    the collision groups of the accepted rows.  Groups link to all facts, stored ones included.
    ``counted`` are the same rows, written before, with ``accepted`` and the identity alone:
    accounting and relationships read no more, and what only the facts need is not kept for them.
    """
    counted = normalized if counted is None else counted
    accepted = normalized.where("accepted")
    fresh = postings_to_insert(accepted, existing, ordinal=ordinal, **facts)
    identity = "record_identity_hash"
    known = counted.where("accepted").select(identity).distinct().withColumn(
        "posting_id", F.substring(identity, 1, 32))
    edges = resolve_relationships(groups, known)
    if stored_relationships is None:
        stored_relationships = edges.limit(0)
    return HistoricalIngest(
        fresh, relationships_to_insert(edges, stored_relationships),
        ingest_accounting(counted, existing))
