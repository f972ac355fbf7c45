"""Record validation: an array of reasons per row, empty when the row is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import posting_identity
from ..functions.parse import posting_date, seats
from ..functions.text import blank_to_null, is_blank, strip
from .geography import with_city_location
from .texts import once_per_text

# Closed vocabularies.
STATUSES = ("ACTIVE", "INACTIVE", "CLOSED", "EXPIRED", "PENDING")
SECTORS = ("Automotive/Manufacturing", "Electronics", "IT-ITeS")
SECTOR_SYNONYMS = {
    "IT": "IT-ITeS", "ITeS": "IT-ITeS", "IT / ITeS": "IT-ITeS",
    "Automotive": "Automotive/Manufacturing", "Manufacturing": "Automotive/Manufacturing",
    "Electronics": "Electronics",
}


def reasons(*checks: tuple[Column, str | Column]) -> Column:
    """Messages of the checks that fail (``True`` means bad), in order."""
    return F.array_compact(
        F.array(*[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks])
    )


def missing(column: str, message: str) -> tuple[Column, str]:
    return is_blank(F.col(column)), message


def canonical_sector(c: Column) -> Column:
    out = c
    for label, sector in SECTOR_SYNONYMS.items():
        out = F.when(c == label, sector).otherwise(out)
    return out


def clean_record(df: DataFrame) -> DataFrame:
    """Trim fields, map sector synonyms, and list what is missing or invalid."""
    required = ("job_title", "employer_name", "district", "sector", "state", "source_record_id")
    optional = ("description", "location", "salary", "experience_years", "min_education",
                "posted_date")
    def trimmed(c: str) -> Column:
        value = strip(F.coalesce(F.col(c), F.lit("")))
        return (canonical_sector(value) if c == "sector" else value).alias(c)

    others = [c for c in df.columns if c not in (*required, *optional)]
    cleaned = df.select(
        *others, *[trimmed(c) for c in required if c in df.columns],
        *[strip(F.nullif(F.col(c), F.lit(""))).alias(c) for c in optional if c in df.columns],
    )
    sector = F.col("sector")
    invalid = F.concat(
        F.lit("Invalid sector '"), sector, F.lit("'. Must be one of: " + ", ".join(SECTORS))
    )
    return cleaned.withColumn(
        "validation_errors",
        reasons(
            *[missing(c, f"{c} is required") for c in ("job_title", "employer_name", "district",
                                                      "sector")],
            ((sector != "") & ~sector.isin(*SECTORS), invalid),
            missing("state", "state is required"),
        ),
    ).withColumn("is_valid", F.size("validation_errors") == 0)


def contract_errors(
    required: tuple[str, ...], optional: tuple[str, ...], status: str | None = "status",
    seats_column: str | None = None,
) -> Column:
    """Contract checks: required non-blank, optional null or non-blank, closed status, seats."""
    checks: list[tuple[Column, str | Column]] = []
    for c in required:
        checks.append((is_blank(F.col(c)), f"{c}: required non-blank string"))
    for c in optional:
        checks.append((F.col(c).isNotNull() & is_blank(F.col(c)), f"{c}: blank string"))
    if status:
        ok = F.upper(strip(F.col(status))).isin(*STATUSES)
        checks.append((F.col(status).isNotNull() & ~ok, f"{status}: not in vocabulary"))
    if seats_column:
        checks.append((F.col(seats_column) < 0, f"{seats_column}: must be >= 0"))
    return reasons(*checks)


RAW_COLUMNS = (
    "jobtitle", "company", "joblocation_address", "industry", "jobdescription", "postdate",
    "jobid", "uniq_id", "numberofpositions", "skills",
)


def normalize_raw_rows(
    raw: DataFrame, source_id: str | Column, retrieved_at: Column, repeated: bool = False
) -> DataFrame:
    """Raw posting rows to observations: flags, reasons, ``accepted``, identity and location.

    Rejected rows keep their raw columns and reasons; their identity and parsed fields are null.
    ``repeated`` says that location texts stand in many rows and the location is used: each distinct
    text is then read once, if these are few.
    """
    source = F.lit(source_id) if isinstance(source_id, str) else source_id
    parsed = raw.withColumns(
        {
            "_source": source,
            "_date": posting_date(F.col("postdate")),
            "_seats": seats(F.col("numberofpositions")),
            "_location_text": blank_to_null(F.col("joblocation_address")),
        }
    )
    no_title = is_blank(F.col("jobtitle"))
    bad_date, bad_seats = F.col("_date.malformed"), F.col("_seats.malformed")
    flagged = parsed.withColumns(
        {
            "missing_title": no_title,
            "missing_company": is_blank(F.col("company")),
            "missing_location": F.col("_location_text").isNull(),
            "malformed_date": bad_date,
            "malformed_seats": bad_seats,
            "reject_reasons": reasons(
                (no_title, "Missing job title"),
                (bad_date, F.concat(F.lit("Malformed postdate: "), F.col("postdate"))),
                (bad_seats,
                 F.concat(F.lit("Malformed numberofpositions: "), F.col("numberofpositions"))),
            ),
        }
    ).withColumn("accepted", F.size("reject_reasons") == 0)
    if repeated:
        located = once_per_text(
            flagged, ["_location_text"], lambda rows: with_city_location(rows, "_location_text"))
    else:
        located = with_city_location(flagged, "_location_text")
    ok = F.col("accepted")

    def accepted(c: Column) -> Column:
        return F.when(ok, c)

    record = F.coalesce(blank_to_null(F.col("jobid")), blank_to_null(F.col("uniq_id")))
    flags = ("missing_title", "missing_company", "missing_location", "malformed_date",
             "malformed_seats", "reject_reasons", "accepted")
    observed = located.select(
        *raw.columns, *flags,
        accepted(F.col("_source")).alias("source_id"),
        accepted(record).alias("source_record_id"),
        accepted(strip(F.col("jobtitle"))).alias("job_title"),
        accepted(blank_to_null(F.col("company"))).alias("employer_name"),
        accepted(F.col("_location_text")).alias("location_text"),
        accepted(F.col("location.district")).alias("district"),
        accepted(F.col("location.state")).alias("state"),
        accepted(blank_to_null(F.col("industry"))).alias("sector"),
        accepted(blank_to_null(F.col("jobdescription"))).alias("description"),
        accepted(F.col("_date.value")).alias("posted_date"),
        accepted(F.col("_seats.value")).alias("seats"),
        accepted(retrieved_at).alias("retrieved_at"),
        accepted(F.lit("ACTIVE")).alias("status"),
        accepted(F.col("location")).alias("location"),
    )
    return observed.withColumn(
        "record_identity_hash",
        F.when(
            ok,
            posting_identity(
                F.col("source_id"), F.col("source_record_id"), F.col("job_title"),
                F.col("employer_name"), F.col("location_text"), F.col("posted_date"),
            ),
        ),
    )


def adapter_profile(normalized: DataFrame) -> DataFrame:
    """One row of adapter counters."""
    flags = ("missing_title", "missing_company", "missing_location", "malformed_date",
             "malformed_seats")
    pune = F.col("location.has_pune_evidence")
    how = F.col("location.pune_exclusivity")
    return normalized.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if("accepted").alias("normalized_rows"),
        F.count_if(~F.col("accepted")).alias("rejected_rows"),
        (F.count("record_identity_hash") - F.countDistinct("record_identity_hash"))
        .alias("duplicate_identity_count"),
        *[F.count_if(f).alias(f"{f}_count") for f in flags],
        *[F.count_if(pune & (how == v)).alias(f"pune_{v.lower()}_count")
          for v in ("EXCLUSIVE", "SHARED", "MENTIONED")],
        F.count_if(pune).alias("pune_total_evidence_count"),
    )


def reason_tally(df: DataFrame, column: str = "reject_reasons") -> DataFrame:
    """How often each single reason occurs."""
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def combined_reason_tally(df: DataFrame, column: str = "validation_errors") -> DataFrame:
    """Rejected rows per sorted combination of reasons."""
    return (
        df.where(F.size(column) > 0)
        .groupBy(F.array_join(F.array_sort(column), "; ").alias("reasons"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
