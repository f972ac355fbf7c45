"""Source registry rules: eligibility to ingest, derived policies, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Authorisations under which ingestion is allowed.
PERMITTED = (
    "AUTHORIZED_API", "AUTHORIZED_FEED", "LICENSED_DATA", "PERMITTED_PUBLIC_CRAWL",
    "USER_PROVIDED_DATA", "PARTNER_WEBHOOK",
)


def _quoted(prefix: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("source_id"), F.lit(suffix))


def with_eligibility(policies: DataFrame) -> DataFrame:
    """Add ``eligible``, ``action`` and ``reason``; the first violated rule decides."""
    disabled = ~F.col("enabled")
    barred = ~F.col("authorization_status").isin(*PERMITTED)
    robots = F.col("robots_status") == "DISALLOWED"
    closed = ~F.col("crawl_allowed") & ~F.col("api_available")
    status = F.concat(
        F.lit("Source '"), F.col("source_id"), F.lit("' authorization status '"),
        F.col("authorization_status"), F.lit("' prohibits automated ingestion."),
    )
    rules = (
        (disabled, "HALT", _quoted("Source '", "' is administratively disabled.")),
        (barred, "REJECT", status),
        (robots, "RESPECT_ROBOTS",
         _quoted("Source '", "' is explicitly DISALLOWED by robots.txt.")),
        (closed, "DENIED",
         _quoted("Source '", "' has neither crawl_allowed=True nor api_available=True.")),
    )
    action = F.lit("PROCEED")
    reason = F.lit("Source meets all governance criteria.")
    for broken, name, text in reversed(rules):
        action = F.when(broken, name).otherwise(action)
        reason = F.when(broken, text).otherwise(reason)
    return policies.withColumns({"action": action, "reason": reason}).withColumn(
        "eligible", F.col("action") == "PROCEED"
    )


def policies_from_registry(sources: DataFrame) -> DataFrame:
    """Policy columns used at ingestion time."""
    verified = F.upper(F.coalesce("verification_status", F.lit("")))
    access = F.col("access_method")
    return sources.select(
        "source_id", "source_name", F.coalesce("url", F.lit("")).alias("base_url"),
        "access_method",
        F.when(verified == "VERIFIED", "AUTHORIZED_API")
        .when(verified == "PERMITTED", "PERMITTED_PUBLIC_CRAWL").otherwise("UNKNOWN")
        .alias("authorization_status"),
        F.lit("RESPECTED").alias("robots_status"),
        access.isin("VERIFIED_API", "REST_API").alias("api_available"),
        (~access.isin("SOURCE_SNAPSHOT", "MANUAL_CURATION")).alias("crawl_allowed"),
        F.when(F.col("official_government_source"), 1).otherwise(2).alias("source_priority"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
    )


def listed_policies(sources: DataFrame) -> DataFrame:
    """Policy columns of the registry listing, which derives authorisation from access."""
    return sources.select(
        "source_id", "source_name", F.coalesce("url", F.lit("")).alias("base_url"),
        F.col("category").alias("source_category"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "access_method",
        F.when(F.col("access_method").isin("VERIFIED_API", "VERIFIED_EXPORT"), "AUTHORIZED_API")
        .otherwise("PERMITTED_PUBLIC_CRAWL").alias("authorization_status"),
        F.lit("ALLOWED").alias("robots_status"),
        F.coalesce("enabled", F.lit(False)).alias("enabled"),
    ).orderBy("source_id")


def source_health(sources: DataFrame) -> DataFrame:
    return sources.select(
        "source_id", "source_name",
        F.when(F.contains(F.col("reliability_notes"), F.lit("Last FAIL")), "OFFLINE")
        .when(F.col("last_fetched_at").isNotNull(), "ONLINE").otherwise("NEVER_FETCHED")
        .alias("status"),
        "last_fetched_at", "freshness_class", "reliability_notes",
    ).orderBy("source_id")


def health_from_telemetry(fetches: DataFrame) -> DataFrame:
    """Latest status and last success per source from a table of fetch results."""
    good = F.col("status").isin("ONLINE", "DEGRADED")
    return fetches.groupBy("source_id").agg(
        F.max_by("status", "fetched_at").alias("status"),
        F.max(F.when(good, F.col("fetched_at"))).alias("last_success"),
        F.max(F.when(~good, F.col("fetched_at"))).alias("last_failure"),
        F.count(F.lit(1)).alias("fetches"),
    )


def latest_fetch(sources: DataFrame) -> DataFrame:
    return sources.agg(F.max("last_fetched_at").alias("last_fetched_at"))


def online_summary(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count_if(F.col("status") == "ONLINE").alias("sources_online"),
        F.count(F.lit(1)).alias("sources_total"),
    )


def gate(records: DataFrame, policies: DataFrame) -> DataFrame:
    """Records with the ``action`` of their source; unknown sources are UNGOVERNED."""
    actions = with_eligibility(policies).select("source_id", "action", "eligible")
    return records.join(actions, "source_id", "left").fillna(
        {"action": "UNGOVERNED", "eligible": False}
    )


def decision(policies: DataFrame, source_id: str) -> tuple[str, bool]:
    """(action, eligible) of one source, read from its one policy row before any feed is read."""
    row = with_eligibility(policies).where(F.col("source_id") == source_id).select(
        "action", "eligible").first()
    return (row["action"], row["eligible"]) if row else ("UNGOVERNED", False)


def sources_to_register(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources whose id is not registered yet; registering again adds nothing."""
    return incoming.dropDuplicates(["source_id"]).join(
        registry.select("source_id"), "source_id", "left_anti"
    )
