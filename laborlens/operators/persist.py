"""Idempotent persistence of facts and relationships, and its accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.identity import apprenticeship_identity, packed, unpacked

IDENTITY = "record_identity_hash"


def first_per_key(df: DataFrame, key: str = IDENTITY, ordinal: str = "ordinal") -> DataFrame:
    """The earliest row of each key.

    ``row_number() = 1`` is pruned on the map side (one row per key and task survives), so a
    hot key is never sorted whole in one place.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_present(
    df: DataFrame, values: dict[str, Column], key: str = IDENTITY, ordinal: str = "ordinal"
) -> DataFrame:
    """Per key, the last non-null value of each named expression by ordinal."""
    return df.groupBy(key).agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col(ordinal))).alias(name)
          for name, v in values.items()]
    )


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet; only the stored keys are read."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def postings_to_insert(
    normalized: DataFrame,
    existing: DataFrame,
    source_type: str | None = None,
    freshness_class: str | None = None,
    status_override: str | None = None,
    ordinal: str = "ordinal",
) -> DataFrame:
    """Facts to append: first row per identity, last skills and seats, not yet stored.

    Ids derive from the identity, so a repeated run writes the same rows.
    """
    skills = F.when(F.col("skills") != "", F.btrim("skills"))
    late = last_present(normalized, {"source_skills": skills, "seats": F.col("seats")},
                        ordinal=ordinal)
    first = first_per_key(normalized.drop("seats", "skills"), ordinal=ordinal)
    status = F.lit(status_override) if status_override else F.col("status")
    return new_rows(first.join(late, IDENTITY), existing, [IDENTITY]).select(
        F.substring(IDENTITY, 1, 32).alias("posting_id"), "source_id", "source_record_id",
        "job_title", "employer_name", "location_text", "district", "state", "sector",
        "description", "posted_date", "retrieved_at", IDENTITY, status.alias("status"),
        "source_skills", "seats",
        F.lit(source_type).cast("string").alias("source_type"),
        F.lit(freshness_class).cast("string").alias("freshness_class"),
        F.col("location").alias("geographic_evidence"),
    )


def apprenticeships_to_insert(
    rows: DataFrame, existing: DataFrame, ordinal: str = "ordinal"
) -> DataFrame:
    """Apprenticeship facts to append: first row per identity, not yet stored.

    ``rows`` has source_id, source_record_id, trade_title, organization_name, location_text,
    application_start_date and application_end_date.
    """
    identity = apprenticeship_identity(*[F.col(c) for c in (
        "source_id", "source_record_id", "trade_title", "organization_name", "location_text",
        "application_start_date", "application_end_date")])
    first = first_per_key(rows.withColumn(IDENTITY, identity), ordinal=ordinal)
    return new_rows(first, existing, [IDENTITY])


def ingest_accounting(normalized: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: input, normalised, rejected, inserted, skipped and the invariants.

    ``normalized`` has every raw row with ``accepted`` and, when accepted, the identity.
    """
    key = packed(F.col(IDENTITY)).alias("key")
    per_identity = normalized.select("accepted", key).groupBy("accepted", "key").agg(
        F.count(F.lit(1)).alias("n"))
    stored = existing.select(key).distinct().withColumn("stored", F.lit(True))
    ok, new = F.col("accepted"), F.col("accepted") & F.col("stored").isNull()

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return (
        per_identity.join(stored, "key", "left")
        .agg(
            total(F.col("n")).alias("input_rows"),
            total(F.when(ok, F.col("n"))).alias("normalized_rows"),
            total(F.when(~ok, F.col("n"))).alias("rejected_rows"),
            F.count_if(new).alias("inserted_rows"),
            F.lit(0).cast("bigint").alias("updated_rows"),
            total(F.when(new, F.col("n") - 1).when(ok, F.col("n"))).alias("skipped_rows"),
            F.lit(0).cast("bigint").alias("error_rows"),
        )
        .withColumn(
            "reconciled",
            (F.col("normalized_rows") == F.col("inserted_rows") + F.col("updated_rows")
             + F.col("skipped_rows") + F.col("error_rows"))
            & (F.col("input_rows") == F.col("normalized_rows") + F.col("rejected_rows")),
        )
    )


def _wanted(groups: DataFrame, identity: str) -> DataFrame:
    return groups.select(
        F.btrim(identity).alias(identity),
        F.btrim("classification").alias("relationship_type"),
    ).where(F.col(identity) != "").distinct()


def resolve_relationships(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """Collision groups to (member, type, group) edges by their full identity."""
    facts = postings.select(F.col(IDENTITY).alias("identity_hash"), "posting_id").distinct()
    return _wanted(groups, "identity_hash").join(facts, "identity_hash").select(
        F.col("posting_id").alias("member_record_id"), "relationship_type",
        F.col("identity_hash").alias("group_id"),
    )


def resolve_prefixes(groups: DataFrame, postings: DataFrame, length: int = 16) -> DataFrame:
    """Edges of files that name an identity by its first characters.

    A prefix that several identities share gives a row for each of them, marked `ambiguous`.
    """
    keyed = postings.select(
        F.substring(IDENTITY, 1, length).alias("identity"), packed(F.col(IDENTITY)).alias("key"),
        "posting_id")
    # Joined first: what shares a prefix is then in one place, and only prefixes asked for are there.
    edges = _wanted(groups, "identity").join(keyed, "identity").distinct()
    shared = edges.groupBy("identity").agg(
        (F.min(F.xxhash64("key")) != F.max(F.xxhash64("key"))).alias("ambiguous"))
    return edges.join(shared, "identity").select(
        F.col("posting_id").alias("member_record_id"), "relationship_type",
        unpacked(F.col("key")).alias("group_id"), "ambiguous",
    )


EDGE = ["member_record_id", "group_id", "relationship_type"]


def relationships_to_insert(edges: DataFrame, existing: DataFrame) -> DataFrame:
    fresh = new_rows(edges.dropDuplicates(EDGE), existing, EDGE)
    return fresh.withColumn("relationship_id", F.sha2(F.concat_ws(":", *EDGE), 256))


def unregistered_facts(facts: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Referential check: facts whose parent row is missing, counted per missing key."""
    return (
        facts.join(parents.select(key), key, "left_anti")
        .groupBy(key).agg(F.count(F.lit(1)).alias("orphans"))
    )
