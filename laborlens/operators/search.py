"""Keyword retrieval over postings, skill evidence and demand rows; listings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import keyword_hit, like_contains, query_tokens, snippet
from .scope import observation_scope
from .skills import SkillDictionary, evidence_rows, extract_repeated

POSTING_SCORE, DEMAND_SCORE = 0.5, 0.3  # fixed values
_TYPE_RANK = {"JOB_POSTING": 1, "SKILL_EVIDENCE": 2, "DISTRICT_OCCUPATION_DEMAND": 3}


def _rank() -> Column:
    order = F.lit(9)
    for name, rank in _TYPE_RANK.items():
        order = F.when(F.col("record_type") == name, rank).otherwise(order)
    return order


def _capped(records: DataFrame, limit: int | None) -> DataFrame:
    """Best types first, then record id; the cap is applied after all filtering."""
    ordered = records.orderBy(_rank(), "record_id", "title")
    return ordered if limit is None else ordered.limit(limit)


def _demand_records(demand: DataFrame, tokens: list[str]) -> DataFrame:
    return demand.where(
        keyword_hit(tokens, F.col("district"), F.col("occupation_id"), F.col("id"))
    ).select(
        F.lit("DISTRICT_OCCUPATION_DEMAND").alias("record_type"),
        F.col("id").alias("record_id"),
        F.concat_ws(" — ", "district", "occupation_id").alias("title"),
        F.concat(
            F.lit("job_count="), F.col("job_count"), F.lit(", apprenticeship_count="),
            F.col("apprenticeship_count"),
        ).alias("snippet"),
        "district",
        F.lit(None).cast("string").alias("source_id"),
        F.concat_ws(
            " to ", F.col("observation_period_start").cast("string"),
            F.col("observation_period_end").cast("string"),
        ).alias("observation_period"),
        F.lit(DEMAND_SCORE).alias("score"),
    )


def _posting_records(postings: DataFrame, tokens: list[str], size: int) -> DataFrame:
    return postings.where(keyword_hit(tokens, F.col("job_title"), F.col("description"))).select(
        F.lit("JOB_POSTING").alias("record_type"),
        F.col("posting_id").alias("record_id"),
        F.col("job_title").alias("title"),
        snippet(F.col("description"), size).alias("snippet"),
        "district", "source_id",
        F.to_date("retrieved_at").cast("string").alias("observation_period"),
        F.lit(POSTING_SCORE).alias("score"),
    )


def keyword_search(
    postings: DataFrame, demand: DataFrame | None, query: str, limit: int | None = 20,
    snippet_size: int = 200, **scope,
) -> DataFrame:
    """Postings (and demand rows) that contain any token of the query.

    Everything that matches is ranked before the limit; a query without tokens finds nothing.
    """
    tokens = query_tokens(query)
    found = _posting_records(
        observation_scope(postings, exact_district=True, **scope), tokens, snippet_size
    )
    if demand is not None:
        rows = demand
        if scope.get("district"):
            rows = rows.where(F.col("district") == scope["district"])
        found = found.unionByName(_demand_records(rows, tokens))
    return _capped(found, limit)


def retrieve(
    postings: DataFrame, demand: DataFrame, dictionary: SkillDictionary, query: str,
    limit: int | None = 20, **scope,
) -> DataFrame:
    """Union of matching postings, their skill evidence, and demand rows."""
    tokens = query_tokens(query)
    scoped = observation_scope(postings, exact_district=True, **scope)
    keep = ("posting_id", "district", "source_id")
    evidence = (
        evidence_rows(extract_repeated(scoped, dictionary, keep=keep), keep)
        .where(
            keyword_hit(
                tokens, F.col("canonical_skill_name"), F.col("source_skill_text"),
                F.col("evidence_text"),
            )
        )
        .select(
            F.lit("SKILL_EVIDENCE").alias("record_type"),
            F.col("posting_id").alias("record_id"),
            F.col("canonical_skill_name").alias("title"),
            snippet(F.col("evidence_text"), 300).alias("snippet"),
            "district", "source_id",
            F.lit(None).cast("string").alias("observation_period"),
            F.lit(POSTING_SCORE).alias("score"),
        )
    )
    if scope.get("district"):
        demand = demand.where(F.lower("district") == scope["district"].lower())
    return _capped(
        _posting_records(scoped, tokens, 300).unionByName(evidence)
        .unionByName(_demand_records(demand, tokens)),
        limit,
    )


def record_type_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("record_type").agg(F.count(F.lit(1)).alias("records"))


def _matching(postings: DataFrame, title_contains: str | None, scope: dict) -> DataFrame:
    rows = observation_scope(postings, exact_district=True, **scope)
    if title_contains:
        rows = rows.where(like_contains(F.col("job_title"), title_contains))
    return rows


def page_of_postings(
    postings: DataFrame, title_contains: str | None = None, limit: int = 50, offset: int = 0,
    **scope,
) -> DataFrame:
    """A page of postings, newest first, ids breaking ties."""
    rows = _matching(postings, title_contains, scope)
    return rows.orderBy(F.desc("retrieved_at"), "posting_id").offset(offset).limit(limit)


# Spans of time that a page is looked for in, each divided by the next; the counts of one step are
# at most the days of the data, then 24, 60 and 60.
SPANS = ("day", "hour", "minute", "second")
FEW_ROWS = 100_000


def deep_page(
    postings: DataFrame, title_contains: str | None = None, limit: int = 50, offset: int = 0,
    few: int = FEW_ROWS, **scope,
) -> DataFrame:
    """``page_of_postings`` for any offset, without sorting what lies before the page.

    Counts per day tell in which days the page lies; days with more than ``few`` rows before it are
    divided into hours, minutes and seconds.  Only rows of those spans are then read, by a filter
    that reaches the scan, and the first of them are taken.
    """
    rows = _matching(postings, title_contains, scope)
    at = F.col("retrieved_at")
    inside, skip = F.lit(True), offset
    for span in SPANS:
        counts = rows.where(inside).groupBy(F.date_trunc(span, at).alias("t")).count().orderBy(
            F.desc("t")).collect()
        found, before = [], 0
        for r in counts:
            if before + r["count"] > skip and before < skip + limit:
                found.append((r["t"], r["count"], before))
            before += r["count"]
        if not found:
            return rows.where(F.lit(False))
        skip -= found[0][2]
        first, last = found[0][0], found[-1][0]
        if last is None:  # rows without a time come last
            inside = inside & (at.isNull() if first is None
                               else at.isNull() | (at < F.lit(first) + F.expr(f"INTERVAL 1 {span}")))
            if first is not None:
                break
        else:
            inside = inside & (at >= F.lit(last)) & (at < F.lit(first) + F.expr(f"INTERVAL 1 {span}"))
        if len(found) > 1 or found[0][1] <= few or first is None:
            break
    return (rows.where(inside).orderBy(F.desc("retrieved_at"), "posting_id")
            .offset(skip).limit(limit))


def page_total(postings: DataFrame, title_contains: str | None = None, **scope) -> DataFrame:
    """One row: how many postings all pages together have."""
    return _matching(postings, title_contains, scope).agg(F.count(F.lit(1)).alias("total"))


def staging_list(
    staging: DataFrame, status: str | None = None, source_id: str | None = None, limit: int = 20
) -> DataFrame:
    if status:
        staging = staging.where(F.col("processing_status") == status)
    if source_id:
        staging = staging.where(F.col("source_id") == source_id)
    return staging.orderBy(F.desc("staging_id")).limit(limit)
