"""Small scoring and labelling rules, thresholds as arguments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Status vocabularies in report order.
GAP_ORDER = ("HIGH_GAP", "MEDIUM_GAP", "NEEDS_REVIEW", "LOW_GAP", "NO_DATA")


def share(part: Column, whole: Column, digits: int) -> Column:
    """Half-even rounded ratio, null when the whole is zero."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def gap_class(
    jobs: Column, job_share: Column, has_supply: Column, total_jobs: Column,
    high: float = 0.05, medium: float = 0.01,
) -> Column:
    return (
        F.when(has_supply, "NEEDS_REVIEW")
        .when((jobs == 0) | (total_jobs == 0), "NO_DATA")
        .when(job_share >= high, "HIGH_GAP")
        .when(job_share >= medium, "MEDIUM_GAP")
        .otherwise("LOW_GAP")
    )


def gap_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in GAP_ORDER]), status)


def velocity_label(
    current: Column, previous: Column,
    minimum: int = 3, rising: float = 0.25, falling: float = 0.20,
) -> Column:
    change = (current - previous) / F.nullif(previous, F.lit(0))
    return (
        F.when((current < minimum) | (previous < minimum), "INSUFFICIENT_DATA")
        .when(change >= rising, "RISING")
        .when(change <= -falling, "FALLING")
        .otherwise("STABLE")
    )


def window_freshness(current_total: Column, previous_total: Column) -> Column:
    return (
        F.when((current_total == 0) & (previous_total == 0), "NO_DATA")
        .when(previous_total == 0, "NEW_WINDOW")
        .otherwise("PERIODIC")
    )


def completeness(total: Column) -> Column:
    return F.when(total == 0, "NO_DATA").otherwise("INSUFFICIENT_DATA")


def coverage_severity(percent: Column) -> Column:
    return F.when(percent < 50, "HIGH").when(percent < 80, "MEDIUM").otherwise("LOW")
