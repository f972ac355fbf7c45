"""Row filters shared by the analyses: source, district, sector and date window."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, strip
from ..sources.seeds import SECTOR_ALIASES


def sector_values(label: str | None) -> list[str] | None:
    """Sector label to the values stored in postings; unknown labels pass through."""
    if not label:
        return None
    return list(SECTOR_ALIASES.get(label, (label,)))


def district_key(c: Column) -> Column:
    """Lower-cased, trimmed district; null when blank."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def in_window(ts: Column, start: date | str | None, end: date | str | None) -> Column:
    """Whole days from ``start`` through ``end``; a half-open range keeps pushdown possible."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= F.lit(str(start)).cast("date"))
    if end is not None:
        keep = keep & (ts < F.date_add(F.lit(str(end)).cast("date"), 1))
    return keep


def observation_scope(
    df: DataFrame,
    source_id: str | None = None,
    district: str | None = None,
    sector: str | list[str] | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    exact_district: bool = False,
    time_column: str = "retrieved_at",
) -> DataFrame:
    if source_id:
        df = df.where(F.col("source_id") == source_id)
    if district:
        df = df.where(
            F.col("district") == district if exact_district
            else district_key(F.col("district")) == district.strip().lower()
        )
    if sector:
        df = df.where(F.col("sector").isin(sector if isinstance(sector, list) else [sector]))
    if start is not None or end is not None:
        df = df.where(in_window(F.col(time_column), start, end))
    return df


def disposition(district: Column, sector: Column, mapped: Column) -> Column:
    """Where an observation goes: the first failing requirement, or mapped / unmapped."""
    return (
        F.when(is_blank(district), "UNKNOWN_DISTRICT")
        .when(is_blank(sector), "UNKNOWN_SECTOR")
        .when(mapped, "MAPPED")
        .otherwise("UNMAPPED")
    )
