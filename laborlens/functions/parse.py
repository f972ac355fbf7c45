"""Parsers for dates, seats, salaries and experience; every failure is a flag, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind, blank_to_null, strip

# The accepted posting-date layouts (date, optional time, optional offset).
_HMS = r"\s+(?:2[0-3]|[01]?\d):[0-5]?\d:(?:6[01]|[0-5]?\d)"
_OFFSET = r"\s+(?:[+-]\d{2}:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|Z)"
POSTING_DATE = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:{_HMS}(?:{_OFFSET})?)?$"
FLOAT_TEXT = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
NUMBER = r"\d+(?:\.\d+)?"


def _date_or_null(text: Column) -> Column:
    return text.try_cast("date")


def posting_date(c: Column) -> Column:
    """``struct(value date, malformed boolean)``.

    The calendar date *as written* is kept: going through a timestamp would shift it by the
    offset.  Blank is not malformed.
    """

    def parsed(text: Column) -> Column:
        day = F.when(
            text.rlike(POSTING_DATE), _date_or_null(F.regexp_extract(text, r"^[\d-]+", 0))
        )
        return F.struct(
            day.alias("value"), (text.isNotNull() & day.isNull()).alias("malformed")
        )

    return bind(blank_to_null(c), parsed)


def flexible_date(c: Column) -> Column:
    """Year-first or day-first with dashes or slashes; null when none fits."""

    def parsed(text: Column) -> Column:
        year_first = text.rlike(r"^\d{4}(?:-\d{1,2}-|/\d{1,2}/)\d{1,2}$")
        day_first = text.rlike(r"^\d{1,2}(?:-\d{1,2}-|/\d{1,2}/)\d{4}$")
        parts = F.split(text, "[-/]")
        return (
            F.when(year_first, _date_or_null(F.array_join(parts, "-")))
            .when(day_first, _date_or_null(F.array_join(F.reverse(parts), "-")))
        )

    return bind(strip(c), parsed)


def iso_date(c: Column) -> Column:
    """``struct(value, malformed)`` for the ISO layout only; malformed never becomes today."""

    def parsed(text: Column) -> Column:
        day = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _date_or_null(text))
        return F.struct(
            day.alias("value"),
            (text.isNotNull() & (text != "") & day.isNull()).alias("malformed"),
        )

    return bind(c, parsed)


def seats(c: Column) -> Column:
    """``struct(value long, malformed boolean)``: truncated towards zero, negative is malformed."""

    def parsed(text: Column) -> Column:
        number = F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
        value = F.when(number >= 0, number.try_cast("bigint"))
        return F.struct(
            value.alias("value"), (text.isNotNull() & value.isNull()).alias("malformed")
        )

    return bind(blank_to_null(c), parsed)


SALARY = "decimal(38,10)"  # 28 digits before the point; longer numbers are flagged
YEARS = "bigint"


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def _numbers(text: Column) -> Column:
    return F.transform(_found(text), lambda n: n.try_cast(SALARY))


def _oversized(found: Column, kind: str) -> Column:
    return F.coalesce(F.exists(found, lambda n: n.try_cast(kind).isNull()), F.lit(False))


def _plain_salary(c: Column) -> Column:
    for noise in (",", "₹", "Rs."):  # fixed values
        c = F.replace(c, F.lit(noise), F.lit(""))
    return c


def oversized_salary(c: Column) -> Column:
    """Whether a number is too long to be read, so that the parsed value lacks it."""
    return _oversized(_found(_plain_salary(c)), SALARY)


def oversized_experience(c: Column) -> Column:
    return _oversized(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), YEARS)


def salary_first_two(c: Column) -> Column:
    """``struct(low, high)``: the first two numbers, or one number twice."""
    return bind(
        _numbers(_plain_salary(c)),
        lambda n: F.struct(
            F.get(n, F.lit(0)).alias("low"),
            F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0))).alias("high"),
        ),
    )


def salary_range(c: Column) -> Column:
    """``struct(low, high, currency)``: smallest and largest of all numbers."""
    cleaned = c
    for noise in ("₹", ",", "PA", "per annum", " annum"):  # fixed values
        cleaned = F.replace(cleaned, F.lit(noise), F.lit(""))
    return bind(
        _numbers(cleaned),
        lambda n: F.struct(
            F.array_min(n).alias("low"),
            F.array_max(n).alias("high"),
            F.when(c != "", F.lit("INR")).alias("currency"),
        ),
    )


def experience_first_two(c: Column) -> Column:
    """``struct(low, high)``: the first two integers, or one twice."""
    found = F.transform(
        F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast(YEARS)
    )
    return bind(
        found,
        lambda n: F.struct(
            F.get(n, F.lit(0)).alias("low"),
            F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0))).alias("high"),
        ),
    )


def experience_range(c: Column) -> Column:
    """``struct(low, high)``: ``n+`` is open ended, ``a-b`` a range, a bare number both ends."""

    def group(text: Column, pattern: str, index: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, index), F.lit("")).try_cast(YEARS)

    def parsed(text: Column) -> Column:
        open_ended = group(text, r"^(\d+)\+", 1)
        low = group(text, r"^(\d+)\s*[-–]\s*(\d+)", 1)
        high = group(text, r"^(\d+)\s*[-–]\s*(\d+)", 2)
        single = group(text, r"^([+-]?\d+)$", 1)
        return F.struct(
            F.coalesce(open_ended, low, single).alias("low"),
            F.when(open_ended.isNull(), F.coalesce(high, single)).alias("high"),
        )

    return bind(strip(F.regexp_replace(F.lower(c), "years?|yrs?", "")), parsed)
