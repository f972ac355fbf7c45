"""Work that depends on texts alone, done once per distinct text.

Postings are published again and again, and one text stands in many of them.  Scanning a text costs
far more than grouping it: copies are counted in the task that reads them, before any exchange, so
that only distinct texts are sent on.  Where all texts differ, each is sent once and memory stays
bounded, as the aggregate spills.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

COPIES = "copies"
# Texts that are few enough to be sent to every task with what was found in them.
MOST_TEXTS, MOST_CHARACTERS = 50_000, 8 << 20
TEXT_FIELDS = {"title": "job_title", "description": "description", "source_skills": "source_skills"}


def distinct_texts(rows: DataFrame, columns: dict[str, str | None], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, names of `columns`, copies): the distinct texts and how many rows hold each.

    ``columns`` names the source column of each text; a text without a source is left out.
    """
    kept = [F.col(source).alias(name) for name, source in columns.items() if source]
    return rows.groupBy(*by, *kept).agg(F.count(F.lit(1)).alias(COPIES))


def few_texts(rows: DataFrame, columns: list[str]) -> DataFrame | None:
    """The distinct combinations of ``columns``, or None if they are too many to be sent to all tasks.

    Rows are read once, copies are dropped before the exchange; only one combination more than allowed
    is kept to find out.
    """
    texts = cut_lineage(rows.select(*columns).distinct().limit(MOST_TEXTS + 1))
    length = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    n, characters = texts.agg(F.count(F.lit(1)), F.sum(length)).first()
    if n > MOST_TEXTS or (characters or 0) > MOST_CHARACTERS:
        return None
    return texts.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def with_known(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the further columns of ``known``, made of `few_texts`; nulls are texts like others."""
    names = {c: f"_known_{k}" for k, c in enumerate(columns)}
    small = known.select(*[F.col(c).alias(names[c]) if c in names else c for c in known.columns])
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(small[k]) for c, k in names.items()])
    return rows.join(F.broadcast(small), same).drop(*names.values())


def once_per_text(
    rows: DataFrame, columns: list[str], worked: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``worked(rows)``, where the columns that ``worked`` adds depend on ``columns`` alone.

    If the distinct texts are few, they are worked and the rows take over what was found; the rows
    are then read twice and not exchanged.  If not, each row is worked on its own.
    """
    texts = few_texts(rows, columns)
    return worked(rows) if texts is None else with_known(rows, worked(texts), columns)
