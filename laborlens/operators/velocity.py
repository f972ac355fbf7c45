"""Change of skill demand between two observation windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scoring import share, velocity_label, window_freshness
from .scope import in_window, observation_scope
from .skills import SkillDictionary, extract_skills


def skill_velocity(
    postings: DataFrame,
    dictionary: SkillDictionary,
    current: tuple[str, str],
    previous: tuple[str, str],
    source_id: str | None = None,
    district: str | None = None,
    sector: str | list[str] | None = None,
    exact_district: bool = False,
    minimum: int = 3,
    rising: float = 0.25,
    falling: float = 0.20,
    **fields: str | None,
) -> DataFrame:
    """Per skill: distinct postings in each window, shares, relative change and label.

    Both windows are read in one scan and counted side by side.  Shares are of all
    (skill, posting) pairs of the window, as the source system defines them; the number of
    distinct postings with evidence stands next to those totals.
    """
    ts = F.col("retrieved_at")
    scoped = observation_scope(postings, source_id, district, sector, None, None, exact_district)
    in_cur, in_prev = in_window(ts, *current), in_window(ts, *previous)
    marked = scoped.where(in_cur | in_prev).withColumns(
        {"in_current": in_cur, "in_previous": in_prev}
    )
    rows = extract_skills(
        marked, dictionary, keep=("in_current", "in_previous"), snippets=False, **fields
    ).select("in_current", "in_previous", F.posexplode("evidence").alias("pos", "e"))
    first = F.col("e.first_for_job")
    counts = rows.groupBy(F.col("e.canonical_skill_id").alias("skill_id")).agg(
        F.count_if(first & F.col("in_current")).alias("cur"),
        F.count_if(first & F.col("in_previous")).alias("prev"),
        F.count_if((F.col("pos") == 0) & F.col("in_current")).alias("cur_jobs"),
        F.count_if((F.col("pos") == 0) & F.col("in_previous")).alias("prev_jobs"),
    )
    everything = Window.partitionBy(F.lit(0))  # one row per skill with evidence
    totals = {
        "total_window_mentions": "cur", "total_previous_mentions": "prev",
        "window_jobs_with_evidence": "cur_jobs", "previous_jobs_with_evidence": "prev_jobs",
    }
    cur, prev = F.col("cur"), F.col("prev")
    return (
        counts.withColumns({name: F.sum(c).over(everything) for name, c in totals.items()})
        .select(
            "skill_id",
            cur.alias("window_distinct_jobs"),
            prev.alias("previous_distinct_jobs"),
            share(cur, F.col("total_window_mentions"), 4).alias("window_job_share"),
            share(prev, F.col("total_previous_mentions"), 4).alias("previous_job_share"),
            share(cur - prev, prev, 4).alias("relative_delta"),
            velocity_label(cur, prev, minimum, rising, falling).alias("velocity"),
            *totals,
            window_freshness(
                F.col("total_window_mentions"), F.col("total_previous_mentions")
            ).alias("freshness"),
        )
        .orderBy("skill_id")
    )
