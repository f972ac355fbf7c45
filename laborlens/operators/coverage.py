"""Ontology coverage before and after a change, and checks of the ontology itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compare_skills(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer comparison of two per-skill summaries with a coverage status.

    Both sides need ``skill_id, skill_name, distinct_job_count, mention_count``.
    """
    b = before.select(
        "skill_id", F.col("skill_name").alias("b_name"),
        F.col("distinct_job_count").alias("b_jobs"), F.col("mention_count").alias("b_mentions"),
    )
    a = after.select(
        "skill_id", F.col("skill_name").alias("a_name"),
        F.col("distinct_job_count").alias("a_jobs"), F.col("mention_count").alias("a_mentions"),
    )
    zero = F.lit(0)
    was, now = F.coalesce("b_jobs", zero), F.coalesce("a_jobs", zero)
    return (
        b.join(a, "skill_id", "full")
        .select(
            "skill_id", F.coalesce("a_name", "b_name").alias("skill_name"),
            was.alias("before_job_count"), now.alias("after_job_count"),
            F.coalesce("b_mentions", zero).alias("before_mention_count"),
            F.coalesce("a_mentions", zero).alias("after_mention_count"),
            F.when((was == 0) & (now > 0), "NEWLY_COVERED")
            .when((was > 0) & (now == 0), "LOST_COVERAGE")
            .when(now == 0, "NEVER_OBSERVED").otherwise("COVERED").alias("coverage_status"),
        )
        .orderBy(F.desc("after_job_count"), "skill_id")
    )


def absorbed_candidates(before: DataFrame, after: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates that disappeared because they are now a known phrase."""
    gone = before.select("candidate_skill").join(
        after.select("candidate_skill"), "candidate_skill", "left_anti"
    )
    return gone.join(
        phrases.select(F.col("phrase").alias("candidate_skill")), "candidate_skill", "left_semi"
    ).distinct()


def coverage_metrics(
    before: DataFrame, after: DataFrame, before_corpus: DataFrame, after_corpus: DataFrame
) -> DataFrame:
    """Long form (metric, before, after, delta, pct_change) of two runs.

    ``matched_mentions`` counts all evidence; ``text_matched_mentions`` only title and
    description evidence.  Both readings exist in reports, so both are named.
    """
    def skills(summary: DataFrame, side: str) -> DataFrame:
        return summary.agg(
            F.count(F.lit(1)).alias("canonical_seed_count"),
            F.count_if(F.col("distinct_job_count") > 0).alias("skills_with_evidence"),
        ).select(F.struct("*").alias(side))

    def long(summary: DataFrame, corpus: DataFrame, side: str) -> DataFrame:
        row = skills(summary, "s").crossJoin(corpus.select(F.struct("*").alias("c")))
        c, s = F.col("c"), F.col("s")
        measures = {
            "canonical_seed_count": s["canonical_seed_count"],
            "skills_with_evidence": s["skills_with_evidence"],
            "jobs_processed": c["jobs_processed"],
            "total_evidence_rows": c["total_evidence_rows"],
            "jobs_with_skill_evidence": c["jobs_with_skill_evidence"],
            "matched_mentions": c["total_evidence_rows"],
            "text_matched_mentions": c["text_matched_mentions"],
            "unmatched_mentions": c["unmatched_mentions"],
            "total_mentions_observed": c["total_evidence_rows"] + c["unmatched_mentions"],
            "mention_confidence_high": c["high_confidence"],
            "mention_confidence_medium": c["medium_confidence"],
        }
        return row.select(
            F.inline(
                F.array(
                    *[F.struct(F.lit(n).alias("metric"), v.cast("bigint").alias(side))
                      for n, v in measures.items()]
                )
            )
        )

    delta = F.col("after") - F.col("before")
    return (
        long(before, before_corpus, "before").join(long(after, after_corpus, "after"), "metric")
        .select(
            "metric", "before", "after", delta.alias("delta"),
            F.bround(100.0 * delta / F.greatest(F.col("before"), F.lit(1)), 2)
            .alias("pct_change"),
        )
    )


def evidence_coverage(summary: DataFrame) -> DataFrame:
    """One row: skills with evidence out of all skills, in percent with one digit."""
    return summary.agg(
        F.count_if(F.col("distinct_job_count") > 0).alias("skills_with_evidence"),
        F.count(F.lit(1)).alias("canonical_seed_count"),
    ).withColumn(
        "coverage_pct",
        F.bround(100.0 * F.col("skills_with_evidence") / F.col("canonical_seed_count"), 1),
    )


# --- ontology checks ---------------------------------------------------------------------

def _errors(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    return df.where(bad).select(message.alias("error"))


def _text(*parts: str | Column) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("None")) for p in parts]
    )


def ontology_errors(
    entities: DataFrame, mappings: DataFrame, id_column: str, label: str,
    name_column: str | None = None,
) -> DataFrame:
    """One row per violated rule of an ontology and its trade bridge.

    ``entities`` needs the id and ``verification_status``; ``mappings`` needs ``trade``, the
    id, ``mapping_status`` and ``evidence_source``.
    """
    eid, trade = F.col(id_column), F.col("trade")
    blank_id = F.coalesce(eid, F.lit("")) == ""
    status = F.col("verification_status")
    lower = label.lower()
    found = [
        _errors(entities, blank_id, F.lit(f"{label} missing {id_column}")),
        _repeats(entities.where(~blank_id), [id_column]).select(
            _text(f"Duplicate {id_column} found: ", eid).alias("error")),
        _errors(entities, status == "VERIFIED",
                _text(f"{label} ", eid, " marked VERIFIED without inspected document evidence")),
        _repeats(mappings, ["trade", id_column]).select(
            _text("Duplicate mapping found for trade ", trade, f" and {lower} ", eid)
            .alias("error")),
        _errors(mappings, F.coalesce("evidence_source", F.lit("")) == "",
                _text("Mapping for ", trade, " missing evidence_source (provenance)")),
        _errors(mappings, ~F.col("mapping_status").eqNullSafe("NEEDS_REVIEW"),
                _text("Mapping status must be NEEDS_REVIEW for ", trade, " -> ", eid,
                      " (found ", F.col("mapping_status"), ")")),
        mappings.join(entities.select(id_column), id_column, "left_anti").select(
            _text(f"Mapping references non-existent {id_column}: ", eid).alias("error")),
    ]
    if name_column:
        found += [
            _errors(entities, F.coalesce(name_column, F.lit("")) == "",
                    _text(f"{label} ", eid, f" missing {name_column}")),
            _errors(entities, F.coalesce(status, F.lit("")) == "",
                    _text(f"{label} ", eid, " missing verification_status")),
            _errors(mappings, F.coalesce(trade, F.lit("")) == "",
                    F.lit("Mapping missing canonical_trade_name")),
            _errors(mappings, F.coalesce(eid, F.lit("")) == "",
                    _text("Mapping for trade ", trade, f" missing {id_column}")),
        ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per repetition (n - 1 rows for n copies)."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .withColumn("again", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    )
