"""Identity collisions: raw rows that share one identity, and what they have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.identity import packed, unpacked
from ..functions.text import blank_to_null, collapse, strip
from ..session import written_once
from .texts import once_per_text

# raw column -> whether it is compared collapsed (True) or only trimmed (False)
COMPARED = {
    "jobid": False, "jobtitle": True, "company": True, "joblocation_address": True,
    "postdate": False, "industry": True, "jobdescription": True, "skills": True,
    "numberofpositions": False,
}
REPEATED = ("jobtitle", "jobdescription", "skills")  # texts that stand in many rows
COUNTED = ("jobtitle", "company", "joblocation_address", "postdate")
SHOWN = {  # fixed values: raw column -> (output column, how many values are shown)
    "jobid": ("jobids", 3), "uniq_id": ("uniq_ids", 3), "jobtitle": ("job_titles", 2),
    "company": ("companies", 2), "joblocation_address": ("locations", 2),
    "postdate": ("post_dates", 2),
}
CLASSES = (
    "TRUE_DUPLICATE", "MULTI_LOCATION_POSTING", "REPOSTING", "SOURCE_DUPLICATE", "UNCERTAIN",
)


def _normal(c: str) -> Column:
    return collapse(F.col(c)) if COMPARED[c] else strip(F.coalesce(F.col(c), F.lit("")))


def _hash(c: str) -> Column:
    return F.nullif(F.xxhash64(_normal(c)), F.xxhash64(F.lit("")))


def _hashed(raw: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and each compared field as a 64-bit hash, null when blank.

    Fields are only compared within an identity.  The texts that cost most are normalised once per
    distinct combination, if these are few.
    """
    def hashes(columns: tuple[str, ...]):
        normal = {c: _normal(c) for c in columns}
        # The hash of a blank is told from others in a step of its own, so that a text is read once.
        blank = F.xxhash64(F.lit(""))
        return lambda rows: rows.withColumns(
            {f"_hash_{c}": F.xxhash64(text) for c, text in normal.items()}).withColumns(
            {f"_hash_{c}": F.nullif(F.col(f"_hash_{c}"), blank) for c in columns})

    others = tuple(c for c in COMPARED if c not in REPEATED)
    rows = hashes(others)(once_per_text(raw, list(REPEATED), hashes(REPEATED)))
    return rows.select(*keep, *[F.col(f"_hash_{c}").alias(c) for c in COMPARED])


def collision_groups(raw: DataFrame, identity: str = "record_identity_hash") -> DataFrame:
    """Every identity with two or more rows, classified, with its reason and confidence.

    Fields are compared by hash, so texts are not shuffled.  "At most one distinct value" is
    smallest equals largest, which combines on the map side, so a group of any size arrives at its
    reducer as one partial row per task.  Exact distinct
    counts are only taken for the few groups whose reason text quotes them.
    """
    return _classified(_hashed(raw, F.col(identity).alias("identity_hash")))


def collision_classes(raw: DataFrame, identity: str = "record_identity_hash") -> DataFrame:
    """The groups of `collision_groups` with their class alone, from one grouping of the rows."""
    several = _bounds(_hashed(raw, F.col(identity).alias("identity_hash"))).where("collision_size > 1")
    return several.withColumn("identity_hash", unpacked(F.col("key"))).select(
        "identity_hash", F.substring("identity_hash", 1, 16).alias("identity"), "classification")


def _bounds(values: DataFrame) -> DataFrame:
    """Per identity, as its packed key: its rows, its class and whether it has one job id.

    All smallest hashes come before all largest, since a row of an identity that stands once then
    repeats a stretch of itself, which an exchange packs away.
    """
    bounds = values.groupBy(packed(F.col("identity_hash")).alias("key")).agg(
        F.count(F.lit(1)).alias("collision_size"),
        *[f(c).alias(f"{p}_{c}") for p, f in (("lo", F.min), ("hi", F.max)) for c in COMPARED],
    )

    def several(c: str) -> Column:
        return F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False))

    def only(*allowed: str) -> Column:
        """No field but ``allowed`` varies."""
        varies = F.lit(False)
        for c in ("jobtitle", "company", "joblocation_address", "postdate"):
            if c not in allowed:
                varies = varies | several(c)
        return ~varies

    anything = F.lit(False)
    for c in COMPARED:
        if c != "jobid":
            anything = anything | several(c)
    one_jobid = F.col("lo_jobid").isNotNull() & ~several("jobid")
    kind = (
        F.when(~anything, "TRUE_DUPLICATE")
        .when(several("joblocation_address") & only("joblocation_address"),
              "MULTI_LOCATION_POSTING")
        .when(several("postdate") & only("postdate"), "REPOSTING")
        .otherwise("UNCERTAIN")
    )
    return bounds.select(
        "key", "collision_size", one_jobid.alias("one_jobid"), kind.alias("classification"))


def _classified(values: DataFrame) -> DataFrame:
    classified = _bounds(values).where("collision_size > 1")
    uncertain = classified.where(F.col("classification") == "UNCERTAIN").select("key")
    counts = (
        values.select(packed(F.col("identity_hash")).alias("key"), *COUNTED)
        .join(uncertain, "key", "left_semi")
        .groupBy("key")
        .agg(*[F.countDistinct(c).alias(f"n_{c}") for c in COUNTED])
    )
    return _named(classified.join(counts, "key", "left"))


def _named(counted: DataFrame, *more: str) -> DataFrame:
    """Bounds with the counts ``n_...`` of what varies, as groups with their reason."""
    labels = dict(zip(COUNTED, ("titles", "companies", "locations", "dates")))
    varied = F.array_join(
        F.array_compact(F.array(*[
            F.when(F.col(f"n_{c}") > 1, F.format_string(f"%d {labels[c]}", F.col(f"n_{c}")))
            for c in COUNTED
        ])), ", ",
    )
    is_, jobid = F.col("classification"), F.col("one_jobid")
    reason = (  # fixed values: the sentences
        F.when((is_ == "TRUE_DUPLICATE") & jobid, "All fields identical including jobid")
        .when(is_ == "TRUE_DUPLICATE",
              "All fields identical, different jobids suggest source duplication")
        .when((is_ == "MULTI_LOCATION_POSTING") & jobid,
              "Same jobid, title, company, date; different locations")
        .when(is_ == "MULTI_LOCATION_POSTING",
              "Same title, company, date; different locations and jobids")
        .when(is_ == "REPOSTING", "Same title, company, location; different posting dates")
        .otherwise(F.concat(F.lit("Multiple variations: "), varied))
    )
    confidence = (
        F.when(is_ == "REPOSTING", "HIGH").when(is_ == "UNCERTAIN", "LOW")
        .when(jobid, "HIGH").otherwise("MEDIUM")
    )
    return counted.withColumn("identity_hash", unpacked(F.col("key"))).select(
        "identity_hash", F.substring("identity_hash", 1, 16).alias("identity"),
        "collision_size", "classification", reason.alias("reason"),
        confidence.alias("confidence"), *more,
    )


def collision_values(
    raw: DataFrame, groups: DataFrame, identity: str = "record_identity_hash"
) -> DataFrame:
    """Representative values per group: the first two or three distinct ones in sorted order."""
    keys = groups.select(packed(F.col("identity_hash")).alias("key"))
    return _values_and_counts(raw, keys, identity).select(
        unpacked(F.col("key")).alias("identity_hash"), *[out for out, _ in SHOWN.values()])


def _values_and_counts(raw: DataFrame, keys: DataFrame, identity: str) -> DataFrame:
    """Per key the values shown and how many distinct ones each of ``COUNTED`` has.

    Rows go through one exchange, that of the join with the keys.  Fields are unpivoted and made
    distinct before ranking, so no list ever holds more than it shows; what is only counted is a hash.
    """
    def field(name: str, keep: int | None, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(keep).cast("int").alias("keep"),
                        value.alias("value"))

    pairs = F.array(
        *[field(out, k, blank_to_null(F.col(c))) for c, (out, k) in SHOWN.items()],
        *[field(f"n_{c}", None, F.hex(_hash(c))) for c in COUNTED])
    members = raw.select(packed(F.col(identity)).alias("key"), *SHOWN).join(
        keys, "key", "left_semi")
    distinct = (
        members.select("key", F.explode(pairs).alias("p"))
        .select("key", "p.field", "p.keep", "p.value")
        .where(F.col("value").isNotNull()).distinct()
    )
    rank = F.row_number().over(Window.partitionBy("key", "field").orderBy("value"))
    shown = distinct.withColumn("rank", rank).where(
        F.col("keep").isNull() | (F.col("rank") <= F.col("keep")))
    return shown.groupBy("key").agg(
        *[
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("field") == out, F.col("value")))),
                " | ",
            ).alias(out)
            for out, _ in SHOWN.values()
        ],
        *[F.count_if(F.col("field") == f"n_{c}").alias(f"n_{c}") for c in COUNTED],
    )


def collision_report(raw: DataFrame, identity: str = "record_identity_hash") -> DataFrame:
    """Groups with their representative values.

    Rows are written once, with the fields that are compared or shown, and read from there twice:
    what is compared as hashes, for the bounds of each identity, and what is shown of the groups.
    """
    rows = written_once(raw.select(
        F.col(identity).alias("identity_hash"), *dict.fromkeys((*COMPARED, *SHOWN))))
    bounds = written_once(_bounds(_hashed(rows, F.col("identity_hash"))).where("collision_size > 1"))
    values = _values_and_counts(rows, bounds.select("key"), "identity_hash")
    return _named(bounds.join(values, "key", "left"), *[out for out, _ in SHOWN.values()])


def collision_policy(groups: DataFrame, total_rows: DataFrame) -> DataFrame:
    """One row of group totals per class and the recommended persistence policy.

    ``total_rows`` is one row with ``total_input_rows`` and ``unique_identities``.
    """
    return _recommended(total_rows.crossJoin(groups.agg(*_group_totals())))


def _group_totals() -> list[Column]:
    several = F.col("collision_size") > 1
    return [
        F.count_if(several).alias("duplicate_identity_groups"),
        F.coalesce(F.sum(F.when(several, F.col("collision_size"))), F.lit(0))
        .alias("duplicate_identity_rows"),
        *[F.count_if(several & (F.col("classification") == c)).alias(c.lower()) for c in CLASSES],
    ]


def collision_policy_of_rows(raw: DataFrame, identity: str = "record_identity_hash") -> DataFrame:
    """`collision_policy` with the totals of ``raw``, all from one grouping of its rows."""
    return _recommended(_bounds(_hashed(raw, F.col(identity).alias("identity_hash"))).agg(
        F.coalesce(F.sum("collision_size"), F.lit(0)).alias("total_input_rows"),
        F.count(F.lit(1)).alias("unique_identities"), *_group_totals()))


def _recommended(totals: DataFrame) -> DataFrame:
    half = F.col("duplicate_identity_groups") * 0.5
    same = F.col("true_duplicate") + F.col("source_duplicate")
    policy = (
        F.when(same > half, "DEDUPLICATE_BEFORE_PERSISTENCE")
        .when(F.col("reposting") > half, "PERSIST_ALL_FLAG_REPOSTINGS")
        .when(F.col("uncertain") > half, "PERSIST_ALL_WITH_COLLISION_FLAG")
        .otherwise("PERSIST_ALL_WITH_CLASSIFICATION")
    )
    return totals.withColumn("recommended_policy", policy)


def collision_examples(groups: DataFrame, per_class: int = 5) -> DataFrame:
    """The first groups of each class by identity."""
    rank = F.row_number().over(
        Window.partitionBy("classification").orderBy("identity_hash")
    )
    return groups.withColumn("example", rank).where(F.col("example") <= per_class)
