"""Free-text locations to cities and districts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bind, collapse, is_blank, sql_text, strip, title_case
from ..sources.gazetteer import (
    DISTRICT_ALIASES, DISTRICTS, MAJOR_CITIES, PUNE_LOCALITIES, districts_df,
)

CITY_METHOD = "DETERMINISTIC_RULE_V1"
DISTRICT_METHOD = "MAHARASHTRA_GEO_V1"
STATE = "Maharashtra"


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([-.])", r"\\\1", w) for w in words)


def with_city_location(
    df: DataFrame, text: str, into: str = "location", whole_word_localities: bool = False
) -> DataFrame:
    """Add the city-list reading of a location text as a struct.

    Several cities make the text shared between them; capitalised words run together inside a
    comma list lower the evidence to a mention.  Localities match as substrings, as in the
    source system ("camp" also fits "Campbell"); ``whole_word_localities`` tightens that.
    Cities are listed by position in the text.
    """
    locality = f"(?:{_any_of(PUNE_LOCALITIES)})"
    if whole_word_localities:
        locality = rf"(?U)\b{locality}\b"
    city = rf"(?U)\b(?:{_any_of(MAJOR_CITIES)})\b"

    def part_cities(part: Column) -> Column:
        found = F.regexp_extract_all(F.lower(part), F.lit(city), F.lit(0))
        named = F.transform(
            found,
            lambda c: F.when(c == "pune", "Pune")
            .when(c.isin("bengaluru", "bangalore"), "Bengaluru")
            .otherwise(title_case(part)),
        )
        here = F.lower(part).rlike(locality)
        return F.concat(F.when(here, F.array(F.lit("Pune"))).otherwise(F.array().cast(
            "array<string>")), named)

    def staged(raw: Column) -> Column:
        parts = F.filter(F.transform(F.split(raw, "[,/|;]+"), strip), lambda p: p != "")
        return bind(
            parts,
            lambda p: F.struct(
                raw.alias("raw"), F.lower(raw).alias("low"), p.alias("parts"),
                F.array_distinct(F.flatten(F.transform(p, part_cities))).alias("cities"),
                F.try_element_at(
                    F.filter(p, lambda x: F.lower(x).rlike(locality)), F.lit(-1)
                ).alias("locality"),
            ),
        )

    def levelled(s: Column) -> Column:
        n = F.size(s["cities"])
        run_together = (
            F.contains(s["raw"], F.lit(",")) & ~s["raw"].rlike("[/|;]")
            & F.exists(
                F.split(s["raw"], ","),
                lambda seg: bind(
                    F.split(strip(seg), r"(?U)\s+"),
                    lambda t: (F.size(t) > 1) & F.forall(t, lambda w: w.rlike(r"^\p{Lu}")),
                ),
            )
        )
        level = (
            F.when(n == 1, "EXACT_SINGLE")
            .when(n > 1, F.when(run_together, "CITY_MENTION").otherwise("MULTI_EXPLICIT"))
            .when(F.contains(s["low"], F.lit("pune")), "CITY_MENTION")
            .otherwise("UNKNOWN")
        )
        return bind(level, lambda v: finished(s, v))

    def finished(s: Column, level: Column) -> Column:
        cities, n = s["cities"], F.size(s["cities"])
        pune = F.coalesce(F.array_contains(cities, "Pune"), F.lit(False))
        state = F.contains(s["low"], F.lit("maharashtra")) | F.exists(
            s["parts"], lambda p: F.lower(p) == "mh"
        )
        has_pune = F.coalesce(
            pune | ((level == "CITY_MENTION") & F.contains(s["low"], F.lit("pune"))),
            F.lit(False),
        )
        exclusivity = F.when(~has_pune, "UNKNOWN")
        for value, name in (("EXACT_SINGLE", "EXCLUSIVE"), ("MULTI_EXPLICIT", "SHARED"),
                            ("CITY_MENTION", "MENTIONED")):
            exclusivity = exclusivity.when(level == value, name)
        return F.struct(
            F.coalesce(s["raw"], F.col(text)).alias("raw_location"),
            F.when(s["raw"].isNotNull(), "India").alias("country"),
            F.when(pune | state, STATE).alias("state"),
            F.when(pune, "Pune").alias("district"),
            F.when(n > 0, s["locality"]).alias("locality"),
            F.when(n == 1, "SINGLE_LOCATION").when(n > 1, "MULTI_LOCATION")
            .otherwise("UNKNOWN").alias("location_scope"),
            F.when((n == 1) & pune, "HIGH").when(n >= 1, "MEDIUM").when(state, "LOW")
            .otherwise("NONE").alias("location_confidence"),
            F.coalesce(cities, F.array().cast("array<string>")).alias("matched_locations"),
            F.lit(CITY_METHOD).alias("normalization_method"),
            level.alias("location_evidence_level"),
            has_pune.alias("has_pune_evidence"),
            exclusivity.otherwise("UNKNOWN").alias("pune_exclusivity"),
        )

    located = bind(
        F.nullif(strip(F.col(text)), F.lit("")), lambda raw: bind(staged(raw), levelled)
    )
    return df.select("*", located.alias(into))


def with_district_location(df: DataFrame, text: str, into: str = "location") -> DataFrame:
    """Add the 36-district reading of a location text as a struct.

    A district is only ever assigned when the text names it or one of its localities; the
    state alone is ambiguous.  Each name is first looked for as a plain substring, which is
    cheap, and only then as a whole word.
    """
    kept = df.columns

    def named(word: str) -> str:
        escaped = re.sub(r"([-.])", r"\\\1", word)
        pattern = sql_text(rf"(?U)\b{escaped}\b")
        return f"contains(low, {sql_text(word)}) AND low RLIKE {pattern}"

    # the text is a lambda variable: a filter on the result must not repeat its normalisation
    districts = (
        "array_compact(array("
        + ", ".join(f"IF({named(n.lower())}, {sql_text(n)}, NULL)" for n, *_ in DISTRICTS) + "))"
    )
    aliases = (
        "array_compact(array("
        + ", ".join(
            f"IF({named(a)}, named_struct('alias', {sql_text(a)}, 'district', {sql_text(d)}), NULL)"
            for a, d in DISTRICT_ALIASES
        ) + "))"
    )
    staged = (
        df.withColumn("_low", collapse(F.col(text)))
        .withColumn(
            "_hits",
            F.expr(f"element_at(transform(array(_low), low -> named_struct('named', {districts}, "
                   f"'aliases', {aliases}, 'state', low RLIKE '(?U)\\\\bmaharashtra\\\\b')), 1)"),
        )
        .withColumn("_aliases", F.col("_hits.aliases"))
        .withColumn(
            "_matched",
            F.array_distinct(
                F.concat("_hits.named", F.transform("_aliases", lambda a: a["district"]))
            ),
        )
        .withColumn("_state", F.col("_hits.state"))
        .withColumn(
            "_level",
            F.when(F.size("_matched") > 1, "MULTI_EXPLICIT")
            .when((F.size("_matched") == 1) & (F.size("_aliases") > 0), "CITY_MENTION")
            .when(F.size("_matched") == 1, "EXACT_SINGLE")
            .when(F.col("_state"), "AMBIGUOUS").otherwise("UNKNOWN"),
        )
    )
    n, level = F.size("_matched"), F.col("_level")
    result = F.struct(
        F.when(is_blank(F.col(text)), F.col(text)).otherwise(strip(F.col(text)))
        .alias("raw_location"),
        F.lit("India").alias("country"),
        F.when((n > 0) | F.col("_state"), STATE).alias("state"),
        F.when(n == 1, F.get("_matched", F.lit(0))).alias("district"),
        F.get("_aliases", F.lit(0))["alias"].alias("locality"),
        F.when(n == 1, "SINGLE_LOCATION").when(n > 1, "MULTI_LOCATION").otherwise("UNKNOWN")
        .alias("location_scope"),
        F.when(level == "EXACT_SINGLE", "HIGH")
        .when(level.isin("CITY_MENTION", "MULTI_EXPLICIT"), "MEDIUM")
        .when(level == "AMBIGUOUS", "LOW").otherwise("NONE").alias("location_confidence"),
        F.col("_matched").alias("matched_locations"),
        F.lit(DISTRICT_METHOD).alias("normalization_method"),
        level.alias("location_evidence_level"),
        F.lit(False).alias("has_pune_evidence"),
        F.lit("UNKNOWN").alias("pune_exclusivity"),
    )
    return staged.select(*kept, result.alias(into))


def with_division(df: DataFrame, district: str, into: str = "division") -> DataFrame:
    """Division of a district name, any case; null when unknown."""
    lookup = districts_df(df.sparkSession).select(
        F.lower("district").alias("_d"), F.col("division").alias(into)
    )
    return df.join(F.broadcast(lookup), F.lower(F.col(district)) == F.col("_d"), "left").drop("_d")


def districts_by_division(districts: DataFrame) -> DataFrame:
    """Districts of each division in table order; the gazetteer is a fixed small table."""
    return districts.groupBy("division").agg(
        F.count(F.lit(1)).alias("district_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("table_order", "district"))),
                lambda d: d["district"],
            ), ", ",
        ).alias("districts"),
    )


def location_profile(located: DataFrame, text: str) -> DataFrame:
    """One row of totals by scope from rows with a city ``location`` struct."""
    loc = F.col("location")
    single, multi = (loc["location_scope"] == s for s in ("SINGLE_LOCATION", "MULTI_LOCATION"))
    pune = F.coalesce(loc["district"] == "Pune", F.lit(False))
    return located.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~is_blank(F.col(text))).alias("records_with_location"),
        F.count_if(single).alias("single_location_count"),
        F.count_if(multi).alias("multi_location_count"),
        F.count_if(loc["location_scope"] == "UNKNOWN").alias("unknown_count"),
        F.count_if(single & pune).alias("pune_single_location_count"),
        F.count_if(multi & pune).alias("pune_multi_location_count"),
    )


def top_locations(located: DataFrame, text: str, n: int = 50) -> DataFrame:
    """Most frequent raw and normalised locations."""
    loc = F.col("location")
    normal = F.concat(
        F.lit("District: "), F.coalesce(loc["district"], F.lit("None")),
        F.lit(" | Scope: "), loc["location_scope"],
        F.lit(" | Matched: ["),
        F.array_join(F.transform(loc["matched_locations"], lambda m: F.concat(
            F.lit("'"), m, F.lit("'"))), ", "),
        F.lit("]"),
    )

    def top(kind: str, value: Column, rows: DataFrame) -> DataFrame:
        return (
            rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(n).withColumn("kind", F.lit(kind))
        )

    return top("RAW", F.col(text), located.where(~is_blank(F.col(text)))).unionByName(
        top("NORMALISED", normal, located)
    )
