"""Titles to occupations: the first-rule-wins resolver and the reference-table crosswalk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapse, sql_text, word_tokens
from ..session import cut_lineage
from ..sources.seeds import OCCUPATIONS, TOKEN_RULES, Occupation, TokenRule

_NORM = "_title_norm"
_OUTCOME = ("occupation_id", "matched_text", "status", "method")
MIN_CONTAINED = 4  # shorter titles or names never match by containment


def _phrases(occupations: tuple[Occupation, ...]) -> list[tuple[Occupation, str, str]]:
    return [
        (o, text, kind)
        for o in occupations
        for text, kind in [(o.occupation_name, "CANONICAL"), *((a, "ALIAS") for a in o.aliases)]
    ]


def with_occupation(
    df: DataFrame,
    title: str,
    occupations: tuple[Occupation, ...] = OCCUPATIONS,
    rules: tuple[TokenRule, ...] = TOKEN_RULES,
    into: str = "occupation",
) -> DataFrame:
    """Add ``struct(occupation_id, matched_text, status, method)``.

    Equality with a name or alias, then containment either way, then token rules; inside each
    stage seed order decides.  One CASE over literals: no join, no shuffle.  The normalised title
    is a lambda variable, so a filter on the result that is pushed below does not repeat it in
    every branch.
    """
    branches: list[tuple[str, tuple[str, str, str, str]]] = []
    phrases = [(o, t, k, " ".join(t.lower().split())) for o, t, k in _phrases(occupations)]
    for o, text, kind, low in phrases:
        branches.append((
            f"n = {sql_text(low)}",
            (o.occupation_id, text, o.verification_status, f"EXACT_{kind}"),
        ))
    for o, text, kind, low in phrases:
        if len(low) >= MIN_CONTAINED:
            branches.append((
                f"contains(n, {sql_text(low)}) OR (length(n) >= {MIN_CONTAINED} "
                f"AND contains({sql_text(low)}, n))",
                (o.occupation_id, text, o.verification_status, f"SUBSTRING_{kind}"),
            ))
    names = {o.occupation_id: o.occupation_name for o in occupations}
    for rule in rules:
        tests = [f"array_contains(w, {sql_text(t)})" for t in rule.every]
        if rule.one_of:
            any_of = ", ".join(sql_text(t) for t in rule.one_of)
            tests.append(f"arrays_overlap(w, array({any_of}))")
        branches.append((
            " AND ".join(tests),
            (rule.occupation_id, names[rule.occupation_id], "NEEDS_REVIEW", "MULTI_TOKEN_RULE"),
        ))

    whens = " ".join(f"WHEN {test} THEN {i}" for i, (test, _) in enumerate(branches))
    outcomes = ", ".join(
        "named_struct("
        + ", ".join(f"'{f}', {sql_text(v)}" for f, v in zip(_OUTCOME, out)) + ")"
        for _, out in branches
    )
    chosen = F.expr(
        f"element_at(transform(array(`{_NORM}`), n -> element_at(transform(array(split(n, ' ')), "
        f"w -> CASE WHEN n = '' THEN NULL {whens} END), 1)), 1)"
    )
    unmapped = F.struct(
        F.lit(None).cast("string").alias("occupation_id"),
        F.when(F.col(_NORM) != "", F.col(title)).alias("matched_text"),
        F.lit("UNMAPPED").alias("status"),
        F.lit("NONE").alias("method"),
    )
    kept = df.columns
    return (
        df.withColumn(_NORM, collapse(F.col(title)))
        .withColumn("_choice", chosen)
        .select(
            *kept,
            F.when(
                F.col("_choice").isNotNull(), F.get(F.expr(f"array({outcomes})"), F.col("_choice"))
            ).otherwise(unmapped).alias(into),
        )
    )


# --- reference-table crosswalk -----------------------------------------------------------

TITLE_WEIGHT, SKILLS_WEIGHT, MIN_CONFIDENCE = 0.7, 0.3, 0.35  # fixed values


def _raw_tokens(c: Column) -> Column:
    """Lower-case ASCII runs of the text *as it is*: capitals split tokens."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)))


FEW_ENTRIES = 10_000  # token sets of a reference that are sent to every task
COMMON_TOKENS = 256  # the most frequent reference tokens, which a prefix takes last
PREFIX_SHARE = MIN_CONFIDENCE  # one of both similarities is at least the bound of their mean


def _tokens_of_occupations(occupations: DataFrame) -> DataFrame:
    return occupations.select(
        F.col("occupation_id").alias("scope_id"),
        F.explode(
            _raw_tokens(
                F.concat_ws(
                    " ", collapse(F.col("occupation_name")), F.array_join("aliases", " "),
                    collapse(F.col("source_reference")),
                )
            )
        ).alias("token"),
    )


def _entries(reference: DataFrame, occupations: DataFrame) -> DataFrame:
    """(entry_order, rt, rg, scope): the first entry of each pair of token sets, and the
    occupations that share a token with it."""
    sets = reference.select(
        "entry_order",
        F.array_sort(F.array_distinct(word_tokens(F.col("occupation_title")))).alias("rt"),
        F.array_sort(F.array_distinct(word_tokens(F.col("group_name")))).alias("rg"),
    ).groupBy("rt", "rg").agg(F.min("entry_order").alias("entry_order"))
    tokens = _tokens_of_occupations(occupations).groupBy("token").agg(
        F.collect_set("scope_id").alias("ids"))
    shared = (sets.select("entry_order", F.explode(F.array_union("rt", "rg")).alias("token"))
              .join(tokens, "token").groupBy("entry_order")
              .agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("scope")))
    return sets.join(shared, "entry_order", "left").select(
        "entry_order", "rt", "rg", F.coalesce("scope", F.array().cast("array<string>")).alias("scope"))


def _rarest_first(tokens: Column, common: list[str]) -> Column:
    """Tokens in one order for both sides: those that are not among the most frequent ones of the
    reference first, then those from the rarer to the more frequent."""
    ranked = F.transform(tokens, lambda t: F.struct(
        F.array_position(F.lit(common) if common else F.array().cast("array<string>"), t).alias("rank"),
        t.alias("t")))
    return F.transform(F.array_sort(ranked), lambda x: x["t"])


def _prefix(tokens: Column) -> Column:
    """The tokens of which two sets of that similarity share one, if ordered alike."""
    n = F.size(tokens)
    return F.slice(tokens, 1, F.when(n > 0, n - F.ceil(n * F.lit(PREFIX_SHARE)).cast("int") + 1).otherwise(0))


def _keys(title: Column, other: Column) -> Column:
    """Join keys of the pairs at the bound: a title token of the prefix, or any title token with a
    token of the other set's prefix; each with the place of the title token and what follows it."""
    alone = F.transform(_prefix(title), lambda t, i: F.struct(
        t.alias("token"), F.lit("").alias("with"), (F.size(title) - i).alias("left")))
    together = F.flatten(F.transform(title, lambda t: F.transform(_prefix(other), lambda o: F.struct(
        t.alias("token"), o.alias("with"), F.size(title).alias("left")))))
    return F.concat(alone, together)


def _every_key(title: Column, other: Column) -> Column:
    """Join keys of all pairs that share any token."""
    return F.concat(
        F.transform(title, lambda t: F.struct(
            t.alias("token"), F.lit("").alias("with"), F.size(title).alias("left"))),
        F.transform(other, lambda o: F.struct(
            F.lit("").alias("token"), o.alias("with"), F.size(title).alias("left"))))


def _jaccard(shared: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(shared, a + b - shared), F.lit(0.0))


def _best(queries: DataFrame, entries: DataFrame, keys, bounded: bool, few: bool) -> DataFrame:
    """(query, score, entry_order): the best entry of each query among those that share a key.

    A reference of ``few`` entries goes to the queries; otherwise both sides are shuffled by key.
    """
    asked = queries.select("query", "t", "s", "canonical_occupation_id", "has_scope",
                           F.explode(keys(F.col("t"), F.col("s"))).alias("k")).select(
        "query", "t", "s", "canonical_occupation_id", "has_scope", "k.token", "k.with",
        F.col("k.left").alias("q_left"))
    posted = entries.select("entry_order", "rt", "rg", "scope", F.explode(
        keys(F.col("rt"), F.col("rg"))).alias("k")).select(
        "entry_order", "rt", "rg", "scope", "k.token", "k.with", F.col("k.left").alias("e_left"))
    pairs = asked.join(F.broadcast(posted) if few else posted, ["token", "with"])
    if bounded:
        n, m = F.size("t"), F.size("rt")
        # Length and position: what can still be shared from the token met on must reach the bound.
        reach = F.least("q_left", "e_left") >= F.ceil((n + m) * F.lit(PREFIX_SHARE / (1 + PREFIX_SHARE)) - 1e-9)
        pairs = pairs.where((F.col("with") != "") | reach)
    allowed = pairs.where(~F.col("has_scope") | F.array_contains("scope", F.col("canonical_occupation_id")))
    score = (
        TITLE_WEIGHT * _jaccard(F.size(F.array_intersect("t", "rt")), F.size("t"), F.size("rt"))
        + SKILLS_WEIGHT * _jaccard(F.size(F.array_intersect("s", "rg")), F.size("s"), F.size("rg")))
    return (allowed.groupBy("query").agg(F.max(F.struct(
                score.alias("score"), (-F.col("entry_order")).alias("o"))).alias("b"))
            .select("query", F.col("b.score").alias("score"), (-F.col("b.o")).alias("entry_order")))


def map_to_reference(
    titles: DataFrame, reference: DataFrame, occupations: DataFrame
) -> DataFrame:
    """Best reference entry per distinct (title, skills, canonical_occupation_id).

    A set-similarity join: titles and entries become token sets, rarest tokens first, and meet on
    prefixes that any pair at the confidence bound shares; length and position filters drop pairs
    before they are scored.  Only queries without an entry at the bound are then joined on all
    their tokens, for the exact low score that they report.  A canonical occupation narrows the
    entries to those it shares a token with, if there are any.  ``reference`` needs
    ``entry_order`` (ties go to the earlier entry).
    """
    keys = ["title", "skills", "canonical_occupation_id"]
    entries = cut_lineage(_entries(reference, occupations))
    common = [r[0] for r in entries.select(F.explode("rt").alias("token")).groupBy("token").count()
              .orderBy(F.desc("count"), "token").limit(COMMON_TOKENS).collect()][::-1]
    entries = entries.withColumn("rt", _rarest_first(F.col("rt"), common)).withColumn(
        "rg", _rarest_first(F.col("rg"), common))
    text = F.coalesce(F.col("title"), F.lit(""))
    asked = cut_lineage(titles.select(*keys).distinct().select(
        *keys,
        _rarest_first(F.array_distinct(word_tokens(text)), common).alias("t"),
        _rarest_first(F.array_distinct(word_tokens(F.col("skills"))), common).alias("s"),
    ).withColumn("query", F.when(text != "", F.md5(F.to_json(F.struct("t", "s", "canonical_occupation_id"))))))
    scoped = entries.select(F.explode("scope").alias("canonical_occupation_id")).distinct().withColumn(
        "scoped", F.lit(True))
    queries = cut_lineage(
        asked.where("query is not null").dropDuplicates(["query"])
        .join(scoped, "canonical_occupation_id", "left")
        .withColumn("has_scope", F.coalesce("scoped", F.lit(False))))
    few = entries.count() <= FEW_ENTRIES
    near = cut_lineage(_best(queries, entries, _keys, True, few).where(F.col("score") >= MIN_CONFIDENCE))
    rest = queries.join(near, "query", "left_anti")
    best = cut_lineage(near.unionByName(_best(rest, entries, _every_key, False, few)))
    known = occupations.select(
        F.col("occupation_id").alias("canonical_occupation_id"),
        F.col("occupation_name"), F.col("source_reference").alias("occupation_reference"),
    )
    seeded = reference.agg((F.count(F.lit(1)) > 0).alias("seeded"))
    found = F.col("score") >= MIN_CONFIDENCE
    authoritative = F.col("is_authoritative")

    def when_found(c: Column) -> Column:
        return F.when(found, c)

    no_title = F.coalesce(F.col("title"), F.lit("")) == ""
    return (
        asked.select(*keys, "query")
        .join(best, "query", "left")
        .join(reference, "entry_order", "left")
        .join(known, "canonical_occupation_id", "left")
        .crossJoin(F.broadcast(seeded))  # one row by construction
        .select(
            "title", "skills",
            F.when(~no_title, F.col("canonical_occupation_id")).alias("canonical_occupation_id"),
            when_found(F.col("occupation_name")).alias("canonical_occupation_name"),
            when_found(F.when(authoritative, F.col("nco_code"))).alias("nco_code"),
            when_found(F.col("occupation_title")).alias("nco_title"),
            when_found(F.nullif("division", F.lit(""))).alias("nco_division"),
            when_found(F.nullif("group_name", F.lit(""))).alias("nco_group"),
            F.bround(F.coalesce("score", F.lit(0.0)), 4).alias("confidence"),
            F.when(no_title, "NONE").when(~F.col("seeded"), "NO_REFERENCE")
            .when(found, "TOKEN_SIMILARITY").otherwise("LOW_CONFIDENCE").alias("method"),
            F.when(found & authoritative, "VERIFIED").otherwise("NEEDS_REVIEW")
            .alias("verification_status"),
            F.when(~no_title & F.col("seeded"), F.col("title")).alias("matched_on"),
            when_found(
                F.coalesce(
                    F.concat(F.lit(": "), F.col("occupation_reference")),
                    F.nullif("source_reference", F.lit("")),
                )
            ).alias("source_reference"),
        )
    )


def crosswalk(reference: DataFrame, occupations: DataFrame) -> DataFrame:
    """``map_to_reference`` over every canonical occupation, its sector as the skills text."""
    asked = occupations.select(
        F.col("occupation_name").alias("title"), F.col("sector").alias("skills"),
        F.col("occupation_id").alias("canonical_occupation_id"),
    )
    return map_to_reference(asked, reference, occupations)
