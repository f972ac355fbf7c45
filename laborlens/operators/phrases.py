"""Skill evidence by a join with a table of phrases, for ontologies of any size.

`skills.extract_skills` makes the ontology part of the plan, which suits some thousand phrases.
Here it stays a table: each text is cut into tokens (word runs, and every other character alone),
its token n-grams of the lengths that phrases have are hashed, and Spark joins them with the
hashed phrases.  Spark broadcasts a phrase table that its size estimate allows and shuffles the
hashes otherwise; no text goes through that join.  Overlapping matches of a text are then resolved
from left to right, the longest first, and the context is cut from the text.

Results equal `skills.evidence_rows(skills.extract_skills(...))`, without the order of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.identity import content_hash
from ..functions.text import bind, collapse, split_source_skills, squeeze
from ..session import cut_lineage
from .skills import CONTEXT
from .texts import few_texts, with_known

TOKEN = r"(?U)\w+|\W"
WORD = r"(?U)^\w"
MOST_SENT = 100_000  # phrases and uses that are sent to every task
FIELDS = (("source_skills", "SOURCE_SKILL", 0), ("title", "JOB_TITLE", 1),
          ("description", "JOB_DESCRIPTION", 2))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def phrase_table(ontology: DataFrame, equivalences: DataFrame | None = None) -> DataFrame:
    """(phrase, skill_id, skill_name, canonical, in_text, in_segments), one row per phrase and use.

    ``ontology`` has seed_order, skill_id, canonical_skill_name and aliases; a name stands before an
    alias, and of equal phrases the later skill counts.  ``equivalences`` (observed, target) name
    further spellings of source-skill segments; those whose target is no phrase are left out.
    """
    skill = [F.col("skill_id"), F.col("canonical_skill_name").alias("skill_name")]
    named = ontology.select(
        collapse(F.col("canonical_skill_name")).alias("phrase"), *skill,
        F.struct(F.lit(1).alias("kind"), F.col("seed_order").cast("long").alias("at"),
                 F.lit(0).alias("place")).alias("rank"))
    aliased = ontology.select(*skill, "seed_order", F.posexplode("aliases").alias("place", "alias")).select(
        collapse(F.col("alias")).alias("phrase"), "skill_id", "skill_name",
        F.struct(F.lit(0).alias("kind"), F.col("seed_order").cast("long").alias("at"),
                 F.col("place")).alias("rank"))
    best = F.max_by(F.struct("skill_id", "skill_name", F.col("rank.kind").alias("canonical")), "rank")
    text = (named.unionByName(aliased).where("phrase <> ''").groupBy("phrase").agg(best.alias("b"))
            .select("phrase", "b.*", F.lit(True).alias("in_text"), F.lit(True).alias("in_segments")))
    if equivalences is None:
        return text
    extra = (equivalences.select(collapse(F.col("observed")).alias("phrase"),
                                 collapse(F.col("target")).alias("target"))
             .where("phrase <> ''")
             .join(text.select(F.col("phrase").alias("target"), "skill_id", "skill_name"), "target")
             .groupBy("phrase").agg(F.max_by(F.struct("skill_id", "skill_name"), "target").alias("b"))
             .select("phrase", "b.*", F.lit(0).alias("canonical"), F.lit(False).alias("in_text"),
                     F.lit(True).alias("in_segments")))
    # A segment that an equivalence names is no longer judged as an ontology phrase.
    replaced = extra.select("phrase", F.lit(False).alias("still"))
    kept = (text.join(replaced, "phrase", "left")
            .withColumn("in_segments", F.coalesce("still", "in_segments")).drop("still"))
    return kept.unionByName(extra)


def _grams(tokens: Column, is_word: Column, sizes: list[int]) -> Column:
    """(gram, i, size) of every token n-gram that could be a phrase.

    A phrase may not begin or end inside a word: a sign at its edge must have no word beside it.
    """
    n = F.size(tokens)

    def one(i: Column, size: Column) -> Column:
        last = i + size
        fits = (last <= n) & ~F.coalesce(F.get(is_word, last), F.lit(False))
        return F.when(fits, F.struct(
            F.xxhash64(F.lower(F.array_join(F.slice(tokens, i + 1, size), ""))).alias("gram"),
            i.alias("i"), size.alias("size")))

    def starts(token: Column, i: Column) -> Column:
        return (token != " ") & ~F.coalesce(F.get(is_word, i - 1) & (i > 0), F.lit(False))

    begun = F.filter(F.transform(tokens, lambda t, i: F.when(starts(t, i), i)), lambda i: i.isNotNull())
    every = F.transform(begun, lambda i: F.transform(F.lit(sizes), lambda size: one(i, size)))
    return F.filter(F.flatten(every), lambda g: g.isNotNull())


def _text_grams(postings: DataFrame, key: str, text: str, field: int, sizes: list[int]) -> DataFrame:
    return (postings.select(F.col(key).alias("key"), _tokens(F.col(text)).alias("tokens"))
            .select("key", "tokens", F.transform("tokens", lambda t: t.rlike(WORD)).alias("is_word"))
            .select("key", F.explode(_grams(F.col("tokens"), F.col("is_word"), sizes)).alias("g"))
            .select("key", F.lit(field).alias("field"), F.lit("text").alias("use"), "g.*",
                    F.lit(None).cast("string").alias("raw")))


def _segment_grams(postings: DataFrame, key: str, text: str) -> DataFrame:
    return (postings.select(F.col(key).alias("key"), F.posexplode(
                split_source_skills(F.col(text))).alias("i", "raw"))
            .select("key", F.lit(0).alias("field"), F.lit("segment").alias("use"),
                    F.xxhash64(collapse(F.col("raw"))).alias("gram"), "i", F.lit(1).alias("size"), "raw"))


def _resolved(cluster: Column) -> Column:
    """Matches that overlap, sorted: keep each that begins where the one kept before has ended."""
    kept = cluster.getItem(0)
    return F.aggregate(
        F.slice(cluster, 2, F.size(cluster)),
        F.struct((kept["i"] - kept["back"]).alias("end"), F.array(kept).alias("kept")),
        lambda acc, m: F.when(m["i"] >= acc["end"], F.struct(
            (m["i"] - m["back"]).alias("end"), F.concat(acc["kept"], F.array(m)).alias("kept")))
        .otherwise(acc),
        lambda acc: acc["kept"])


def matches(postings: DataFrame, phrases: DataFrame, key: str, title: str | None = "job_title",
            description: str | None = "description", source_skills: str | None = "source_skills",
            ) -> DataFrame:
    """(key, field, skill_id, first_for_job, field_count, at): a skill's first match in a field.

    ``at`` has i (token or segment), size, raw, phrase, skill_name, canonical.  Rows are partitioned
    by key, once.
    """
    used = F.explode(F.array(
        F.when(F.col("in_text"), F.lit("text")), F.when(F.col("in_segments"), F.lit("segment"))))
    phrases = cut_lineage(phrases)
    keyed = phrases.withColumn("use", used).where("use IS NOT NULL").select(
        F.xxhash64("phrase").alias("gram"), "use", "phrase", "skill_id", "skill_name", "canonical")
    if keyed.count() <= MOST_SENT:
        keyed = F.broadcast(keyed)
    # An ontology's phrases have few lengths; counting them is one pass over the phrases.
    sizes = sorted(r[0] for r in phrases.where("in_text").select(
        F.size(_tokens(F.col("phrase"))).alias("n")).distinct().collect())
    parts = [_text_grams(postings, key, column, field, sizes)
             for column, field in ((title, 1), (description, 2)) if column]
    if source_skills:
        parts.append(_segment_grams(postings, key, source_skills))
    grams = parts[0]
    for part in parts[1:]:
        grams = grams.unionByName(part)
    found = grams.join(keyed, ["gram", "use"]).repartition("key")
    along = Window.partitionBy("key", "field").orderBy("i", F.desc("size"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("i") >= F.coalesce(F.max(F.col("i") + F.col("size")).over(before), F.lit(0))
    # Runs of matches that overlap, as a rule one match long, are all that is gathered.
    runs = found.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(along))
    kept = (runs.groupBy("key", "field", "run").agg(F.sort_array(F.collect_list(F.struct(
                "i", (-F.col("size")).alias("back"), "raw", "phrase", "skill_id", "skill_name",
                "canonical"))).alias("run_of"))
            .select("key", "field", F.explode(_resolved(F.col("run_of"))).alias("m")))
    firsts = kept.groupBy("key", "field", F.col("m.skill_id").alias("skill_id")).agg(
        F.min("m").alias("m"))
    same = Window.partitionBy("key", "skill_id")
    return firsts.select(
        "key", "field", "skill_id", (F.col("field") == F.min("field").over(same)).alias("first_for_job"),
        F.count(F.lit(1)).over(same).cast("int").alias("field_count"),
        F.struct(F.col("m.i"), (-F.col("m.back")).alias("size"), F.col("m.raw"), F.col("m.phrase"),
                 F.col("m.skill_name"), F.col("m.canonical")).alias("at"))


def _starts(found: Column, number: int, text: Column) -> Column:
    """Characters before each match of field `number`, by its place in `found`.

    The matches of a field are in the order of their tokens, so each token is counted once.
    """
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("chars"),
                     F.array().cast("array<int>").alias("starts"))

    def added(tokens: Column, acc: Column, m: Column) -> Column:
        at = F.when(m["field"] == number, m["i"]).otherwise(acc["i"])
        passed = F.length(F.array_join(F.slice(tokens, acc["i"] + 1, at - acc["i"]), ""))
        return bind(acc["chars"] + passed, lambda chars: F.struct(
            at.alias("i"), chars.alias("chars"),
            F.concat(acc["starts"], F.array(chars)).alias("starts")))

    return bind(_tokens(text), lambda tokens: F.aggregate(
        found, begin, lambda acc, m: added(tokens, acc, m), lambda acc: acc["starts"]))


def _evidence(found: Column, place: Column, text: dict[int, Column], starts: dict[int, Column]) -> Column:
    """The evidence entry of a match; its context is cut from the text of its field."""
    at, field = found["at"], found["field"]
    level = F.when(at["canonical"] == 1, "EXACT").otherwise("ALIAS")

    def context(number: int) -> Column:
        return bind(F.get(starts[number], place), lambda s: bind(F.greatest(s - CONTEXT, F.lit(0)), lambda first: squeeze(
            F.substring(text[number], first + 1, s + F.length(at["phrase"]) + CONTEXT - first))))

    around = at["raw"]
    for number in text:
        around = F.when(field == number, context(number)).otherwise(around)
    kinds = F.array(*[F.lit(name) for _, name, _ in FIELDS])
    prefixes = F.lit(["SOURCE_SKILL_", "TITLE_", "DESCRIPTION_"])
    return F.struct(
        F.coalesce(at["raw"], at["phrase"]).alias("source_skill_text"),
        found["skill_id"].alias("canonical_skill_id"), at["skill_name"].alias("canonical_skill_name"),
        F.concat(F.get(prefixes, field), level).alias("extraction_method"),
        F.when(at["canonical"] == 1, "HIGH").otherwise("MEDIUM").alias("match_confidence"),
        around.alias("evidence_text"), F.get(kinds, field).alias("evidence_type"),
        found["first_for_job"].alias("first_for_job"), found["field_count"].alias("field_count"))


def _entries(postings: DataFrame, phrases: DataFrame, key: str, title: str | None,
             description: str | None, source_skills: str | None) -> DataFrame:
    """(key, entries): the evidence of each row that has any."""
    found = (matches(postings, phrases, key, title, description, source_skills)
             .groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
                 "field", F.col("at.i"), "skill_id", "first_for_job", "field_count", "at"))).alias("found")))
    fields = [(column, number) for column, number in ((title, 1), (description, 2)) if column]
    texts = postings.select(F.col(key).alias("key"), *[
        F.coalesce(F.col(column), F.lit("")).alias(f"text{number}") for column, number in fields])
    # Tokens and starts are bound: an alias that is used once would be made anew for every match.
    entries = lambda starts: F.transform("found", lambda m, k: _evidence(
        m, k, {number: F.col(f"text{number}") for _, number in fields},
        {number: starts[f"s{number}"] for _, number in fields}))
    starts = F.struct(F.lit(0).alias("s0"), *[
        _starts(F.col("found"), number, F.col(f"text{number}")).alias(f"s{number}") for _, number in fields])
    return texts.join(found, "key").select(F.col("key").alias(key), bind(starts, entries).alias("entries"))


def evidence_by_join(postings: DataFrame, phrases: DataFrame, key: str = "posting_id",
                     title: str | None = "job_title", description: str | None = "description",
                     source_skills: str | None = "source_skills", repeated: bool = False) -> DataFrame:
    """One row per posting, field and skill, as ``skills.evidence_rows`` gives them.

    ``phrases`` as of ``phrase_table``; ``key`` names a row of ``postings``.  ``repeated`` says that
    texts stand in many postings: if the distinct ones are few, only they go through the join.
    """
    fields = (title, description, source_skills)
    names = [c for c in fields if c]
    texts = few_texts(postings, names) if repeated else None
    if texts is None:
        entries = _entries(postings, phrases, key, *fields)
    else:
        named = texts.withColumn("_text", content_hash(*names))
        known = named.join(_entries(named, phrases, "_text", *fields), "_text").drop("_text")
        entries = with_known(postings.select(key, *names), known, names)
    return entries.select(key, F.explode("entries").alias("e")).select(key, "e.*")
