"""Exact and near duplicates against everything seen earlier."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.identity import canonical_key
from ..functions.simhash import hamming, simhash64
from ..session import cut_lineage

NEAR_HAMMING = 3  # fixed value
SALTS = 8  # tasks that the copies of one fingerprint are spread over


def fingerprints(df: DataFrame, record_id: str, ordinal: str, fields: list[str],
                 keep: tuple[str, ...] = (), empty: int = 0) -> DataFrame:
    """(record_id, ordinal, canonical_key, fingerprint, columns of ``keep``); ``ordinal`` is the
    order of arrival, ``empty`` the fingerprint of records without text."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return df.select(
        F.col(record_id).alias("record_id"),
        F.col(ordinal).cast("bigint").alias("ordinal"),
        canonical_key({f: F.col(f) for f in fields}).alias("canonical_key"),
        simhash64(text, empty).alias("fingerprint"),
        *keep,
    )


def merged(right: DataFrame) -> DataFrame:
    """The right side of a join of records: sorted and merged, never sent to all tasks.

    Small columns of very many records pass for a small table, by the packed size of their exchange,
    and take several times that as a table of hashes, on the driver first.
    """
    return right.hint("merge")


def _block_masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_keys(rows: DataFrame, threshold: int = NEAR_HAMMING, blocks: int = 6) -> DataFrame:
    """The columns of ``rows`` with (choice, bits), one row per choice of blocks: two fingerprints
    within ``threshold`` bits agree on all bits of at least one choice."""
    keys = [
        F.struct(
            F.lit(i).alias("choice"),
            F.col("fingerprint").bitwiseAND(F.lit(_signed(sum(chosen)))).alias("bits"),
        )
        for i, chosen in enumerate(combinations(_block_masks(blocks), blocks - threshold))
    ]
    return rows.select("*", F.explode(F.array(*keys)).alias("k")).select(*rows.columns, "k.choice", "k.bits")


def earliest_near(
    firsts: DataFrame, threshold: int = NEAR_HAMMING, blocks: int = 6, crowded: int = 4096
) -> DataFrame:
    """(fingerprint, matched_ordinal): the earliest other fingerprint within ``threshold`` bits.

    ``firsts`` has one row per distinct fingerprint with its first ``ordinal``.  Cut into
    ``blocks`` blocks, two fingerprints that differ in at most ``threshold`` bits agree on at
    least ``blocks - threshold`` of them, so joining on every such choice of blocks finds every
    pair: exact, with keys of about 32 bits (six blocks, three agreeing).

    Buckets with one member are dropped before the join.  A crowded bucket is dealt into parts of
    about ``crowded`` members, and every pair of parts is a cell of its own, so no join key holds
    more than two parts.  Matches are reduced to the smallest ordinal as they are found; pairs are
    never kept.  With a boolean column ``stored`` only the rows where it is false are matched.
    """
    if "stored" not in firsts.columns:
        firsts = firsts.withColumn("stored", F.lit(False))
    keyed = block_keys(firsts.select("fingerprint", "ordinal", "stored"), threshold, blocks)
    sizes = (
        keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("choice", "bits", F.ceil(F.col("n") / crowded).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    dealt = (
        keyed.join(merged(sizes), ["choice", "bits"]).withColumn("part", part)
        .withColumn("against", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "choice", "bits", F.least("part", "against").alias("low"),
            F.greatest("part", "against").alias("high"), "fingerprint", "ordinal", "stored",
        )
    )
    cell = ["choice", "bits", "low", "high"]
    build = dealt.select(*cell, F.col("fingerprint").alias("other"),
                         F.col("ordinal").alias("other_ordinal"))
    return (
        dealt.where("not stored").join(merged(build), cell)
        .where(
            (F.col("other_ordinal") < F.col("ordinal"))
            & (hamming(F.col("fingerprint"), F.col("other")) <= threshold)
        )
        .groupBy("fingerprint").agg(F.min("other_ordinal").alias("matched_ordinal"))
    )


def duplicate_status(
    rows: DataFrame, threshold: int = NEAR_HAMMING, blocks: int = 6,
    posting_token: str | None = None, stored: DataFrame | None = None,
) -> DataFrame:
    """Classify each record against all earlier ones, those of ``stored`` included.

    EXACT_MATCH when its canonical key was seen before; otherwise NEAR_DUPLICATE when an
    earlier fingerprint is equal (first choice) or within ``threshold`` bits; otherwise
    DISTINCT.  With a ``posting_token`` column a near match on that very record is a REPOST.

    ``rows`` comes from :func:`fingerprints`, and so does ``stored``, the records of earlier runs,
    whose ordinals come before those of ``rows``; all ordinals are unique.  Stored records are not
    hashed again and not returned.

    Texts are hashed once: the narrow result is checkpointed.  Whether a record is the first of its
    key is answered by joining on the unique ordinal of each key's minimum; the join with the first
    record of a fingerprint is salted, so copies of one text are spread over several tasks.
    """
    tokens = [F.col(posting_token).alias("_token")] if posting_token else []
    columns = ["record_id", "ordinal", "canonical_key", "fingerprint"]
    rows = cut_lineage(rows.select(*columns, *tokens))
    known = rows.select(*columns, F.lit(False).alias("stored"))
    if stored is not None:
        known = known.unionByName(stored.select(*columns, F.lit(True).alias("stored")))
    first_of_key = known.groupBy("canonical_key").agg(F.min("ordinal").alias("ordinal")).select(
        "ordinal", F.lit(True).alias("new_key")
    )
    firsts = known.groupBy("fingerprint").agg(
        F.min("ordinal").alias("ordinal"), F.bool_or("stored").alias("stored"))
    named = firsts.join(merged(known.select("ordinal", "record_id")), "ordinal")
    near = earliest_near(firsts, threshold, blocks).join(
        merged(named.select(
            F.col("ordinal").alias("matched_ordinal"), F.col("record_id").alias("near_id")
        )),
        "matched_ordinal",
    )
    first_seen = named.join(merged(near.select("fingerprint", "near_id")), "fingerprint", "left").select(
        "fingerprint", F.col("ordinal").alias("first_ordinal"),
        F.col("record_id").alias("first_id"), "near_id",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    found = F.when(F.col("ordinal") > F.col("first_ordinal"), F.col("first_id")).otherwise(
        F.col("near_id")
    )
    near_label = F.lit("NEAR_DUPLICATE")
    if posting_token:
        near_label = F.when(F.col("_token") == F.col("found"), "REPOST").otherwise(near_label)
    return (
        rows.withColumn("salt", F.pmod("ordinal", F.lit(SALTS)).cast("int"))
        .join(merged(first_seen), ["fingerprint", "salt"])
        .withColumn("found", found)
        .join(merged(first_of_key), "ordinal", "left")
        .select(
            "record_id", "canonical_key", "fingerprint",
            F.when(F.col("new_key").isNull(), "EXACT_MATCH")
            .when(F.col("found").isNotNull(), near_label)
            .otherwise("DISTINCT").alias("status"),
            F.when(F.col("new_key"), F.col("found")).alias("matched_record_id"),
        )
    )
