"""A stored index of earlier records for near-duplicate runs.

Earlier records are kept as three tables, bucketed by what runs look up: the blocks of each distinct
fingerprint by (choice, bits), its first record by fingerprint, and the first record of each
canonical key.  A run explodes and shuffles its own records only; the stored side of each join is
read bucket by bucket, without an exchange.  What can matter to the run, the few stored records that
share a key or lie within the threshold, then goes to `dedup.duplicate_status` as `stored`, so the
outcome is the one of a run over all records.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.simhash import hamming
from ..session import cut_lineage
from . import dedup

COLUMNS = "record_id string, ordinal bigint, canonical_key string, fingerprint bigint"
TABLES = {
    "blocks": ("choice int, bits bigint, fingerprint bigint", "choice, bits"),
    "prints": (COLUMNS, "fingerprint"),
    "keys": (COLUMNS, "canonical_key"),
}


@dataclass(frozen=True)
class NearIndex:
    """The index in folder `path`; `buckets` is fixed when it is made."""

    path: str
    buckets: int = 64
    threshold: int = dedup.NEAR_HAMMING
    blocks: int = 6

    def _name(self, part: str) -> str:
        return f"near_{part}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"

    def table(self, spark: SparkSession, part: str) -> DataFrame:
        """One of the tables; an index of an earlier session is found by its folder."""
        columns, by = TABLES[part]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(part)} ({columns}) USING parquet "
                  f"CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{part}'")
        return spark.table(self._name(part))

    def _append(self, rows: DataFrame, part: str) -> None:
        spark = rows.sparkSession
        into = self.table(spark, part)
        by = [c.strip() for c in TABLES[part][1].split(",")]
        # One file a bucket and run.
        rows.select(*into.columns).repartition(self.buckets, *by).write.insertInto(self._name(part))
        spark.catalog.refreshTable(self._name(part))

    def related(self, rows: DataFrame) -> DataFrame:
        """The stored records that can decide the status of a row."""
        spark = rows.sparkSession
        prints = rows.select("fingerprint").distinct()
        own = dedup.block_keys(prints, self.threshold, self.blocks).withColumnRenamed("fingerprint", "asked")
        near = (self.table(spark, "blocks").join(dedup.merged(own), ["choice", "bits"])
                .where(hamming(F.col("fingerprint"), F.col("asked")) <= self.threshold)
                .select("fingerprint").distinct())
        found = self.table(spark, "prints").join(dedup.merged(near), "fingerprint", "left_semi")
        keyed = self.table(spark, "keys").join(
            dedup.merged(rows.select("canonical_key").distinct()), "canonical_key", "left_semi")
        return found.unionByName(keyed).distinct()

    def judge_and_add(self, rows: DataFrame, posting_token: str | None = None) -> DataFrame:
        """Status of each row (as of `dedup.fingerprints`) against the index and its own run.

        The rows are then added.  Their ordinals come after all stored ones.  A run that broke off
        while adding can be run again with the same rows.
        """
        rows = cut_lineage(rows)
        stored = cut_lineage(self.related(rows))
        # Rows that a broken-off run had added already are the run's own, not earlier ones.
        earlier = stored.join(dedup.merged(rows.select("ordinal")), "ordinal", "left_anti")
        status = cut_lineage(dedup.duplicate_status(
            rows, self.threshold, self.blocks, posting_token, stored=earlier))
        self._add(rows, stored)
        return status

    def _add(self, rows: DataFrame, stored: DataFrame) -> None:
        columns = ["record_id", "ordinal", "canonical_key", "fingerprint"]

        def firsts(by: str) -> DataFrame:
            fresh = rows.select(*columns).join(
                dedup.merged(stored.select(by).distinct()), by, "left_anti")
            return fresh.groupBy(by).agg(F.min("ordinal").alias("ordinal")).select("ordinal").join(
                dedup.merged(rows.select(*columns)), "ordinal")

        prints = cut_lineage(firsts("fingerprint"))
        self._append(firsts("canonical_key"), "keys")
        # The first records last: a fingerprint counts as added once it is there, and blocks that a
        # broken-off run had added are found twice, which changes no outcome.
        self._append(dedup.block_keys(prints.select("fingerprint"), self.threshold, self.blocks), "blocks")
        self._append(prints, "prints")
