"""Facts stored by identity prefix: insert, update or skip, touching only what a run brings.

The table is Parquet, partitioned by the first hex digits of an identity hash, so that partitions
are even whatever the data.  A run finds the prefixes its rows have (there are 16 to the power of
`digits` at most), reads those partitions only, and writes back those in which something changed,
all in one commit of Spark's dynamic partition overwrite.  Running it again with the same rows
changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

PREFIX = "identity_prefix"
INSERTED, UPDATED, SKIPPED = "INSERTED", "UPDATED", "SKIPPED"


@dataclass(frozen=True)
class FactStore:
    """A table at `path`; rows are named by `key`, a hex hash.

    A stored row takes over the `updated` columns of a later one if any of the `compared` ones (by
    default the same) differs; without such columns the first row stays.  Others never change.
    """

    path: str
    key: str = "record_identity_hash"
    updated: tuple[str, ...] = ()
    compared: tuple[str, ...] = ()
    digits: int = 2
    files_per_prefix: int = 1

    def _prefix(self) -> Column:
        return F.substring(F.col(self.key), 1, self.digits)

    def read(self, spark: SparkSession, prefixes: list[str] | None = None,
             schema: DataFrame | None = None) -> DataFrame | None:
        """The stored rows, of some prefixes only if they are given; None before the first run."""
        try:
            if schema is None:
                schema = spark.read.parquet(self.path).drop(PREFIX)
            # A declared prefix, as digits alone would be read as numbers.
            stored = spark.read.schema(schema.withColumn(PREFIX, F.lit("")).schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return stored if prefixes is None else stored.where(F.col(PREFIX).isin(prefixes))

    def judged(self, batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        """(row, outcome): the rows of all given partitions as they should be stored.

        Stored rows that the batch does not name have no outcome.  Of rows of a batch that repeat a
        key one is taken, whichever sorts first by its updated columns; rows without a key are left out.
        """
        kept = [c for c in batch.columns if c not in (self.key, PREFIX)]
        fresh = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(
            F.min_by(F.struct(*kept), F.struct(*(self.updated or kept[:1]))).alias("new"))
        if stored is None:
            return fresh.select(F.struct(self.key, "new.*").alias("row"), F.lit(INSERTED).alias("outcome"))
        held = stored.select(self.key, F.struct(*kept).alias("old"))
        differs = F.lit(False)
        for name in self.compared or self.updated:
            differs = differs | ~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))
        outcome = (F.when(F.col("old").isNull(), INSERTED).when(F.col("new").isNull(), None)
                   .when(differs, UPDATED).otherwise(SKIPPED))
        values = [F.when(F.col("outcome") == INSERTED, F.col(f"new.{c}"))
                  .when((F.col("outcome") == UPDATED) & F.lit(c in self.updated), F.col(f"new.{c}"))
                  .otherwise(F.col(f"old.{c}")).alias(c) for c in kept]
        return (held.join(fresh, self.key, "full").withColumn("outcome", outcome)
                .select(F.struct(self.key, *values).alias("row"), "outcome"))

    def upsert(self, batch: DataFrame) -> DataFrame:
        """Store the batch; (key, outcome) of its rows."""
        spark = batch.sparkSession
        batch = cut_lineage(batch)
        prefixes = sorted(r[0] for r in batch.select(self._prefix().alias("p")).distinct().collect()
                          if r[0] is not None)
        stored = self.read(spark, prefixes, batch)
        rows = cut_lineage(self.judged(batch, stored).select("row.*", "outcome"))
        changed = [r[0] for r in rows.where(F.col("outcome").isin(INSERTED, UPDATED))
                   .select(self._prefix().alias("p")).distinct().collect()]
        if changed:
            (rows.drop("outcome").withColumn(PREFIX, self._prefix()).where(F.col(PREFIX).isin(changed))
             .repartition(F.col(PREFIX), F.pmod(F.xxhash64(self.key), F.lit(self.files_per_prefix)))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(PREFIX).parquet(self.path))
        return rows.where("outcome IS NOT NULL").select(self.key, "outcome")
