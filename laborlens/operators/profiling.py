"""Data-quality profiles of raw and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def column_profile(df: DataFrame, columns: list[str] | None = None, examples: int = 5) -> DataFrame:
    """Null count and share, exact distinct count and example values of every column.

    Columns are unpivoted and counted per (column, value), which combines on the map side;
    everything else comes from those counts.  Examples are the smallest values.
    """
    columns = columns or df.columns
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
          for c in columns]
    )
    counts = (
        df.select(F.explode(cells).alias("c")).select("c.*")
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.col("value").isNotNull()
    measures = counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        F.sum("n").alias("rows"),
        F.count("value").alias("unique_count"),
    )
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    shown = (
        counts.where(known).withColumn("rank", rank).where(F.col("rank") <= examples)
        .groupBy("column_name")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("example_values"))
    )
    return measures.join(shown, "column_name", "left").select(
        "column_name", "null_count",
        F.bround(100.0 * F.col("null_count") / F.col("rows"), 4).alias("null_percentage"),
        "unique_count", F.coalesce("example_values", F.lit("")).alias("example_values"),
    )


def repeated_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one (nulls equal)."""
    keys = subset or df.columns
    # Rows are compared by 128 bits of hash, so whole rows are not shuffled; a hash skips nulls,
    # hence the flags.
    parts = [x for c in keys for x in (F.col(c).isNull(), F.col(c))]
    prints = df.select(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))
    return prints.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value").limit(n)
        .select(F.lit(column).alias("column_name"), "value", "n")
    )


def subset_profile(
    df: DataFrame, where: Column, company: str, title: str, day: Column
) -> DataFrame:
    """One row over the rows that satisfy ``where``."""
    chosen = df.where(where).withColumn("_day", day)
    return chosen.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.countDistinct(company).alias("distinct_companies"),
        F.countDistinct(title).alias("distinct_job_titles"),
        F.min("_day").alias("earliest"), F.max("_day").alias("latest"),
    )


def posting_stats(postings: DataFrame) -> DataFrame:
    """Long form: totals, then postings per district and per source, from one small table."""
    cells = postings.groupBy("district", "source_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("district").isNotNull() & (F.col("district") != "")

    def total(test: Column | None) -> Column:
        return F.coalesce(F.sum("n" if test is None else F.when(test, F.col("n"))), F.lit(0))

    totals = cells.agg(
        total(None).alias("total"), total(named).alias("with_district"),
        total(~named | named.isNull()).alias("without_district"),
    ).select(
        F.inline(
            F.array(
                *[F.struct(F.lit("TOTAL").alias("measure"), F.lit(c).alias("key"),
                           F.col(c).alias("postings"))
                  for c in ("total", "with_district", "without_district")]
            )
        )
    )
    by_district = cells.where(named).groupBy(
        F.lit("DISTRICT").alias("measure"), F.col("district").alias("key")
    ).agg(F.sum("n").alias("postings"))
    by_source = cells.groupBy(
        F.lit("SOURCE").alias("measure"), F.col("source_id").alias("key")
    ).agg(F.sum("n").alias("postings"))
    return totals.unionByName(by_district).unionByName(by_source)
