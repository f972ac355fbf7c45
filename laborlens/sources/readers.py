"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import strip
from ..operators.validate import RAW_COLUMNS

# The tokens a profiling read treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def raw_postings_csv(
    spark: SparkSession, path: str, columns: tuple[str, ...] = RAW_COLUMNS, blank_na: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Header CSV, every column a string.

    Files are split over tasks.  With ``multiline`` quoted values may hold line breaks, and a file
    is one task then.

    Bytes that are not UTF-8 become replacement characters.  ``blank_na`` also turns the usual
    missing-value tokens into nulls, for profiling.
    """
    df = (
        spark.read.schema(_strings(*columns))
        .option("header", True).option("multiLine", multiline).option("escape", '"')
        .option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    )
    if blank_na:
        df = df.select(*[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) for c in df.columns])
    return df


SNAPSHOT_RECORD = _strings(
    "source_record_id", "job_title", "employer_name", "state", "district", "sector", "location",
    "description", "min_education", "experience_years", "salary", "posted_date",
)
SNAPSHOT = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "classification", "source_id", "source_name", "retrieval_date", "access_method",
        "freshness_class", "url")]
    + [T.StructField("records", T.ArrayType(SNAPSHOT_RECORD))]
)


def posting_snapshot_json(
    spark: SparkSession, path: str, classification: str = "UNVERIFIED_OR_SYNTHETIC"
) -> DataFrame:
    """Records of snapshot files whose classification allows this route, with their source."""
    return (
        spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
        .where(F.col("classification") == classification)
        .select("source_id", "retrieval_date", F.explode("records").alias("r"))
        .select("source_id", "retrieval_date", "r.*")
    )


TRADE = _strings("trade_name", "unit_category", "intake")
INSTITUTE_FIELDS = (
    "institute_name", "institute_code", "ncvt_mis_code", "institute_category", "address",
    "establishment_year", "establishment_gr", "hostel_capacity", "district", "state",
)
INSTITUTE = T.StructType(
    list(_strings(*INSTITUTE_FIELDS)) + [T.StructField("trades", T.ArrayType(TRADE))]
)
INSTITUTE_SNAPSHOT = T.StructType(
    list(_strings("source_id", "source_name", "publisher", "url", "access_method",
                  "freshness_class", "retrieval_date", "coverage", "verification_status"))
    + [T.StructField("total_institutes", T.IntegerType()),
       T.StructField("institutes", T.ArrayType(INSTITUTE))]
)


def institute_snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per institute of the snapshot files, trades still nested."""
    return (
        spark.read.schema(INSTITUTE_SNAPSHOT).option("multiLine", True).json(path)
        .select("source_id", F.explode("institutes").alias("i")).select("source_id", "i.*")
    )


def reference_occupations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Occupation reference table; rows without code or title are dropped.

    ``entry_order`` follows the file: it decides ties, so a table that is itself split over
    files must bring its own order.
    """
    raw = (
        spark.read.schema(_strings("nco_code", "occupation_title", "division", "group_name",
                                   "source_reference", "authoritative"))
        .option("header", True).option("escape", '"').csv(path)
    )
    return reference_occupations(raw.withColumn("entry_order", F.monotonically_increasing_id()))


def reference_occupations(raw: DataFrame) -> DataFrame:
    trimmed = raw.select(
        "entry_order",
        *[strip(F.coalesce(c, F.lit(""))).alias(c) for c in (
            "nco_code", "occupation_title", "division", "group_name", "source_reference")],
        F.lower(strip(F.coalesce("authoritative", F.lit("")))).isin("true", "1", "yes")
        .alias("is_authoritative"),
    )
    return trimmed.where("nco_code <> '' AND occupation_title <> ''")


def ontology_json(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """``skills`` or ``occupations`` of an ontology file, in file order."""
    fields = {
        "skills": ("skill_id", "canonical_skill_name", "skill_category"),
        "occupations": ("occupation_id", "canonical_occupation_name", "sector"),
    }[entity]
    item = T.StructType(
        list(_strings(*fields, "source_reference", "verification_status", "version"))
        + [T.StructField("aliases", T.ArrayType(T.StringType()))]
    )
    schema = T.StructType([T.StructField(entity, T.ArrayType(item))])
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.posexplode(entity).alias("seed_order", "e")).select("seed_order", "e.*")
    )


def trade_mapping_json(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Bridge file of trades to ``skill_id`` or ``occupation_id``."""
    item = _strings("canonical_trade_name", target, "mapping_status", "evidence_source")
    schema = T.StructType([T.StructField("mappings", T.ArrayType(item))])
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.explode("mappings").alias("m")).select("m.*")
        .withColumnRenamed("canonical_trade_name", "trade")
    )


def collision_groups_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(_strings(
            "identity", "collision_size", "classification", "jobids", "uniq_ids", "job_titles",
            "companies", "locations", "post_dates", "reason", "confidence"))
        .option("header", True).option("escape", '"').csv(path)
    )


def metrics_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A persisted one-row report (or any JSON table) with a declared schema."""
    return spark.read.schema(schema).json(path)


def with_ordinal(read: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the rows of a file read 0, 1, 2, ...: files by path, then place in the file.

    Two passes over the files and no sort of rows: the first counts the rows of each block that a
    task reads, the second adds a row's place in its block to what stands before the block.  Only
    the table of blocks, one row per block, is ordered as a whole.  ``read`` comes straight from a
    reader, and its files stay as they are in between.
    """
    placed = read.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = blocks.select("_file", "_block", "_first", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, ["_file", "_block"]).select(
        *read.columns, (F.col("_start") + F.col("_at") - F.col("_first")).cast("bigint").alias(name))
