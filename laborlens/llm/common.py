"""DataFrame helpers of this subpackage: gapless ranks and connected components."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_folder, cut_lineage

__all__ = ["components", "cut_lineage", "cut_narrow", "gapless_rank", "shared_folder"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; see `cut_lineage`."""
    return checkpoint_folder(spark)


def gapless_rank(df: DataFrame, groups: list[str], order: list[str], name: str,
                 buckets: int = 256) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without bringing a group into one task.

    A group is dealt into buckets by a hash of `order`; rows are numbered inside their bucket and
    start after the rows of the buckets before it.  Equal rows get different numbers.
    """
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*groups, "_bucket"]
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bucket")) - F.col("_n")
    starts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (rows.withColumn("_inside", inside).join(starts, keys)
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
            .drop("_bucket", "_inside", "_before"))


LINKS_PER_TASK = 50_000


def cut_narrow(df: DataFrame) -> DataFrame:
    """`cut_lineage` for rows of a few numbers: as many files as their count calls for.

    A checkpoint has a file for each partition, whatever is in it, and each file of a local file
    system costs two processes that the executor starts to set its mode.  Rows lie on the executors'
    disks until they are counted.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return cut_lineage(held.coalesce(held.count() // LINKS_PER_TASK + 1))
    finally:
        held.unpersist()


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _checksum(edges: DataFrame) -> tuple:
    mixed: Column = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected links; linked nodes only.

    Alternating large-star and small-star rounds.  Each round is a pre-aggregated minimum and a
    join with it, and lineage is cut every round.  The links of a node are never gathered; they are
    one key of the join, which Spark's adaptive skew join splits where a node has very many.
    The number of map tasks follows the number of links, so that many rounds over few links do not
    write a file for every pair of partitions.

    Links with a null end, loops and repeated links are ignored.
    """
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .distinct())
    edges = cut_narrow(edges)
    seen = _checksum(edges)
    for _ in range(most_rounds):
        tasks = seen[0] // LINKS_PER_TASK + 1
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
                 .coalesce(tasks).distinct().coalesce(tasks))
        small = large.join(_least(large), "u").coalesce(tasks)
        small = (small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small.select("u", F.col("m").alias("v"))).distinct())
        edges = cut_lineage(small.coalesce(tasks))
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    child = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return child.union(roots)
