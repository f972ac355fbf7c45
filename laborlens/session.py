"""Session helpers: the settings every operator here assumes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "laborlens", cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A small session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", str(32 << 20))
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data: what spark.checkpoint.dir names.

    Unset, a session on one machine (as in tests) gets a temporary folder; on a cluster that is an
    error, since executors do not share local folders.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isEmpty():
            return known.get()
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "checkpoints")
        context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; never a local one, which dies with its executor."""
    spark = df.sparkSession
    folder = checkpoint_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_once(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table in the shared folder, which many steps may read by column.

    Wide rows take a fraction of a checkpoint's disk there.  What the exchanges before it have left
    on the executors' disks is removed as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
