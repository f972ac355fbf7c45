"""Checkpoints of narrow rows have as many files as their rows call for."""

from pathlib import Path

from pyspark.sql import functions as F

from laborlens.llm import line_dedup, minhash_forest, suffix_dedup
from laborlens.llm.common import cut_narrow
from laborlens.session import checkpoint_folder

PARTITIONS = 60


def test_files_follow_rows(spark):
    few = cut_narrow(spark.range(1000).repartition(40))
    assert few.rdd.getNumPartitions() == 1 and few.count() == 1000
    many = cut_narrow(spark.range(120_000).repartition(40))
    assert many.rdd.getNumPartitions() == 3 and many.agg(F.sum("id")).first()[0] == 120_000 * 119_999 // 2
    assert cut_narrow(spark.range(0)).count() == 0


def test_stages_write_few_checkpoint_files(spark):
    """Before, each of a dozen checkpoints had a file for each shuffle partition."""
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{passage} {'end' if k % 2 else 'stop'}\nline {k}\n" + "a line that stands in many texts of these, long enough\n"
             + " ".join(f"own{k}x{j}" for j in range(k))) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    settings = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    held = set(folder.rglob("part-*"))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for run in (lambda: minhash_forest.near_duplicates(docs), lambda: suffix_dedup.remove_repeats(docs, 100),
                    lambda: line_dedup.build(docs).filters):
            assert run().count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Texts and their sets are dealt to all tasks; what else is kept is narrow.
    assert len(set(folder.rglob("part-*")) - held) < 4 * PARTITIONS
