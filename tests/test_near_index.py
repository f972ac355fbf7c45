"""The stored near-duplicate index decides as a run over all records does."""

import random

from laborlens.operators import dedup
from laborlens.operators.near_index import NearIndex

ROWS = "record_id string, ordinal bigint, canonical_key string, fingerprint bigint"


def records(seed, start, n):
    rng = random.Random(seed)
    base = [random.Random(k).getrandbits(64) for k in range(12)]  # the same in every run
    rows = []
    for k in range(n):
        print_ = rng.choice(base)
        for bit in rng.sample(range(64), rng.choice([0, 0, 1, 3, 5])):
            print_ ^= 1 << bit
        print_ -= (1 << 64) if print_ >> 63 else 0
        rows.append((f"r{start + k}", start + k, f"key{rng.randrange(60)}", print_))
    return rows


def told(df):
    return sorted(tuple(r) for r in df.select("record_id", "status", "matched_record_id").collect())


def test_runs_like_one_table(spark, tmp_path):
    index = NearIndex(str(tmp_path / "index"), buckets=3)
    earlier = []
    for run in range(3):
        rows = records(run, 1000 * run, 30)
        new = spark.createDataFrame(rows, ROWS)
        wanted = dedup.duplicate_status(
            new, stored=spark.createDataFrame(earlier, ROWS) if earlier else None)
        got = told(index.judge_and_add(new))
        assert got == told(wanted)
        earlier += rows
    assert {s for _, s, _ in got} >= {"EXACT_MATCH", "NEAR_DUPLICATE"}
    prints = index.table(spark, "prints")
    assert prints.count() == prints.select("fingerprint").distinct().count() == len({r[3] for r in earlier})
    assert told(index.judge_and_add(new)) == got  # the last run once more


def test_a_run_shuffles_its_own_records_only(spark, tmp_path):
    index = NearIndex(str(tmp_path / "index"), buckets=3)
    index.judge_and_add(spark.createDataFrame(records(1, 0, 30), ROWS))
    prints = spark.createDataFrame(records(2, 1000, 5), ROWS).select("fingerprint").distinct()
    own = dedup.block_keys(prints).hint("merge")
    plan = index.table(spark, "blocks").join(own, ["choice", "bits"])._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.rindex("SortMergeJoin"):] if "SortMergeJoin" in plan else plan
    scan = stored[:stored.index("FileScan parquet")] if "FileScan parquet" in stored else ""
    assert "Bucketed: true" in plan and "Exchange" not in scan
    assert index.related(spark.createDataFrame([("x", 1, "none", 77)], ROWS)).count() == 0


def test_no_records_are_sent_to_the_driver(spark, tmp_path):
    """Few as they are here, records are joined by sorting: many would not fit as a table of hashes."""
    index = NearIndex(str(tmp_path / "index"), buckets=3)
    rows = spark.createDataFrame(records(1, 0, 30), ROWS)
    index.judge_and_add(rows)
    for df in (index.related(rows), dedup.duplicate_status(rows, stored=spark.createDataFrame(records(2, 100, 9), ROWS))):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
