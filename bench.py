"""Wall time of the headline queries.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one JSON
line.  Each query is written to the no-op sink, so every row and column is computed.  Before the
first, the tables are copied with row groups of a size that all cores can read.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

import pyarrow.parquet as pq

from laborlens.plans.queries import QUERIES
from laborlens.session import local_session

ROWS_PER_GROUP = 1 << 15

HEADLINE = (
    "skill_gap", "skill_evidence", "skill_evidence_documents", "job_skill_profile",
    "skill_candidates", "skill_velocity_postings", "occupation_resolve", "district_demand",
    "identity_hash", "first_per_identity", "collision_groups", "ingest_accounting",
    "validate_rows", "locations_city", "locations_district", "column_profile", "simhash",
    "dedup_status", "nco_map", "keyword_search",
)


def laid_out(sf_dir: str) -> str:
    """The tables with row groups that several tasks can share, as a large table has them.

    The given files are a single row group each, which one task would have to read alone.
    """
    folder = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")
    for name in os.listdir(sf_dir):
        source = os.path.join(sf_dir, name)
        if name.endswith(".parquet") and os.path.isfile(source):
            table = pq.read_table(source)
            rows = max(256, min(ROWS_PER_GROUP, -(-table.num_rows // 16)))
            pq.write_table(table, os.path.join(folder, name), row_group_size=rows)
    return folder


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    sf_dir = laid_out(given)
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get(
        "BENCH_QUERIES") else HEADLINE
    QUERIES["monthly_status"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(given),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
