"""Stateful ingest: remembered hashes, expiry and deliveries that repeat."""

from pyspark.sql import functions as F

from laborlens.streaming import seen

DAY = 86400


def delivered(spark, tmp_path, batches, horizon=10 * DAY, delay="90 days"):
    """(ordinal, disposition) in the order of delivery, one micro-batch each."""
    out = []
    path = str(tmp_path)
    for rows in batches:
        df = spark.createDataFrame(rows, "ordinal long, content_hash string, day string").withColumn(
            "at", F.to_timestamp("day"))
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        judged = seen.judged_stream(stream, "at", "ordinal", horizon, delay)
        query = seen.start_judging(judged, f"{path}/out", f"{path}/state")
        query.awaitTermination()
        assert query.exception() is None
        got = [(r["ordinal"], r["disposition"]) for r in spark.read.parquet(f"{path}/out").collect()]
        fresh = list(got)
        for batch in out:
            for row in batch:
                fresh.remove(row)
        out.append(sorted(fresh))
    return out


def test_hashes_are_remembered_and_expire(spark, tmp_path):
    a, b, c, d = (1, "x", "2024-01-01"), (2, "x", "2024-01-05"), (3, "y", "2024-01-05"), (4, "x", "2024-02-20")
    got = delivered(spark, tmp_path, [[a, b], [c, b], [d], [d, c], [(5, None, "2024-02-21"), (6, None, "2024-02-21")]])
    assert got == [
        [(1, "STAGED"), (2, "DUPLICATE")],
        [(2, "DUPLICATE"), (3, "STAGED")],
        [(4, "STAGED")],  # not seen for longer than the horizon
        [(3, "DUPLICATE"), (4, "DUPLICATE")],
        [(5, "STAGED"), (6, "DUPLICATE")],
    ]


def test_state_is_given_back_once_the_watermark_has_passed(spark, tmp_path):
    got = delivered(spark, tmp_path, [
        [(1, "x", "2024-01-01")], [(2, "z", "2024-06-01")], [(3, "w", "2024-06-02")],
        [(4, "x", "2024-06-03"), (5, "x", "2024-01-02")]], delay="1 day")
    assert got[0] == [(1, "STAGED")] and (4, "STAGED") in got[3]
    assert (5, "STAGED") not in got[3]  # too late to tell
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "state"))
    assert "x" in {r["key"]["content_hash"] for r in state.collect()}  # seen anew after it had expired


def test_the_provider_of_the_session_is_put_back(spark, tmp_path):
    before = spark.conf.get(seen.PROVIDER)
    delivered(spark, tmp_path, [[(1, "x", "2024-01-01")]])
    assert spark.conf.get(seen.PROVIDER) == before


def test_hashes_of_one_prefix_are_one_key_of_the_state(spark, tmp_path):
    """Calls to the state, which take most of the time, do not grow with the number of hashes."""
    first = [(k, f"abc{k:061x}", "2024-01-01") for k in range(2000)]
    again = [(10_000 + k, f"abc{k:061x}", "2024-01-02") for k in range(1000, 3000)]
    got = delivered(spark, tmp_path, [first, again])
    assert got[0] == [(k, "STAGED") for k in range(2000)]
    assert got[1] == [(10_000 + k, "DUPLICATE" if k < 2000 else "STAGED") for k in range(1000, 3000)]
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "state"))
    assert state.count() == 1


def test_hashes_of_one_prefix_expire_one_by_one(spark, tmp_path):
    got = delivered(spark, tmp_path, [
        [(1, "abcd", "2024-01-01"), (2, "abce", "2024-01-03")], [(3, "abcf", "2024-01-12")],
        [(4, "z", "2024-01-15")], [(5, "abcd", "2024-01-16"), (6, "abcf", "2024-01-16")],
        [(7, "z", "2024-03-01")], [(8, "z", "2024-03-02")]], delay="1 day")
    assert got[3] == [(5, "STAGED"), (6, "DUPLICATE")]
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "state"))
    assert {r["key"]["content_hash"] for r in state.collect()} == {"z"}  # the timer was set anew and fired
