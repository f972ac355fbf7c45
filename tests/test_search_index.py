"""Deep pages and the trigram index against sorting and scanning."""

import random

from pyspark.sql import functions as F

from laborlens.operators import search, trigrams

POSTINGS = "posting_id string, job_title string, description string, at string"


def postings(spark, rows):
    return spark.createDataFrame(rows, POSTINGS).withColumn("retrieved_at", F.to_timestamp("at")).drop("at")


def test_deep_pages_like_sorted_ones(spark):
    rng = random.Random(5)
    times = ["2024-01-01 10:00:00", "2024-01-01 10:00:30", "2024-01-01 10:07:00", "2024-01-01 23:59:59",
             "2024-01-02 00:00:00", "2024-03-05 12:00:00", None]
    rows = [(f"p{rng.randrange(10**6)}", rng.choice(["operator", "clerk"]), "x",
             rng.choices(times, [9, 2, 2, 1, 1, 1, 2])[0]) for _ in range(90)]
    df = postings(spark, rows).cache()
    whole = [r["posting_id"] for r in search.page_of_postings(df, limit=1000).collect()]
    for offset, limit, few in [(0, 5, 2), (3, 30, 4), (40, 7, 1), (60, 1, 100), (70, 20, 3), (82, 20, 2), (88, 5, 1),
                               (89, 1, 1), (90, 5, 1), (10**9, 5, 1)]:
        got = [r["posting_id"] for r in search.deep_page(df, limit=limit, offset=offset, few=few).collect()]
        assert got == whole[offset:offset + limit], (offset, limit, few)
    some = search.deep_page(df, "operator", limit=4, offset=20, few=1).collect()
    assert some == search.page_of_postings(df, "operator", limit=4, offset=20).collect()
    assert search.deep_page(postings(spark, []), limit=4).count() == 0


def test_a_deep_page_reads_its_span_only(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # show scans in full
    path = str(tmp_path / "rows")
    postings(spark, [(str(k), "t", "d", f"2024-01-{k % 28 + 1:02d} 10:00:00") for k in range(280)]).write.parquet(path)
    page = search.deep_page(spark.read.parquet(path), limit=5, offset=203, few=20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(retrieved_at" in plan and "LessThan(retrieved_at" in plan
    assert "TakeOrderedAndProject(limit=8" in plan  # three rows of the span before the page, not 203


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(9)
    words = ["kafka", "Kafkaesque", "mysql", "sql", "a", "ab", "día", "über", "x\ny", "k", "afk", "fka kaf", None]
    rows = [(str(k), rng.choice(words), " ".join(w or "" for w in rng.choices(words, k=rng.randrange(6))) or None, None)
            for k in range(150)]
    index = trigrams.TrigramIndex(str(tmp_path / "index"), buckets=3)
    index.add(postings(spark, rows[:100]))
    index.add(postings(spark, rows[100:]))
    df = postings(spark, rows)
    for query in ("kafka", "kafkae mysql", "sql", "zzz", "ab", "", "kafkas zzz", "KAFKA día"):
        wanted = search.keyword_search(df.withColumns(
            {"district": F.lit("d"), "source_id": F.lit("s")}), None, query, None)
        got = sorted(r["posting_id"] for r in index.search(df, query).collect())
        assert got == sorted(r["record_id"] for r in wanted.collect()), query
    plan = index.candidates(spark, "kafka mysql")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan and "In(trigram" in plan


def test_long_texts_and_missing_ones(spark, tmp_path):
    index = trigrams.TrigramIndex(str(tmp_path / "index"), buckets=2)
    df = postings(spark, [("long", "t", "word " * 200_000 + "needle", None), ("none", None, None, None)])
    index.add(df)
    assert [r["posting_id"] for r in index.search(df, "needle").collect()] == ["long"]


def test_trigrams_of_a_text_are_stored_once(spark, tmp_path):
    index = trigrams.TrigramIndex(str(tmp_path / "index"), buckets=2)
    one = postings(spark, [(str(k), "clerk", "kafka", None) for k in range(30)])
    more = postings(spark, [(str(k), "clerk", "KAFKA", None) for k in range(30, 40)] + [("n", "clerk", "mysql", None)])
    index.add(one)
    index.add(more)
    assert index._lookups(spark, ["kafka"]) and spark.read.parquet(f"{tmp_path}/index/counts").where(
        "trigram = 'kaf'").first()["count"] == 1  # 40 with a row per record
    found = index.search(one.unionByName(more), "kafka")
    assert sorted(int(r["posting_id"]) for r in found.collect()) == list(range(40))
