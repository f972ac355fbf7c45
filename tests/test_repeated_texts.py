"""Locations and compared texts are normalised once per distinct value, with the same outcome."""

import pytest
from pyspark.sql import functions as F

from laborlens.operators import collisions, validate

KINDS = [("Pune / Mumbai", "Java  dev"), ("  ", None), (None, ""), ("Atlantis, PUNE", " java DEV "), ("", "\t")]


def raw(spark):
    rows = [(str(k), *KINDS[k % 5]) for k in range(50)]
    known = spark.createDataFrame(rows, "jobid string, joblocation_address string, jobtitle string")
    return known.select("*", *[
        F.concat(F.lit(f" {c} "), (F.col("jobid") % 3).cast("int").cast("string")).alias(c)
        for c in validate.RAW_COLUMNS if c not in known.columns])


@pytest.mark.parametrize("most", [50_000, 1])
def test_locations_are_read_once(spark, monkeypatch, most):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    plain = validate.normalize_raw_rows(raw(spark), "s", at)
    located, real = [], validate.with_city_location
    monkeypatch.setattr(validate, "with_city_location", lambda df, *a: located.append(df.count()) or real(df, *a))
    monkeypatch.setattr("laborlens.operators.texts.MOST_TEXTS", most)
    once = validate.normalize_raw_rows(raw(spark), "s", at, repeated=True)
    assert located == [3 if most > 1 else 50]
    assert once.columns == plain.columns and sorted(map(repr, once.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("most", [50_000, 1])
def test_compared_texts_are_hashed_once(spark, monkeypatch, most):
    normalised, real = [], collisions.once_per_text
    monkeypatch.setattr(collisions, "once_per_text", lambda rows, columns, worked: real(
        rows, columns, lambda df: normalised.append(df.count()) or worked(df)))
    monkeypatch.setattr("laborlens.operators.texts.MOST_TEXTS", most)
    got = {r["jobid"]: r for r in collisions._hashed(
        raw(spark), F.col("jobid").alias("row")).withColumnsRenamed({"jobid": "hash", "row": "jobid"}).collect()}
    assert normalised == [15 if most > 1 else 50] and len(got) == 50
    assert got["0"]["jobtitle"] == got["3"]["jobtitle"] is not None
    assert all(got[k]["jobtitle"] is None for k in ("1", "2", "4"))
    assert got["1"]["joblocation_address"] is None and got["0"]["hash"] is not None
