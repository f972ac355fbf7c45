"""Substring search through a stored index of character trigrams.

The index has one row per trigram and distinct text, bucketed and sorted by trigram, a small table
of how many texts each trigram has, and one narrow row per record that names its text.  A search token
that is contained in a text has all its trigrams there, so the texts that hold the rarest few of them
are candidates; only their records are fetched and verified.  Reading the postings of a trigram opens
one bucket and, in it, few row groups.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import query_tokens
from .search import keyword_hit

LOOKED_UP = 3  # trigrams of a token that are intersected, the rarest first
TRIGRAMS, RECORDS = "trigram string, text_key binary", "text_key binary, record_id string"


def search_text(*fields: str) -> Column:
    """What `keyword_hit` searches: the fields, joined and in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def _text_key(text: Column) -> Column:
    """What stands for a text: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _trigrams(text: Column) -> Column:
    """Every three characters that stand together, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def _of(token: str) -> list[str]:
    return sorted({token[k:k + 3] for k in range(len(token) - 2)})


@dataclass(frozen=True)
class TrigramIndex:
    """The index in folder `path` over `fields` of records named by `key`."""

    path: str
    fields: tuple[str, ...] = ("job_title", "description")
    key: str = "posting_id"
    buckets: int = 64

    def _table(self, spark: SparkSession, kind: str, schema: str, key: str) -> str:
        name = f"{kind}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key})"
                  f" SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
        return name

    def _postings(self, spark: SparkSession) -> str:
        return self._table(spark, "trigrams", TRIGRAMS, "trigram")

    def _records(self, spark: SparkSession) -> str:
        return self._table(spark, "records", RECORDS, "text_key")

    def add(self, records: DataFrame) -> None:
        """Index records that are not in it yet.  A frequent trigram is dealt over several tasks.

        A text's trigrams are stored when it is first met, its later copies add a record only.
        """
        spark = records.sparkSession
        name, held = self._postings(spark), self._records(spark)
        text = search_text(*self.fields)
        rows = records.select(text.alias("text"), F.col(self.key).cast("string").alias("record_id"))
        texts = rows.select("text").distinct().withColumn("text_key", _text_key(F.col("text")))
        new = texts.join(spark.table(held).select("text_key").distinct(), "text_key", "left_anti")
        new.select(F.explode(_trigrams(F.col("text"))).alias("trigram"), "text_key").sortWithinPartitions(
            "trigram").write.insertInto(name)
        rows.select(_text_key(F.col("text")).alias("text_key"), "record_id").sortWithinPartitions(
            "text_key").write.insertInto(held)
        spark.catalog.refreshTable(name)
        spark.catalog.refreshTable(held)
        counts = spark.table(name).groupBy("trigram").count()  # bucketed: without an exchange
        counts.write.mode("overwrite").parquet(f"{self.path}/counts")

    def _lookups(self, spark: SparkSession, tokens: list[str]) -> list[tuple[str, str]]:
        """(token, trigram) pairs to look up; a token with an unknown trigram is contained nowhere."""
        wanted = sorted({t for token in tokens for t in _of(token)})
        counts = {r["trigram"]: r["count"] for r in spark.read.parquet(f"{self.path}/counts")
                  .where(F.col("trigram").isin(wanted)).collect()}  # a row per trigram of the query
        return [(token, t) for token in tokens if all(t in counts for t in _of(token))
                for t in sorted(_of(token), key=lambda t: (counts[t], t))[:LOOKED_UP]]

    def candidates(self, spark: SparkSession, query: str) -> DataFrame:
        """(record_id) of the records that may contain a token of the query."""
        lookups = self._lookups(spark, sorted(set(query_tokens(query))))
        if not lookups:
            return spark.createDataFrame([], "record_id string")
        needed = {token: sum(1 for t, _ in lookups if t == token) for token, _ in lookups}
        by_trigram: dict[str, list[str]] = {}
        for token, trigram in lookups:
            by_trigram.setdefault(trigram, []).append(token)
        tokens = F.lit(None).cast("array<string>")
        for trigram, of in by_trigram.items():
            tokens = F.when(F.col("trigram") == trigram, F.lit(of)).otherwise(tokens)
        enough = F.lit(False)
        for token, n in needed.items():
            enough = enough | ((F.col("token") == token) & (F.col("n") == n))
        postings = spark.table(self._postings(spark)).where(F.col("trigram").isin(list(by_trigram)))
        texts = (postings.select("text_key", F.explode(tokens).alias("token"))
                 .groupBy("text_key", "token").agg(F.count(F.lit(1)).alias("n")).where(enough)
                 .select("text_key").distinct())
        return spark.table(self._records(spark)).join(texts, "text_key", "left_semi").select("record_id")

    def search(self, records: DataFrame, query: str) -> DataFrame:
        """The records that contain any token of the query, as `search.keyword_search` finds them."""
        found = self.candidates(records.sparkSession, query)
        rows = records.join(found, F.col(self.key).cast("string") == F.col("record_id"), "left_semi")
        return rows.where(keyword_hit(query_tokens(query), *[F.col(f) for f in self.fields]))
