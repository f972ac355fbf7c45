"""Continuous ingest that remembers: keyed state of seen hashes in place of stored-key reads.

Each content hash holds the time it was last seen.  A record is staged if its hash is not held, and
a duplicate otherwise; a hash that was not seen for `horizon` expires.  Calls to the state cost far
more than judging a record, so the hashes of one prefix are one key: a batch reads and writes what is
held under the prefixes it brings, and Spark restores it with the offsets after a failure.  Records
that come later than the watermark allows are dropped, as their hash may have expired; a feed that is
delivered again must arrive within `delay`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1000  # timers count in milliseconds
PREFIX = 3  # characters; 4,096 keys of hexadecimal hashes


class SeenHashes(StatefulProcessor):
    """Per hash prefix: the rows of a batch in order of event time, judged against the last sightings."""

    def __init__(self, horizon_seconds: int):
        self.horizon = horizon_seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hashes array<string>, at array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        one: dict = {}  # copies of a hash are one object
        ordered = sorted(
            ((r["seen_ms"], r["ordinal"], one.setdefault(r["hash"], r["hash"])) for r in rows),
            key=lambda r: r[:2])
        held = self.last.get()
        before = {} if held is None else dict(zip(*held))
        after = dict(before)
        for at, _, content_hash in ordered:
            after[content_hash] = max(at, after.get(content_hash, at))
        self._hold(after, timerValues.getCurrentWatermarkInMs())
        if held is None:
            self.handle.registerTimer(max(after.values()) + self.horizon + 1)
        return self._judged(ordered, before)

    def _judged(self, ordered: list, last: dict) -> Iterator[Row]:
        for at, ordinal, content_hash in ordered:
            # A record from before the last sighting was seen within the horizon, or is late.
            known = last.get(content_hash)
            fresh = known is None or at - known > self.horizon
            last[content_hash] = at if known is None else max(at, known)
            yield Row(content_hash=content_hash, ordinal=ordinal,
                      disposition="STAGED" if fresh else "DUPLICATE")

    def _hold(self, last: dict, now: int) -> dict:
        """Write what has not expired at ``now``, and return it."""
        kept = {h: at for h, at in last.items() if at + self.horizon >= now}
        if kept:
            self.last.update((list(kept), list(kept.values())))
        else:
            self.last.clear()
        return kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        kept = self._hold(dict(zip(*held)) if held else {}, expiredTimerInfo.getExpiryTimeInMs())
        if kept:  # seen since the timer was set
            self.handle.registerTimer(max(kept.values()) + self.horizon + 1)
        return iter(())

    def close(self) -> None:
        pass


def judged_stream(records: DataFrame, event_time: str, ordinal: str, horizon_seconds: int,
                  delay: str, prefix: int = PREFIX) -> DataFrame:
    """(content_hash, ordinal, disposition) of a streaming DataFrame with `content_hash`.

    The state's key, `content_hash`, holds the first ``prefix`` characters of the hashes; a stream
    keeps the length that it was started with.
    """
    keyed = records.withWatermark(event_time, delay).select(
        F.substring("content_hash", 1, prefix).alias("content_hash"),
        F.col("content_hash").alias("hash"), F.col(ordinal).cast("bigint").alias("ordinal"), event_time,
        F.unix_millis(event_time).alias("seen_ms"))
    return keyed.groupBy("content_hash").transformWithState(
        statefulProcessor=SeenHashes(horizon_seconds),
        outputStructType="content_hash string, ordinal bigint, disposition string",
        outputMode="Append", timeMode="EventTime")


def start_judging(judged: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the judged records as Parquet; each batch is committed once by the sink's log."""
    spark = judged.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # timers and value state need it; read when the query starts
    try:
        return (
            judged.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
