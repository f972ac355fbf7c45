"""Shards by jump consistent hashing: no ring table, and a further shard takes rows only into itself.

A row's shard depends on its key columns and the number of shards alone, so repeated rows share a
shard and null keys have one defined shard.  Texts play no part; null texts count no bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import gapless_rank

RECORD_BYTES = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key.  The jumps get longer, so about log(shards) rounds are made."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((at[live] + 1) * scale).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(shards: int, *keys: Column) -> Column:
    """Shard column; the keys are mixed first, so counting ids spread as well as random ones."""

    @pandas_udf("int")
    def jumped(mixed: pd.Series) -> pd.Series:
        return pd.Series(jump(mixed.to_numpy(np.int64), shards))

    return jumped(F.xxhash64(*keys))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, shard, slot (gapless from 0) and the shard with one more.

    Only numbers are shuffled.  Slots follow a hash of the key; equal keys follow one another.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    mixed = F.col(key)
    rows = docs.select(
        F.col(key).alias(key), (F.octet_length(raw) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), shard_of(shards, mixed).alias("shard"),
        shard_of(shards + 1, mixed).alias("grown_shard"))
    return gapless_rank(rows, ["shard"], [key, "size", "text_crc32"], "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard."""
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
