"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Tokens are those of a byte-level `tokenizers` file: added tokens are cut out of a text first, as the
library does, the rest goes to the slice splitter of `bpe`, and each new slice is merged once.
Documents longer than a sequence are cut into full pieces, of which
the first may be shorter.  Only the number of pieces of each length, at most one number per
length, is needed to decide how sequences are filled: take the longest piece left, fill greedily
with the longest that still fits, then replace the sequence's smallest piece by the two unpacked
pieces that fill the larger gap best, if they fill it better.  A filling is made as often as the
counts allow, so the plan is a short list whatever the number of documents.  Spark numbers the
pieces of every length and looks their sequence up in the plan.

Null and empty texts are a document of the end token alone.  Repeated rows are packed each.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .batches import chunks, text_buffer
from .bpe import (
    MOST_VOCABULARY_BYTES, SLICED_BYTES, PairTable, SliceCache, encode_chunk, merge_together,
)
from .common import cut_lineage, gapless_rank


def _alphabet() -> dict[str, int]:
    """The letters that a byte-level tokenizer file writes bytes with: printable Latin-1 characters
    stand for themselves, the other bytes for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_tokenizer(content: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """(ids of the tokens, ids of the added tokens) of a byte-level BPE `tokenizers` file.

    Merging by id is merging in the file's order only if ids rise with the merges, which is checked.
    """
    told = json.loads(content)
    model, letters = told["model"], _alphabet()
    if model["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told["normalizer"]:
        raise ValueError("only byte-level BPE without normalisation is read")
    ids = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items()}
    made = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))]
            for pair in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("the ids of the tokens are not in the order of the merges")
    return ids, {t["content"].encode(): t["id"] for t in told["added_tokens"]}


@lru_cache(maxsize=2)
def _slices(content: str) -> tuple[SliceCache, re.Pattern | None]:
    """Slices to ids, and the added tokens that are cut out first; one per worker process."""
    ranks, added = read_tokenizer(content)
    pairs = PairTable(ranks)
    known = ranks | added
    whole = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
    return SliceCache(lambda new: merge_together(new, known, pairs)), whole


def pieces(docs: DataFrame, path: str, length: int = 2048, end_token: int = 0,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids): the token pieces; ids as little-endian 32-bit numbers."""
    size = os.path.getsize(path)
    if size > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {size} bytes, more than a vocabulary to broadcast may have")
    with open(path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, whole = _slices(content.value)
        for batch in batches:
            for part in chunks(batch, "text", SLICED_BYTES):
                ids, before = encode_chunk(*text_buffer(part.column("text")), cache, whole)
                n = np.diff(before) + 1
                full = np.full(before[-1] + len(n), end_token, np.dtype("<u4"))
                ends = np.cumsum(n)
                inner = np.ones(len(full), bool)
                inner[ends - 1] = False
                full[inner] = ids
                first = np.where(n > length, (n - 1) % length + 1, n)
                parts = 1 + (n - first) // length
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = np.where(piece > 0, first[row] + (piece - 1) * length, 0)
                size = np.where(piece > 0, length, first[row])
                bounds = np.append(np.cumsum(size) - size, len(full)) * 4
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)),
                    pa.Array.from_buffers(pa.binary(), len(row), [
                        None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(full.tobytes())]),
                ], names=["key", "piece", "start", "length", "ids"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, f"key {kind}, piece int, start bigint, length bigint, ids binary",
    ).withColumnRenamed("key", key)


def fillings(counts: dict[int, int], capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), by best-two-fit over counts of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} does not fit into {capacity}")
        left[size] += n
    longest = np.zeros(capacity + 1, np.int64)  # the longest length left that is at most so long

    def refresh() -> None:
        longest[:] = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    refresh()
    while longest[capacity]:
        # Take from a copy, as a sequence may hold several pieces of a length that runs out.
        held: list[int] = []
        gap = capacity
        used: Counter = Counter()

        def fitting(most: int) -> int:
            size = int(longest[most])
            while size and left[size] <= used[size]:
                size = int(longest[size - 1])
            return size

        while gap and (size := fitting(gap)):
            held.append(size)
            used[size] += 1
            gap -= size
        if gap and len(held) > 1:
            small = held[-1]
            room = gap + small
            used[small] -= 1
            free = left[:room + 1].copy()
            for size, n in used.items():
                if size <= room:
                    free[size] -= n
            there = np.flatnonzero(free > 0)
            reach = np.maximum.accumulate(np.where(free > 0, np.arange(room + 1), 0))
            one = there[there < room]
            two = reach[room - one]
            again = two == one  # the same length twice needs two pieces of it
            lone = again & (free[one] < 2)
            two[lone] = reach[np.maximum(one[lone] - 1, 0)]
            total = np.where(two > 0, one + two, 0)
            if len(total) and (best := int(total.argmax())) >= 0 and total[best] > small:
                held[-1:] = [int(one[best]), int(two[best])]
                used[int(one[best])] += 1
                used[int(two[best])] += 1
            else:
                used[small] += 1
        used = +used
        times = int(min(left[size] // n for size, n in used.items()))
        for size, n in used.items():
            left[size] -= n * times
        if any(left[size] == 0 for size in used):
            refresh()
        yield tuple(held), times


def pack(rows: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """`rows` (key, piece, length, ...) with `sequence_id` and `offset`; columns named so are replaced.

    Shuffles the columns it is given twice; leave ids out and join them back where they are large.
    """
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # one row per length
    # One span of ranks per place in a filling: piece number `rank` of a length goes to sequence
    # `sequence` + rank - `rank_from`.
    spans, taken, sequence = [], Counter(), 0
    for lengths, times in fillings(counts, capacity):
        offset = 0
        for size in lengths:
            spans.append((size, taken[size], sequence, offset))
            taken[size] += times
            offset += size
        sequence += times
    plan = rows.sparkSession.createDataFrame(
        _table(spans), "length bigint, rank bigint, sequence bigint, place bigint")
    others = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    ranked = gapless_rank(
        rows.select("length", F.struct(*others).alias("row"), F.col(key).alias("first"),
                    F.col("piece").alias("second")), ["length"], ["first", "second"], "rank")
    # As-of join by a window: the span that begins last before a piece's rank.  Ranks are dealt
    # into ranges that spans are repeated for at their lower end.
    wide = 1 << 12
    heads = plan.withColumn("until", F.coalesce(
        F.lead("rank").over(Window.partitionBy("length").orderBy("rank")) - 1, F.lit(None).cast("long")))
    most = F.col("most")
    ends = rows.groupBy("length").agg((F.count("*") - 1).alias("most"))
    heads = (heads.join(ends, "length").withColumn("until", F.coalesce("until", most)).drop("most")
             .withColumn("range", F.explode(F.sequence(F.floor(F.col("rank") / wide),
                                                       F.floor(F.col("until") / wide)))))
    found = (ranked.withColumn("range", F.floor(F.col("rank") / wide))
             .select("length", "range", "rank", "row", F.lit(1).alias("kind"),
                     F.lit(None).cast("struct<rank:bigint,sequence:bigint,place:bigint>").alias("span"))
             .unionByName(heads.select(
                 "length", "range", "rank", F.lit(None).alias("row"), F.lit(0).alias("kind"),
                 F.struct("rank", "sequence", "place").alias("span"))))
    order = Window.partitionBy("length", "range").orderBy("rank", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (found.withColumn("span", F.last("span", True).over(order)).where("kind = 1")
            .select("row.*",
                    (F.col("span.sequence") + F.col("rank") - F.col("span.rank")).alias("sequence_id"),
                    F.col("span.place").alias("offset")))


def _table(spans: list[tuple[int, int, int, int]]) -> pa.Table:
    columns = list(zip(*spans)) or [[], [], [], []]
    return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(
        ("length", "rank", "sequence", "place"), columns, strict=True)})


def sequences(docs: DataFrame, path: str, length: int = 2048, end_token: int = 0,
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """`pieces` with the place of each, ids included; written out, sorted by sequence and offset,
    they are the training sequences."""
    cut = cut_lineage(pieces(docs, path, length, end_token, key, text))
    return pack(cut, length, key)
