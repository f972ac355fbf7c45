"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers.  A block of rows keeps, for every component and every binary
place, one bitmap over its rows.  A query adds the slices of all components, each as often as the
query's own bits say, with bitmap adders only, which yields the score of every row of the block as
a stack of bitmaps.  The best rows are then found from the most significant slice downward, and
rows that tie at the boundary are taken by smaller id.

Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no
part.  Vectors are compared only with vectors of as many components.  Rows with the query's id are
its own row and no candidates; other repeated rows are candidates each.  Repeated query rows with
equal vectors are one query.  Quantised components must stay below 2**26, so that scores are exact
64-bit integers; larger ones raise an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage

BLOCK_ROWS = 1 << 16
QUERY_ROWS = 128  # queries of a block, fewest and most
MOST_QUERIES = 1 << 12
PAIRS = 128  # pairs of blocks that are enough for many tasks
MOST = 1 << 26


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def _usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0) & fine)
            .select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v")))


def _check(values: np.ndarray) -> None:
    if values.size and max(-int(values.min()), int(values.max())) >= MOST:
        raise ValueError("quantised components reach 2**26: use a smaller scale")


class Slices:
    """The index of one block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        _check(values)
        rows, self.width = values.shape
        self.words = -(-max(rows, 1) // 64)
        self.low = values.min(axis=0).astype(np.int64)
        self.places = [int(x).bit_length() for x in values.max(axis=0) - self.low]
        self.maps = []  # [component][place]
        for d in range(self.width):
            column = values[:, d].astype(np.int64) - self.low[d]
            self.maps.append([self._bitmap(column >> p & 1) for p in range(self.places[d])])
        self.every = self._bitmap(np.ones(rows, np.int64))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[:len(bits)] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The bitmaps of score - base for all rows, least significant first, and base.

        A negative weight takes the complement of the component's slices; base makes up for it.
        """
        base = int(query @ self.low)
        columns: list[list[np.ndarray]] = []
        for weight, maps in zip(query.tolist(), self.maps, strict=True):
            if weight < 0:
                maps = [~m for m in maps]
                base += weight * ((1 << len(maps)) - 1)
            place, weight = 0, abs(weight)
            while weight:
                if weight & 1:
                    while len(columns) < place + len(maps):
                        columns.append([])
                    for k, bitmap in enumerate(maps):
                        columns[place + k].append(bitmap)
                weight >>= 1
                place += 1
        out, k = [], 0
        xor, both, either = np.bitwise_xor, np.bitwise_and, np.bitwise_or
        while k < len(columns):
            column = columns[k]
            if k + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:  # full adder: three bitmaps of a place to one and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                half = xor(a, b)
                carry = both(a, b)
                either(carry, both(half, c), out=carry)
                columns[k + 1].append(carry)
                column.append(xor(half, c, out=half))
            if len(column) == 2:
                a, b = column
                columns[k + 1].append(both(a, b))
                column[:] = [xor(a, b)]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            k += 1
        return out, base

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows, rows with the id `own` left out."""
        stack, base = self.sums(query)
        tied = self.every.copy()
        for row in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
            tied[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure = np.zeros_like(tied)
        n_sure = 0
        for bitmap in reversed(stack):
            high = tied & bitmap
            n = int(np.bitwise_count(high).sum())
            if n_sure + n > k:
                tied = high
            else:
                sure |= high
                n_sure += n
                tied &= ~bitmap
                if n_sure == k:
                    break
        rows = self._rows(sure)
        if n_sure < k:  # all that still tie have one score: smaller ids first
            rows = np.concatenate([rows, self._rows(tied)[:k - n_sure]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = np.full(len(rows), base, np.int64)
        for place, bitmap in enumerate(stack):
            score += (bitmap[word] >> bit & np.uint64(1)).astype(np.int64) << place
        return rows, score

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _query_blocks(queries: int, blocks: int) -> int:
    """How many blocks of queries meet `blocks` blocks of rows.

    A block of rows is sent once per block of queries, so there are only as many of these as tasks
    need, and as bound the queries of one.
    """
    return max(1, -(-queries // MOST_QUERIES), min(-(-queries // QUERY_ROWS), -(-PAIRS // blocks)))


def _values(data: bytes, itemsize: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"i{itemsize}").reshape(-1, width)


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """`blocks` blocks (width, block, ids, v, itemsize); v: values row by row, in 2 bytes if they fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        parts: dict[int, list] = {}
        for batch in batches:
            lists = batch.column("v")
            widths = np.diff(lists.offsets.to_numpy())
            ids, flat = batch.column("id").to_numpy(), lists.flatten().to_numpy()
            _check(flat)
            flat = flat.astype(np.int32)
            of_value = np.repeat(widths, widths)
            for width in np.unique(widths).tolist():
                parts.setdefault(width, []).append((ids[widths == width], flat[of_value == width]))
        for width, found in sorted(parts.items()):
            values = np.concatenate([y for _, y in found])
            if -1 << 15 <= values.min() and values.max() < 1 << 15:
                values = values.astype(np.int16)
            yield pa.RecordBatch.from_arrays([
                pa.array([width], pa.int32()), pa.array([block], pa.int32()),
                pa.array([np.concatenate([x for x, _ in found]).tobytes()], pa.binary()),
                pa.array([values.tobytes()], pa.binary()), pa.array([values.itemsize], pa.int32()),
            ], names=["width", "block", "ids", "v", "itemsize"])

    return cut_lineage(rows.repartition(blocks).mapInArrow(
        run, "width int, block int, ids binary, v binary, itemsize int"))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each row where `queries` holds, its k best other rows.

    Every block of queries meets every block of rows once; a block's own k best go on.
    """
    usable = _usable(vectors, key, vector, scale)
    n_rows = -(-usable.count() // BLOCK_ROWS) or 1
    asked = _usable(vectors.where(queries), key, vector, scale).dropDuplicates(["id", "v"])
    n_asks = _query_blocks(asked.count(), n_rows)
    rows, asks = _packed(usable, n_rows), _packed(asked, n_asks)
    rows = rows.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    asks = asks.select("width", F.col("block").alias("ask"), F.col("ids").alias("ask_ids"),
                       F.col("v").alias("ask_v"), F.col("itemsize").alias("ask_itemsize"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in range(batch.num_rows):
                width, ids, v, itemsize, ask_ids, ask_v, ask_itemsize = (
                    batch.column(c)[line].as_py() for c in (
                        "width", "ids", "v", "itemsize", "ask_ids", "ask_v", "ask_itemsize"))
                index = Slices(np.frombuffer(ids, np.int64), _values(v, itemsize, width))
                asked_ids = np.frombuffer(ask_ids, np.int64)
                found = []
                for own, query in zip(asked_ids.tolist(), _values(ask_v, ask_itemsize, width).astype(np.int64)):
                    at, score = index.top(query, own, k)
                    print_ = zlib.crc32(query.tobytes())
                    found.append((np.full(len(at), own), np.full(len(at), print_), index.ids[at], score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)],
                    names=["query_id", "print", "other", "score"])

    best = rows.join(asks, ["width", "block", "ask"]).mapInArrow(
        run, "query_id bigint, print bigint, other bigint, score bigint")
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "other")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("other").alias(key), "score"))
