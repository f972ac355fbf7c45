"""Reversible line deduplication: sharded cuckoo filters in front of exact reference tables.

A line's key is the line without blanks at both ends and with A-Z in lower case; only keys of a
least length count.  The exact side of a store is the reference table (key, document) with, for
every key in enough documents, its count and its largest document.  The filter side holds a cuckoo
filter per shard of keys, with those repeated keys in it.  Documents can be added and taken away:
keys that reach the least count are inserted into their shard's filter, keys that fall below it
are deleted from it.  Lines are first put to the filter, which turns most away; what passes is
looked up in the exact table, so a false positive costs a lookup and never a line.

Null and empty texts are one empty line.  Rows that repeat a document id are one document, and
each keeps or loses its own lines.  Rows without an id take no part and lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, cut_narrow

# Fixed value: what is stripped at both ends of a line, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
KEYS_PER_FILTER = 1 << 16
LEAST_SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


class CuckooFilter:
    """Sixteen-bit fingerprints, four to a bucket, two buckets to a key; can forget a key again.

    A fingerprint that finds no place goes to a stash, so an insertion never fails.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, keys: int = 0, blob: bytes | None = None):
        if blob is not None:
            head = np.frombuffer(blob[:8], np.int64)
            buckets = int(head[0])
            body = np.frombuffer(blob[8:8 + buckets * self.SLOTS * 2], np.uint16)
            self.table = body.reshape(buckets, self.SLOTS).copy()
            rest = np.frombuffer(blob[8 + buckets * self.SLOTS * 2:], np.int64).reshape(-1, 2)
            self.stash = [tuple(map(int, x)) for x in rest]
        else:
            buckets = 4
            while buckets * self.SLOTS * 0.85 < keys:
                buckets *= 2
            self.table = np.zeros((buckets, self.SLOTS), np.uint16)
            self.stash = []

    def blob(self) -> bytes:
        stash = np.array(self.stash, np.int64).reshape(-1, 2)
        return np.int64(len(self.table)).tobytes() + self.table.tobytes() + stash.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.int64(len(self.table) - 1)
        print_ = (k2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (k1 >> np.int64(20)) & mask
        return print_, first, first ^ (self._turn(print_) & mask)

    @staticmethod
    def _turn(print_: np.ndarray) -> np.ndarray:
        mixed = print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(33)).astype(np.int64)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(k1, k2)
        found = ((self.table[first] == print_[:, None]).any(axis=1)
                 | (self.table[second] == print_[:, None]).any(axis=1))
        for kept, place in self.stash:
            found |= (print_ == kept) & ((first == place) | (second == place))
        return found

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        print_, first, second = self._places(k1, k2)
        mask = len(self.table) - 1
        table = self.table
        for p, a, b in zip(print_.tolist(), first.tolist(), second.tolist(), strict=True):
            for place in (a, b):
                free = np.flatnonzero(table[place] == 0)
                if len(free):
                    table[place, free[0]] = p
                    break
            else:
                place = b
                for kick in range(self.KICKS):
                    slot = (p + kick) % self.SLOTS
                    p, table[place, slot] = int(table[place, slot]), p
                    place ^= int(self._turn(np.array([p], np.uint16))[0]) & mask
                    free = np.flatnonzero(table[place] == 0)
                    if len(free):
                        table[place, free[0]] = p
                        break
                else:
                    self.stash.append((p, place))

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Only for keys that were inserted."""
        print_, first, second = self._places(k1, k2)
        for p, a, b in zip(print_.tolist(), first.tolist(), second.tolist(), strict=True):
            for place in (a, b):
                here = np.flatnonzero(self.table[place] == p)
                if len(here):
                    self.table[place, here[0]] = 0
                    break
                if (p, place) in self.stash:
                    self.stash.remove((p, place))
                    break


@dataclass
class LineStore:
    """refs (k1, k2, doc): the exact references; repeated (k1, k2, n_docs, top_doc, shard);
    filters (shard, blob)."""

    refs: DataFrame
    repeated: DataFrame
    filters: DataFrame
    shards: int
    least_chars: int
    least_docs: int


def references(docs: DataFrame, key: str = "doc_id", text: str = "text",
               least_chars: int = 40) -> DataFrame:
    """(k1, k2, doc), the distinct keys of each document as two 64-bit hashes."""
    keys = F.filter(F.transform(_lines(F.col(text)), line_key), lambda k: F.length(k) >= least_chars)
    line = F.explode(F.array_distinct(keys)).alias("line")
    return (docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), line)
            .select(_hash(F.col("line"), 1).alias("k1"), _hash(F.col("line"), 2).alias("k2"), "doc"))


def _counted(refs: DataFrame, least_docs: int) -> DataFrame:
    return (refs.groupBy("k1", "k2").agg(F.count_distinct("doc").alias("n_docs"),
                                         F.max("doc").alias("top_doc"))
            .where(F.col("n_docs") >= least_docs))


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(values)) + 1
    bounds = [0, *edges.tolist(), len(values)]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if b > a)


def _filters(changes: DataFrame) -> DataFrame:
    """Filters of all shards after changes (shard, turn, blob, k1, k2); turn 0: the filter as it
    was, 1: insert, 2: delete.  One filter and one batch of keys are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current, waiting = None, None, []

        def insert_waiting():
            nonlocal current, waiting
            if waiting or current is None:
                k1 = np.concatenate([x for x, _ in waiting]) if waiting else np.zeros(0, np.int64)
                k2 = np.concatenate([y for _, y in waiting]) if waiting else np.zeros(0, np.int64)
                current = current or CuckooFilter(max(len(k1), KEYS_PER_FILTER // 8))
                current.insert(k1, k2)
            waiting = []

        def done():
            insert_waiting()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([current.blob()], pa.binary())],
                names=["shard", "blob"])

        for batch in batches:
            shards, turns = batch.column("shard").to_numpy(), batch.column("turn").to_numpy()
            for a, b in _runs(shards * 3 + turns):
                if shards[a] != shard:
                    if shard is not None:
                        yield done()
                    shard, current, waiting = int(shards[a]), None, []
                if turns[a] == 0:
                    current = CuckooFilter(blob=batch.column("blob")[a].as_py())
                    continue
                k1 = batch.column("k1").slice(a, b - a).to_numpy()
                k2 = batch.column("k2").slice(a, b - a).to_numpy()
                if turns[a] == 1:
                    waiting.append((k1, k2))
                else:
                    insert_waiting()
                    current.delete(k1, k2)
        if shard is not None:
            yield done()

    ordered = changes.select("shard", "turn", "blob", "k1", "k2").repartition("shard")
    return ordered.sortWithinPartitions("shard", "turn").mapInArrow(run, "shard int, blob binary")


def _insertions(keys: DataFrame, turn: int = 1) -> DataFrame:
    return keys.select("shard", F.lit(turn).alias("turn"), F.lit(None).cast("binary").alias("blob"),
                       "k1", "k2")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40,
          least_docs: int = 5) -> LineStore:
    """The store of a set of documents; shards follow from the number of repeated keys."""
    refs = references(docs, key, text, least_chars)
    repeated = cut_narrow(_counted(refs, least_docs))
    shards = -(-repeated.count() // KEYS_PER_FILTER) or 1
    repeated = repeated.withColumn("shard", _shard(shards))
    filters = cut_lineage(_filters(_insertions(repeated)).coalesce(shards))
    return LineStore(refs, repeated, filters, shards, least_chars, least_docs)


def _changed(store: LineStore, refs: DataFrame, touched: DataFrame) -> LineStore:
    """The store after the references of `touched` keys (k1, k2) changed to those in `refs`."""
    touched = cut_lineage(touched.distinct())
    keys = ["k1", "k2"]
    now = cut_lineage(_counted(refs.join(touched, keys, "left_semi"), store.least_docs)
                      .withColumn("shard", _shard(store.shards)))
    was = store.repeated.join(touched, keys, "left_semi")
    changes = (store.filters.select("shard", F.lit(0).alias("turn"), "blob",
                                    F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
               .union(_insertions(now.join(was, keys, "left_anti"), 1))
               .union(_insertions(was.join(now, keys, "left_anti"), 2)))
    repeated = store.repeated.join(touched, keys, "left_anti").unionByName(now)
    return LineStore(refs, cut_lineage(repeated), cut_lineage(_filters(changes)), store.shards,
                     store.least_chars, store.least_docs)


def insert(store: LineStore, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineStore:
    """The store with further documents."""
    new = cut_lineage(references(docs, key, text, store.least_chars))
    return _changed(store, cut_lineage(store.refs.unionByName(new)), new.select("k1", "k2"))


def remove(store: LineStore, ids: DataFrame, key: str = "doc_id") -> LineStore:
    """The store without the documents of `ids`: what `insert` of them did is undone."""
    gone = ids.select(F.col(key).alias("doc")).distinct()
    touched = store.refs.join(gone, "doc", "left_semi").select("k1", "k2")
    refs = store.refs.join(gone, "doc", "left_anti").select("k1", "k2", "doc")
    return _changed(store, cut_lineage(refs), touched)


def _possible(refs: DataFrame, store: LineStore) -> DataFrame:
    """References whose key the filter of its shard may hold.

    Every partition is sorted so that a shard's filter comes right before its keys.  A shard is
    dealt over several salts, each with a copy of the filter, so that a key of very many documents
    is spread.
    """
    partitions = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(LEAST_SALTS, -(-4 * partitions // store.shards))
    probes = refs.select(_shard(store.shards).alias("shard"),
                         F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"),
                         F.lit(None).cast("binary").alias("blob"), "k1", "k2", "doc")
    kind = dict(refs.dtypes)["doc"]
    none = F.lit(None).cast("long")
    heads = store.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                                 "blob", none.alias("k1"), none.alias("k2"),
                                 F.lit(None).cast(kind).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            k1 = batch.column("k1").fill_null(0).to_numpy()
            k2 = batch.column("k2").fill_null(0).to_numpy()
            heads = set(np.flatnonzero(batch.column("blob").is_valid().to_numpy(False)).tolist())
            passed = np.zeros(len(shards), bool)
            cuts = sorted({0, len(shards), *heads, *(a for a, _ in _runs(shards))})
            for a, b in zip(cuts, cuts[1:]):
                if shards[a] != at:
                    at, current = shards[a], None
                if a in heads:
                    current = CuckooFilter(blob=batch.column("blob")[a].as_py())
                    a += 1
                if current is not None and b > a:
                    passed[a:b] = current.has(k1[a:b], k2[a:b])
            yield batch.filter(pa.array(passed)).select(["k1", "k2", "doc"])

    ordered = probes.union(heads).repartition("shard", "salt").sortWithinPartitions(
        "shard", "salt", F.col("blob").isNull())
    return ordered.mapInArrow(run, f"k1 bigint, k2 bigint, doc {kind}")


def apply(docs: DataFrame, store: LineStore, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `kept_text`, `n_lines` (before) and `n_dropped`.

    A repeated key loses its lines everywhere but in its largest document.  Columns of `docs` that
    are named as one of the three are replaced; all others are kept.
    """
    refs = references(docs, key, text, store.least_chars)
    drops = (_possible(refs, store).join(store.repeated, ["k1", "k2"])
             .where(F.col("doc") != F.col("top_doc"))
             .groupBy("doc").agg(F.collect_set("k1").alias("drops")))
    lines = _lines(F.col("text"))

    def stays(line: Column) -> Column:
        cleaned = line_key(line)
        return ~((F.length(cleaned) >= store.least_chars)
                 & F.array_contains("drops", _hash(cleaned, 1)))

    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, stays))
    # Columns of `docs` travel as one, so that their names meet none of these.
    others = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(key).alias("doc"), F.col(text).alias("text"))
    n_lines = F.size(lines).cast("long")
    return (rows.join(drops, "doc", "left").select("row", kept.alias("kept"), n_lines.alias("n_lines"))
            .select("row.*", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
                    F.array_join("kept", "\n").alias("kept_text")))
