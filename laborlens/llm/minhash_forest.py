"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document is the set of its distinct word shingles.  One signature of independent minima is read
in several orders, the trees.  In a tree, documents that agree in the first minima form a region;
a region is sorted by the minima that follow, so that its members with the longest common prefixes
stand next to each other, and every document is paired with the nearest neighbours that follow it.
A small region is compared in full that way.  A crowded one whose members are not yet one component
is then finished: it is dealt into blocks, and each pair of blocks is a group of its own, in which
all pairs of different components are compared.  Every pair is confirmed on the full sets.

Documents with equal sets are one class, compared once.  Null, empty and blank texts have an empty
set and link with nothing; a text of fewer words than a shingle is one shingle.  Rows that repeat
an id are one document, linked by any of its texts; rows without an id have no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import chunks, gather, text_buffer
from .common import components, cut_lineage, cut_narrow

SIGNATURE = 96
TREES = 16
NEIGHBOURS = 8
SORT_DEPTH = 8  # minima after the prefix that order a region, one byte of each
BLOCK_ROWS = 512  # documents and shingles of a block of a crowded region
BLOCK_SHINGLES = 1 << 18
MOST_BITS = 1 << 15
BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[0x20, *range(0x09, 0x0E)]] = True
PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, A-Z read as a-z; number of words before each text, and in all).

    A word's hash is a polynomial in its bytes, from differences of running sums: exact modulo
    2**64, since the base is odd and so has an inverse.
    """
    n = len(data)
    inside = ~BLANK_BYTES[data]
    begins = np.zeros(n, bool)
    starts_of_texts = edges[:-1][edges[:-1] < n]
    begins[0:1] = True
    begins[1:] = ~inside[:-1]
    begins[starts_of_texts] = True
    begins &= inside
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    value = _mixed(low.astype(np.uint64) + _MIX)
    value[~inside] = 0
    # Position in the word, so that the polynomial starts anew with each.
    length = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, length)
    most = int(place.max()) + 1
    powers = np.ones(most, np.uint64)
    np.multiply.accumulate(np.full(most - 1, PRIME, np.uint64), out=powers[1:])
    total = np.add.reduceat(value[starts[0]:] * powers[place], starts - starts[0])
    return _mixed(total), np.searchsorted(starts, edges)


def shingles(data: np.ndarray, edges: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, number of them before each text and in all)."""
    hashes, before = _word_hashes(data, edges)
    count = np.diff(before)
    width = np.minimum(count, words)
    n = np.where(count > 0, count - width + 1, 0)
    at = gather(before[:-1], n)
    of_text = np.repeat(np.arange(len(n)), n)
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        live = k < width[of_text]
        here = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(at) else hashes
        total = np.where(live, total * PRIME + here, total)
    total = _mixed(total)
    order = np.lexsort((total, of_text))
    total, of_text = total[order], of_text[order]
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (of_text[1:] != of_text[:-1])
    total, of_text = total[keep], of_text[keep]
    return total, np.searchsorted(of_text, np.arange(len(n) + 1))


def minima(values: np.ndarray, before: np.ndarray, size: int) -> np.ndarray:
    """Signatures [text, minimum] of texts that all have a shingle."""
    rng = np.random.Generator(np.random.PCG64(1))
    factor = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    extra = rng.integers(0, 2**63, size, dtype=np.uint64)
    out = np.empty((len(before) - 1, size), np.uint32)
    for k in range(size):
        mixed = (values * factor[k] + extra[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(mixed.astype(np.uint32), before[:-1])
    return out


def orders(trees: int, size: int) -> list[np.ndarray]:
    """The order in which each tree reads the minima."""
    rng = np.random.Generator(np.random.PCG64(2))
    return [rng.permutation(size) for _ in range(trees)]


def depth_for(share: float, trees: int, miss: float = 3e-4) -> int:
    """The deepest prefix at which a pair of that similarity agrees in some tree but for `miss`."""
    depth = 1
    while (1 - share ** (depth + 1)) ** trees <= miss:
        depth += 1
    return depth


def signed(docs: DataFrame, words: int, depth: int, key: str, text: str) -> DataFrame:
    """(key, n_shingles, set_a, set_b, trees): per tree the hashed prefix and the sort key."""
    reading = orders(TREES, SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                values, before = shingles(*text_buffer(part.column("text")), words)
                n = np.diff(before)
                rows = np.flatnonzero(n)
                set_a, set_b = np.zeros((2, len(n)), np.uint64)
                regions = np.zeros((len(n), TREES), np.uint64)
                deeper = np.zeros((len(n), TREES), np.uint64)
                if len(rows):
                    starts = before[:-1][rows]
                    set_a[rows] = np.add.reduceat(_mixed(values), starts)
                    set_b[rows] = np.add.reduceat(_mixed(values ^ _MIX), starts)
                    low = minima(values, np.append(starts, len(values)), SIGNATURE)
                    for t, order in enumerate(reading):
                        prefix = np.full(len(rows), t + 1, np.uint64)
                        for column in order[:depth]:
                            prefix = _mixed(prefix * PRIME + low[:, column])
                        rest = np.zeros(len(rows), np.uint64)
                        for column in order[depth:depth + SORT_DEPTH]:
                            rest = rest << np.uint64(8) | (low[:, column] & np.uint32(255))
                        regions[rows, t], deeper[rows, t] = prefix, rest
                lists = pa.array(np.where(n > 0, TREES, 0).cumsum().astype(np.int32) if len(n) else [], pa.int32())
                lists = pa.concat_arrays([pa.array([0], pa.int32()), lists])
                tree = pa.StructArray.from_arrays(
                    [pa.array(regions[rows].ravel().view(np.int64)),
                     pa.array(deeper[rows].ravel().view(np.int64))], names=["region", "deeper"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n.astype(np.int64)), pa.array(set_a.view(np.int64)),
                     pa.array(set_b.view(np.int64)), pa.ListArray.from_arrays(lists, tree)],
                    names=["key", "n_shingles", "set_a", "set_b", "trees"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_shingles bigint, set_a bigint, set_b bigint, "
             "trees array<struct<region:bigint,deeper:bigint>>")


def _region() -> Window:
    return Window.partitionBy("region").orderBy("deeper", "rep")


def _forest(classes: DataFrame) -> DataFrame:
    """A row per class and tree."""
    return classes.select("rep", "n_shingles", F.explode("trees").alias("t")).select(
        "rep", "n_shingles", "t.region", "t.deeper")


def candidates(forest: DataFrame, first: int, last: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that are `first` to `last` places apart in some tree's region.

    Only those whose sizes allow the similarity, and whose components, where known, differ.
    """
    own = F.struct("rep", "n_shingles", "component")
    after = F.array_compact(F.array(*[F.lead(own, k).over(_region()) for k in range(first, last + 1)]))

    def fits(x: Column) -> Column:
        return ((F.least(x["n_shingles"], "n_shingles") * 100
                 >= F.greatest(x["n_shingles"], "n_shingles") * percent)
                & (x["component"] != F.col("component")))

    return (forest.withColumn("after", after)
            .select("rep", F.explode(F.transform(F.filter("after", fits), lambda x: x["rep"])).alias("other"))
            .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
            .distinct())


def _sets(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(key, shingles): sorted distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                values, before = shingles(*text_buffer(part.column("text")), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.ListArray.from_arrays(
                        pa.array(before.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=["key", "shingles"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, shingles array<bigint>")


def _alike(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * shared >= F.lit(percent) * (a + b - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a"))
    second = sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return (pairs.join(first, "a").join(second, "b")
            .where(_alike(shared, F.size("of_a"), F.size("of_b"), percent)).select("a", "b"))


def _crowded(forest: DataFrame) -> DataFrame:
    """(rep, component, region, block, low, high): a row per pair of blocks that a member meets in.

    Only regions with members that no window of neighbours spans, and with several components.
    Members of a region's largest component need not meet one another: blocks from `others` on are
    theirs.
    """
    by_component = forest.groupBy("region", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    largest = F.max(F.struct("n", "component", "size"))
    regions = (by_component.groupBy("region")
               .agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts"),
                    largest.alias("most"))
               .where((F.col("n") > NEIGHBOURS + 1) & (F.col("parts") > 1)))

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK_ROWS, size / BLOCK_SHINGLES)).cast("int")

    regions = regions.select(
        "region", F.col("most.component").alias("home"),
        blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("others"),
        blocks(F.col("most.n"), F.col("most.size")).alias("own"))
    dealt = F.xxhash64("rep", "region")
    at_home = F.col("component") == F.col("home")
    block = F.when(at_home, F.col("others") + F.pmod(dealt, "own")).otherwise(F.pmod(dealt, "others")).cast("int")
    last = F.when(at_home, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    return (forest.join(regions, "region").withColumn("block", block)
            .select("rep", "component", "region", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
            .select("rep", "component", "region", "block", F.least("block", "other").alias("low"),
                    F.greatest("block", "other").alias("high")))


def _bitmaps(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per set, which remainders its hashes leave."""
    n = np.diff(before)
    width = min(max(64, 1 << int(4 * n.max() - 1).bit_length()), MOST_BITS)
    out = np.empty((len(n), width // 64), np.uint64)
    for k in range(0, len(n), 128):
        own = slice(int(before[k]), int(before[min(k + 128, len(n))]))
        flags = np.zeros((min(128, len(n) - k), width), bool)
        flags[np.repeat(np.arange(len(flags)), n[k:k + 128]), values[own] & np.uint64(width - 1)] = True
        out[k:k + 128] = np.packbits(flags, axis=1).view(np.uint64)
    return out


def block_links(block: np.ndarray, label: np.ndarray, values: np.ndarray, before: np.ndarray,
                percent: int) -> list[tuple[int, int]]:
    """Rows (i, j) whose sets are similar enough, as many as join all labels that such rows join.

    Rows of one block are compared with one another, rows of two blocks with those of the other.
    A remainder that only one set leaves is a shingle that the other lacks, so bitmaps bound what
    two sets share from above; pairs within the bound are counted in full.
    """
    label = np.unique(label, return_inverse=True)[1]
    n = np.diff(before)
    bits = _bitmaps(values, before)
    spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    low, high = (np.flatnonzero(block == b) for b in (block.min(), block.max()))
    alone = block.min() == block.max()
    found = []
    for k, i in enumerate(low.tolist()):
        j = high[k + 1:] if alone else high
        j = j[(label[j] != label[i])
              & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)]
        both = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        most = both + np.minimum(spare[i], spare[j])
        j = j[100 * most >= percent * (n[i] + n[j] - most)]
        if not len(j):
            continue
        own = values[before[i]:before[i + 1]]
        theirs = values[gather(before[j], n[j])]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[j]) - n[j])
        for other in j[100 * shared >= percent * (n[i] + n[j] - shared)].tolist():
            if label[other] != label[i]:
                found.append((i, other))
                label[label == label[other]] = label[i]
    return found


def crowded_links(forest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): components of which some members in one crowded region are similar enough."""
    kind = dict(forest.dtypes)["component"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        component = table.column("component").combine_chunks()
        lists = table.column("shingles").combine_chunks()
        before = lists.offsets.to_numpy().astype(np.int64)
        found = block_links(table.column("block").to_numpy(), component.to_numpy(zero_copy_only=False),
                            lists.flatten().to_numpy().view(np.uint64), before - before[0], percent)
        a, b = (pa.array([pair[k] for pair in found], pa.int64()) for k in range(2))
        return pa.table({"a": component.take(a), "b": component.take(b)})

    members = _crowded(forest)
    return (members.join(sets.withColumnRenamed("key", "rep"), "rep")
            .select("region", "low", "high", "block", "component", "shingles")
            .groupBy("region", "low", "high").applyInArrow(run, f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_shingles, component_id and kept (whether it is its
    component's smallest id).  Linked: 100 * shared shingles >= percent * shingles of either.
    """
    depth = depth_for(percent / 100, TREES)
    rows = cut_lineage(signed(docs.where(F.col(key).isNotNull()), words, depth, key, text))
    filled = rows.where("n_shingles > 0")
    equal = ["n_shingles", "set_a", "set_b"]
    reps = filled.groupBy(*equal).agg(F.min("key").alias("rep"))
    classes = (filled.join(reps, equal).where("key = rep").dropDuplicates(["rep", *equal]))
    # A row without another one in its region takes no part in what follows, and most rows have none.
    near = F.coalesce(F.lead("rep").over(_region()), F.lag("rep").over(_region()))
    forest = cut_narrow(_forest(classes).withColumn("near", near).where("near is not null")
                        .drop("near").withColumn("component", F.col("rep")))
    # Texts are shuffled once, to pick those that share a region with another.
    ids = forest.select(F.col("rep").alias(key)).distinct()
    sets = _sets(docs.select(key, text).join(ids, key, "left_semi"), words, key, text)
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates()  # rows that repeat an id and its text would repeat pairs
    sets = cut_lineage(sets)
    # Next neighbours first: pairs that these put into one component need no look any more, which
    # spares a crowded region most of its pairs and loses none.
    links = cut_narrow(confirmed(candidates(forest, 1, 1, percent), sets, percent))
    known = components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("found"))
    forest = forest.join(known, "rep", "left").withColumn("component", F.coalesce("found", "component"))
    links = links.union(confirmed(candidates(forest, 2, NEIGHBOURS, percent), sets, percent))
    members = filled.join(reps, equal).where("key != rep").select(
        F.col("rep").alias("a"), F.col("key").alias("b"))
    found = components(links.union(members), "a", "b").withColumnRenamed("node", "key")
    known = found.select(F.col("key").alias("rep"), F.col("component").alias("found"))
    forest = forest.select("rep", "n_shingles", "region").join(known, "rep", "left").withColumn(
        "component", F.coalesce("found", "rep")).drop("found")
    more = cut_narrow(crowded_links(forest, sets, percent))
    judged = rows.join(found, "key", "left").select(
        "key", "n_shingles", F.coalesce("component", "key").alias("part"))
    if more.isEmpty():
        judged = judged.withColumnRenamed("part", "component_id")
    else:
        joint = components(more, "a", "b").withColumnRenamed("node", "part")
        judged = judged.join(joint, "part", "left").withColumn(
            "component_id", F.coalesce("component", "part"))
    return (judged.select(F.col("key").alias(key), "n_shingles", "component_id")
            .withColumn("kept", F.col(key) == F.col("component_id"))
            .unionByName(docs.where(F.col(key).isNull()).select(
                key, F.lit(0).cast("long").alias("n_shingles"),
                F.lit(None).cast(dict(docs.dtypes)[key]).alias("component_id"),
                F.lit(None).cast("boolean").alias("kept"))))
