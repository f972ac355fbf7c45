"""Removal of passages that occur earlier, exact to the byte.

Every byte covered by a string of `length` bytes that also starts earlier (in a smaller document,
or before in the same one) goes.  Equal strings of that length hold the same smallest gram at the
same place, so the start positions that share a smallest gram can be judged together, group by
group, wherever they occur:

1. Documents give their anchors, the smallest gram of each run of start positions, with a hash of
   all bytes those strings cover.  Shuffled by gram, occurrences with equal bytes are decided at
   once: all but the earliest go.  Grams that occur with different bytes are looked at closer.
2. Their contexts are fetched from the texts, sorted to both sides of the gram, and cut to what
   some other context shares.  What is then equal is decided; the contexts that are left different
   are joined into one text per pool of groups, whose suffix array brings equal strings together.
   A group that fills more than a pool is split over several, whose strings are compared by hash.
3. Spans to remove go back to their documents.

Null and empty texts stay as they are.  Rows that repeat an id with an equal text are one document.
Of an id with different texts, the text of smallest hash is the document; its other rows, and rows
without an id, take no part and are returned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import chunks, gather, text_buffer
from .common import cut_lineage, cut_narrow
from .suffix_array import suffix_array

GRAM = 32
SEGMENT = 1 << 18  # bytes that are worked on at a time, which bounds a task's memory
POOL_BYTES = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Value of each byte, and for each base its powers and those of its inverse."""
    powers = []
    for base in _BASES:
        pair = []
        for factor in (base, pow(base, -1, 1 << 64)):
            out = np.full(SEGMENT + 4096, np.uint64(factor))
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        powers.append(tuple(pair))
    return _mixed(np.arange(256, dtype=np.uint64) + _MIX), powers


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram hash, bytes hash, anchor, first start, last start) of every run of start positions.

    `starts`: the increasing positions in `data` at which strings of `length` bytes are judged.
    """
    values, powers = _tables()
    code = values[data]
    gram, have = code, 1
    while have < GRAM:
        gram = gram[:len(gram) - have] * np.uint64(pow(_BASES[0], have, 1 << 64)) + gram[have:]
        have *= 2
    gram = _mixed(gram)
    mask = np.uint64((1 << 24) - 1)
    ranked = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)  # leftmost of equal grams
    least = (_least(ranked, length - GRAM + 1)[starts] & mask).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    anchor, low, high = least[first], starts[first], starts[last]
    covered = np.zeros(len(first), np.uint64)
    for power, inverse in powers:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:len(code)], dtype=np.uint64)])
        covered = _mixed(covered + (total[high + length] - total[low]) * inverse[low])
    where = ((anchor - low) << 16 | (high - low)).astype(np.uint64)
    return gram[anchor], _mixed(covered ^ _mixed(where)), anchor, low, high


def _segments(data: np.ndarray, edges: np.ndarray, length: int):
    """(row, offset in its text, bytes, starts, row of each start, its text's offset) in bounded parts."""
    row = 0
    while row < len(edges) - 1:
        stop = int(np.searchsorted(edges, edges[row] + SEGMENT, side="right")) - 1
        if stop > row:  # whole texts
            part = data[edges[row]:edges[stop]]
            sizes = np.maximum(np.diff(edges[row:stop + 1]) - length + 1, 0)
            begins = edges[row:stop] - edges[row]
            yield part, gather(begins, sizes), np.repeat(np.arange(row, stop), sizes), \
                np.repeat(begins, sizes), 0
            row = stop
        else:  # a long text, in overlapping parts
            at, end = int(edges[row]), int(edges[row + 1])
            while at + length <= end:
                part = data[at:min(at + SEGMENT, end)]
                n = len(part) - length + 1
                yield part, np.arange(n), np.full(n, row), np.zeros(n, np.int64), at - int(edges[row])
                at += n
            row += 1


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """(key, bytes, doc, place, range): place of the anchor in its text; range: bytes before it
    and number of start positions.

    Of occurrences with equal bytes only the earliest of each part of the input goes on, keyed by
    its gram.  The others are repeats for certain: bytes is null, and the key deals them evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SEGMENT):
                data, edges = text_buffer(part.column("text"))
                found = []
                for piece, starts, row, begin, shift in _segments(data, edges, length):
                    if len(starts):
                        gram, covered, anchor, low, high = anchors(piece, starts, length)
                        at = np.searchsorted(starts, low)
                        found.append((gram.view(np.int64), covered.view(np.int64), row[at],
                                      anchor - begin[at] + shift,
                                      ((anchor - low) << 16 | (high - low + 1)).astype(np.int32)))
                if not found:
                    continue
                gram, covered, row, place, reach = (np.concatenate(c) for c in zip(*found))
                _, rank = np.unique(part.column("doc").to_numpy(zero_copy_only=False), return_inverse=True)
                order = np.lexsort((place, rank[row], covered, gram))
                gram, covered, row, place, reach = (
                    c[order] for c in (gram, covered, row, place, reach))
                repeat = _same(gram, covered)
                leader = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(gram))))
                itself = repeat & (rank[row] == rank[row[leader]]) & (place == place[leader])
                key = np.where(repeat, _mixed((place.astype(np.uint64) << np.uint64(20))
                                              + rank[row].astype(np.uint64)).view(np.int64), gram)
                out = pa.RecordBatch.from_arrays([
                    pa.array(key), pa.array(covered, mask=repeat), part.column("doc").take(pa.array(row)),
                    pa.array(place), pa.array(reach)], names=["key", "bytes", "doc", "place", "range"])
                yield out.filter(pa.array(~itself))

    return docs.mapInArrow(
        run, f"key bigint, bytes bigint, doc {dict(docs.dtypes)['doc']}, place bigint, range int")


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether a row equals the row before it; the first does not."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _decided(anchored: DataFrame, length: int) -> DataFrame:
    """(doc, start, stop, gram, range): spans to remove, gram null; and contexts to look at, where
    start is the anchor's place.

    A stream over rows sorted by gram, bytes, document and place: one gram is held back until it is
    known whether it occurs with different bytes, and of that only the first row of each.
    """
    kind = dict(anchored.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # firsts of the last gram; its last row's key comes with them
        last: tuple | None = None
        for batch in batches:
            known = batch.column("bytes").is_null().to_numpy(zero_copy_only=False)
            if known.any():
                reach, place = batch.column("range").to_numpy(), batch.column("place").to_numpy()
                start = place - (reach >> 16)
                yield _spans(batch.column("doc"), start, start + (reach & 0xFFFF) - 1 + length, known)
                batch = batch.filter(pa.array(~known))
            gram, covered = batch.column("key").to_numpy(), batch.column("bytes").to_numpy()
            doc, place = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("place").to_numpy()
            same = _same(gram, covered)
            same_place = _same(doc, place) & same
            if last is not None and len(gram) and (gram[0], covered[0]) == last[:2]:
                same[0] = True
                same_place[0] = (doc[0], place[0]) == last[2:]
            gone = same & ~same_place
            reach = batch.column("range").to_numpy()
            before, n = reach >> 16, reach & 0xFFFF
            start = place - before
            yield _spans(batch.column("doc"), start, start + n - 1 + length, gone)
            firsts = pa.Table.from_batches([batch.filter(pa.array(~same))])
            held = firsts if held is None else pa.concat_tables([held, firsts])
            if len(gram):
                last = (gram[-1], covered[-1], doc[-1], place[-1])
            if held.num_rows > 1 << 14:
                closed = held.column("key").to_numpy() != last[0]
                yield from _open_grams(held.filter(pa.array(closed)))
                held = held.filter(pa.array(~closed))
                if held.num_rows > 1 << 14:  # one gram, with many contexts: they are wanted anyway
                    yield from _requests(held.slice(0, held.num_rows - 1), np.ones(held.num_rows - 1, bool))
                    held = held.slice(held.num_rows - 1)
                    crowded.add(int(last[0]))
        if held is not None:
            yield from _open_grams(held)

    crowded: set[int] = set()

    def _open_grams(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = table.column("key").to_numpy()
        same = _same(gram)
        wanted = same.copy()
        wanted[:-1] |= same[1:]
        if crowded:
            wanted |= np.isin(gram, list(crowded))
            crowded.clear()
        yield from _requests(table, wanted)

    def _requests(table: pa.Table, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in table.filter(pa.array(wanted)).to_batches():
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("place"), pa.nulls(part.num_rows, pa.int64()),
                 part.column("key"), part.column("range")],
                names=["doc", "start", "stop", "gram", "range"])

    rows = anchored.repartition("key").sortWithinPartitions("key", "bytes", "doc", "place")
    return rows.mapInArrow(run, f"doc {kind}, start bigint, stop bigint, gram bigint, range int")


def _spans(doc: pa.Array, start: np.ndarray, stop: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    n = int(which.sum())
    return pa.RecordBatch.from_arrays(
        [doc.filter(pa.array(which)), pa.array(start[which].astype(np.int64)),
         pa.array(stop[which].astype(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
        names=["doc", "start", "stop", "gram", "range"])


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, doc, place, left, right): the bytes before each wanted anchor, backwards, and from
    it on."""
    kind = dict(docs.dtypes)["doc"]
    asked = wanted.groupBy("doc").agg(F.collect_list(
        F.struct("gram", F.col("start").alias("place"), "range")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SEGMENT):
                data, edges = text_buffer(part.column("text"))
                lists = part.column("asked")
                counts = np.diff(lists.offsets.to_numpy())
                gram, place, reach = (lists.flatten().field(k).to_numpy() for k in range(3))
                row = np.repeat(np.arange(part.num_rows), counts)
                before, n = (reach >> 16).astype(np.int64), (reach & 0xFFFF).astype(np.int64)
                at = edges[row] + place
                after = n - 1 + length - before
                for k in range(0, len(row), 1 << 14):
                    own = slice(k, k + (1 << 14))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(gram[own]), part.column("doc").take(pa.array(row[own])),
                        pa.array(place[own]),
                        _cut(data, at[own] - before[own], before[own], True),
                        _cut(data, at[own], after[own], False),
                    ], names=["gram", "doc", "place", "left", "right"])

    return docs.join(asked, "doc").select("doc", "text", "asked").mapInArrow(
        run, f"gram bigint, doc {kind}, place bigint, left binary, right binary")


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray, backwards: bool) -> pa.Array:
    at = gather(start, size)
    ends = np.cumsum(size)
    if backwards:  # mirror every run
        at = np.repeat(2 * start + size - 1, size) - at
    bounds = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [
        None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, zero-padded, and their sizes."""
    data, edges = text_buffer(column)
    size = np.diff(edges)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - np.repeat(edges[:-1], size)] = data
    return out, size


def _shared(rows: DataFrame, column: str, name: str, width: int) -> DataFrame:
    """`rows` with `name`: how many leading bytes of `column` another row of the gram may share.

    Rows are sorted, so that is the most that either neighbour shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        before = 0  # what the kept row shares with the row before it

        def close(table: pa.Table, more: bool) -> tuple[pa.RecordBatch, pa.Table | None, int]:
            flat = table.combine_chunks()
            values, size = _matrix(flat.column(column).combine_chunks(), width)
            gram = flat.column("gram").to_numpy()
            equal = values[1:] == values[:-1]
            with_next = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
            with_next[gram[1:] != gram[:-1]] = 0
            most = np.maximum(np.append(before, with_next), np.append(with_next, 0))
            most = np.minimum(most, size).astype(np.int32)
            done = flat.append_column(name, pa.array(most))
            n = len(most) - 1 if more else len(most)
            return (done.slice(0, n).combine_chunks().to_batches(),
                    flat.slice(n) if more else None, int(with_next[-1]) if len(with_next) else before)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            if table.num_rows:
                ready, kept, before = close(table, True)
                yield from ready
        if kept is not None:
            yield from close(kept, False)[0]

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {name} int"
    return rows.mapInArrow(run, schema)


def _judged(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, start, stop): spans to remove of contexts that differ."""
    kind = dict(contexts.dtypes)["doc"]
    side = length - GRAM
    rows = contexts.repartition("gram").sortWithinPartitions("gram", "left")
    rows = _shared(rows, "left", "n_left", side).sortWithinPartitions("gram", "right")
    rows = _shared(rows, "right", "n_right", side + GRAM).where(
        F.col("n_left") + F.col("n_right") >= length)
    rows = rows.select(
        "gram", "n_left", F.expr("substring(left, 1, n_left)").alias("left"),
        F.expr("substring(right, 1, n_right)").alias("right"), "doc", "place",
    ).sortWithinPartitions("gram", "left", "right", "doc", "place")

    most = POOL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # gram, left, right of the row before, and its document and place
        group: list[tuple] = []
        held = number = 0  # bytes of the group, and its pools given out so far
        pool: list[list[tuple]] = []
        pooled = 0
        column = None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [()] * 6
            kinds = (column, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds)],
                names=["doc", "start", "stop", "gram", "pool", "content"])

        def spans(found: list[tuple]) -> list[tuple]:
            return [(*span, None, None, None) for span in found]

        def given(gram: int) -> list[tuple]:
            return [(doc, start, None, gram, number, content) for content, doc, start in group]

        for batch in batches:
            column = batch.schema.field("doc").type
            out = []
            for gram, left, right, doc, place in zip(*(
                    batch.column(c).to_pylist() for c in ("gram", "left", "right", "doc", "place"))):
                if last is not None and gram == last[0]:
                    if left == last[1] and right == last[2]:
                        if (doc, place) != last[3:]:
                            out.append((doc, place - len(left), place + len(right), None, None, None))
                        last = (gram, left, right, doc, place)
                        continue
                else:
                    if number:
                        out += given(last[0])
                    elif len(group) > 1:
                        pool.append(group)
                        pooled += held
                    group, held, number = [], 0, 0
                    if pooled > most:
                        out += spans(repeats(pool, length))
                        pool, pooled = [], 0
                group.append((left[::-1] + right, doc, place - len(left)))
                held += len(left) + len(right)
                last = (gram, left, right, doc, place)
                if held > most:
                    out += given(gram)
                    group, held, number = [], 0, number + 1
            yield batch_of(out)
        if number:
            yield batch_of(given(last[0]))
        elif len(group) > 1:
            pool.append(group)
        if pool:
            yield batch_of(spans(repeats(pool, length)))

    judged = cut_lineage(rows.mapInArrow(
        run, f"doc {kind}, start bigint, stop bigint, gram bigint, pool bigint, content binary"))
    found = judged.where("gram is null").select("doc", "start", "stop")
    crowded = judged.where("gram is not null")
    return found if crowded.isEmpty() else found.union(_between_pools(crowded, length))


def _between_pools(crowded: DataFrame, length: int) -> DataFrame:
    """(doc, start, stop): spans to remove of the contexts of grams that fill several pools.

    Each pool has its own suffix array and gives the earliest start of each of its strings, by the
    string's hash; of these, all but the earliest of all pools go too.
    """
    kind = dict(crowded.dtypes)["doc"]

    def run(table: pa.Table) -> pa.Table:
        column = table.schema.field("doc").type
        contexts = list(zip(*(table.column(c).to_pylist() for c in ("content", "doc", "start"))))
        owner, start, again, hashes = _strings(contexts, length)
        spans = _joined(contexts, owner[again], start[again], length)
        doc, begin, stop = zip(*spans) if spans else ((), (), ())
        first = ~again
        docs = table.column("doc").combine_chunks()
        nulls = pa.nulls(len(spans), pa.int64())
        n = int(first.sum())
        gram = pa.array(np.full(n, table.column("gram")[0].as_py()), pa.int64())
        return pa.concat_tables([
            pa.table([pa.array(doc, column), pa.array(begin, pa.int64()), pa.array(stop, pa.int64()),
                      nulls, nulls, nulls], names=names),
            pa.table([docs.take(pa.array(owner[first])), pa.array(start[first]), pa.nulls(n, pa.int64()),
                      gram, *(pa.array(h[first].view(np.int64)) for h in hashes)], names=names)])

    names = ["doc", "start", "stop", "gram", "string_a", "string_b"]
    judged = cut_lineage(crowded.select("gram", "pool", "doc", "start", "content").groupBy("gram", "pool").applyInArrow(
        run, f"doc {kind}, start bigint, stop bigint, gram bigint, string_a bigint, string_b bigint"))
    string = ["gram", "string_a", "string_b"]
    firsts = judged.where("gram is not null")
    earliest = firsts.groupBy(*string).agg(
        F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("pools")).where("pools > 1")
    later = firsts.join(earliest, string).where(F.struct("doc", "start") != F.col("least"))
    return judged.where("gram is null").select("doc", "start", "stop").union(
        later.select("doc", "start", (F.col("start") + length).alias("stop")))


def repeats(groups: list[list[tuple]], length: int) -> list[tuple]:
    """Spans (document, start, stop) of strings that also start earlier in their group.

    Contexts are (bytes, document, start in it).
    """
    contexts = [c for group in groups for c in group]
    owner, start, again, _ = _strings(contexts, length)
    return _joined(contexts, owner[again], start[again], length)


def _strings(contexts: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per string: its context, its start in the document, whether it starts earlier in another
    place, and two hashes of its bytes.

    One suffix array over all contexts, each ended by a symbol below every byte, puts equal strings
    next to each other.
    """
    size = np.array([len(c[0]) for c in contexts])
    at = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()) + length, np.int64)
    for (content, *_), start in zip(contexts, at.tolist(), strict=True):
        text[start:start + len(content)] = np.frombuffer(content, np.uint8)
        text[start:start + len(content)] += 1
    order = np.array(suffix_array(text[:-length].tolist()), np.int64)
    owner = np.repeat(np.arange(len(contexts)), size + 1)[order]
    offset = order - at[owner]
    full = offset + length <= size[owner]
    order, owner, offset = order[full], owner[full], offset[full]
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 4096):
        here = slice(k, min(k + 4096, len(order)))
        prior = slice(k - 1, min(k + 4096, len(order)) - 1)
        new[here] = (strings[order[here]] != strings[order[prior]]).any(axis=1)
    run = np.cumsum(new) - 1
    # Earliest of each run, by document and place in it.
    ranked = {doc: k for k, doc in enumerate(sorted({c[1] for c in contexts}))}
    rank = np.array([ranked[c[1]] for c in contexts])
    start = np.array([c[2] for c in contexts])[owner] + offset
    earliest = np.lexsort((start, rank[owner], run))
    again = np.ones(len(order), bool)
    again[earliest[np.flatnonzero(_first(run[earliest]))]] = False
    values, powers = _tables()
    code = np.append(np.uint64(0), values)[text]
    windows = np.lib.stride_tricks.sliding_window_view(code, length)
    hashes = [np.zeros(len(order), np.uint64) for _ in powers]
    for k in range(0, len(order), 4096):
        here = windows[order[k:k + 4096]]
        for out, (power, _) in zip(hashes, powers):
            out[k:k + 4096] = _mixed((here * power[:length]).sum(axis=1, dtype=np.uint64))
    return owner, start, again, hashes


def _joined(contexts: list[tuple], own: np.ndarray, begin: np.ndarray, length: int) -> list[tuple]:
    """Spans (document, start, stop); strings of one context that follow one another are one span."""
    by_place = np.lexsort((begin, own))
    own, begin = own[by_place], begin[by_place]
    joint = np.zeros(len(own), bool)
    joint[1:] = (own[1:] == own[:-1]) & (begin[1:] == begin[:-1] + 1)
    firsts = np.flatnonzero(~joint)
    lasts = np.append(firsts[1:], len(own)) - 1 if len(own) else firsts
    return [(contexts[o][1], a, b + length) for o, a, b in zip(
        own[firsts].tolist(), begin[firsts].tolist(), begin[lasts].tolist())]


def _first(values: np.ndarray) -> np.ndarray:
    return np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)


def _characters(data: np.ndarray, start: int, stop: int, a: np.ndarray, b: np.ndarray):
    """Spans narrowed to whole UTF-8 characters."""
    inner = (data & 0xC0) == 0x80
    while len(a) and (move := (a < b) & inner[np.minimum(a, stop - 1)] & (a < stop)).any():
        a = a + move
    while len(b) and (move := (b > a) & (b < stop) & inner[np.minimum(b, stop - 1)]).any():
        b = b - move
    return a[a < b], b[a < b]


def _removed(docs: DataFrame, spans: DataFrame, whole_characters: bool) -> DataFrame:
    kind, carried = (dict(docs.dtypes)[c] for c in ("doc", "carried"))
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SEGMENT):
                data, edges = text_buffer(part.column("text"))
                column = part.column("spans")
                counts = column.value_lengths().fill_null(0).to_numpy()
                begin, stop = (column.flatten().field(k).to_numpy() for k in range(2))
                row = np.repeat(np.arange(part.num_rows), counts)
                a, b = edges[row] + begin, edges[row] + stop
                order = np.lexsort((a, row))
                row, a, b = row[order], a[order], b[order]
                far = np.maximum.accumulate(b) if len(b) else b  # texts follow one another
                apart = np.ones(len(a), bool)
                apart[1:] = (a[1:] > far[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(apart)
                a, b, row = a[first], far[np.append(first[1:], len(far)) - 1] if len(far) else b, row[first]
                if whole_characters:
                    a, b = _characters(data, 0, len(data), a, b)
                    row = np.searchsorted(edges, a, side="right") - 1
                keep = np.ones(len(data), bool)
                keep[gather(a, b - a)] = False
                removed = np.bincount(row, b - a, part.num_rows).astype(np.int64)
                size = np.diff(edges)
                bounds = np.append(0, np.cumsum(size - removed)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc"), part.column("carried"),
                    pa.Array.from_buffers(pa.binary(), part.num_rows, [
                        None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[keep]))]),
                    pa.array(size), pa.array(removed),
                    pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int64)),
                ], names=["doc", "carried", "kept", "n_bytes", "n_removed", "n_spans"])

    return docs.join(lists, "doc", "left").select("doc", "carried", "text", "spans").mapInArrow(
        run, f"doc {kind}, carried {carried}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text",
                   whole_characters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs`: key, the columns in `keep`, kept (the bytes left), n_bytes, n_removed
    and n_spans.

    `whole_characters` leaves the bytes of a character that a span covers only in part.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes are needed")
    carried = F.struct(*keep) if keep else F.lit(0)
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), carried.alias("carried"))
    columns = ["doc", "text", "carried"]
    print_ = F.xxhash64(F.coalesce("text", F.lit("")))
    many = cut_narrow(rows.where(F.col("doc").isNotNull()).groupBy("doc").agg(
        F.min(print_).alias("least"), F.max(print_).alias("most")).where("least != most"))
    whole = rows.where(F.col("doc").isNull())
    rows = rows.where(F.col("doc").isNotNull())
    if not many.isEmpty():
        marked = rows.join(many, "doc", "left").withColumn(
            "own", F.col("least").isNull() | (print_ == F.col("least")))
        whole = whole.unionByName(marked.where("not own").select(*columns))
        rows = marked.where("own").select(*columns)
    first = cut_narrow(_decided(_anchored(rows.select("doc", "text"), length), length))
    dealt = rows.repartition("doc")
    contexts = _contexts(dealt, first.where("gram is not null"), length)
    spans = first.where("gram is null").select("doc", "start", "stop").union(_judged(contexts, length))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    untouched = whole.select("doc", "carried", F.coalesce("text", F.lit("")).cast("binary").alias("kept"),
                             size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                             F.lit(0).cast("long").alias("n_spans"))
    found = _removed(dealt, spans, whole_characters).unionByName(untouched)
    return found.select(F.col("doc").alias(key), *[F.col("carried")[c].alias(c) for c in keep],
                        "kept", "n_bytes", "n_removed", "n_spans")
