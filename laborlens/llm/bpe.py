"""Byte-level BPE encoding and decoding of whole texts.

Pre-tokenisation runs without a regular expression.  Each code point gets a class, looked up from
a table, that already holds what little the splitting rules look ahead for.  A class is a function
from automaton state to automaton state; the functions form a small monoid whose multiplication
table is built once, so composing them is associative and a blocked prefix scan finds the state
before every code point, and with it every boundary, for many texts at once.  The slices between
boundaries are dictionary-encoded, and only slices not met before are pair-merged.

Null and empty texts encode to no ids.  A very long text is one slice of work and stays whole.
Repeated rows are encoded like any other row; ids and offsets depend on the text alone.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import chunks, gather, text_buffer
from .codepoints import LETTER, NUMBER, OTHER, SPACE, decode as codepoints, kinds, widths

MOST_VOCABULARY_BYTES = 64 << 20
MOST_CACHED = 250_000
SLICED_BYTES = 1 << 19  # larger parts share more slices
BLOCK = 256

# States: what the code points since the last boundary are.
START, WORD, DIGITS, SIGNS, BLANKS, JOIN, ONE_MORE, TWO_MORE = range(8)
# Classes.  APOS2 and APOS3 begin a contraction of two or three code points; a JOINING blank is a
# plain space right before something that is not blank, a LONE blank another such blank.
C_WORD, C_DIGITS, C_SIGN, C_APOS2, C_APOS3, C_BLANK, C_JOINING, C_LONE, C_NONE = range(9)
# The endings of English contractions that the pattern splits off.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


OF_KIND = np.zeros(4, np.uint8)
OF_KIND[[LETTER, NUMBER, SPACE, OTHER]] = C_WORD, C_DIGITS, C_BLANK, C_SIGN


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a boundary lies before this code point."""
    if kind == C_NONE:
        return state, False
    if state in (ONE_MORE, TWO_MORE):
        return (START if state == ONE_MORE else ONE_MORE), False
    home = {C_WORD: WORD, C_DIGITS: DIGITS, C_SIGN: SIGNS, C_APOS2: SIGNS, C_APOS3: SIGNS}
    if state == JOIN and kind in home:
        return home[kind], False
    if kind in (C_APOS2, C_APOS3) and state != SIGNS:
        return (ONE_MORE if kind == C_APOS2 else TWO_MORE), True
    if kind in home:
        return home[kind], state != home[kind]
    if kind == C_BLANK:
        return BLANKS, state != BLANKS
    return (JOIN if kind == C_JOINING else START), True


class _Machine:
    """The automaton, its first-of-text variants and the monoid that both generate."""

    def __init__(self) -> None:
        width = 2 * C_NONE + 1  # classes, the same at the start of a text, and no code point
        nexts = np.zeros((width, 8), np.uint8)
        self.cuts = np.zeros((8, width), bool)
        for kind in range(C_NONE + 1):
            for state in range(8):
                nexts[kind, state], self.cuts[state, kind] = _step(state, kind)
                if kind < C_NONE:
                    nexts[kind + C_NONE + 1, state] = _step(START, kind)[0]
                    self.cuts[state, kind + C_NONE + 1] = True
        members = {tuple(range(8)): 0}
        rows = [tuple(range(8))]
        product = []
        at = 0
        while at < len(rows):
            line = []
            for kind in range(width):
                made = tuple(int(nexts[kind, s]) for s in rows[at])
                if made not in members:
                    members[made] = len(rows)
                    rows.append(made)
                line.append(members[made])
            product.append(line)
            at += 1
        self.by_class = np.array(product, np.uint16)  # [member, class] -> member
        self.functions = np.array(rows, np.uint8)  # [member, state] -> state
        self.after = np.array(
            [[members[tuple(int(self.functions[g][s]) for s in f)] for g in range(len(rows))]
             for f in self.functions], np.uint16)  # [f, g] -> g after f
        self.states = nexts.T.copy()  # [state, class] -> state
        self.first = C_NONE + 1


@lru_cache(maxsize=1)
def machine() -> _Machine:
    return _Machine()


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each code point; `starts`: where texts begin."""
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[starts[starts < n]] = True
    begins[n] = True
    last = begins[1:]
    out = OF_KIND[kinds()[points]]
    blanks = np.flatnonzero(out == C_BLANK)
    at = blanks[~last[blanks]]
    at = at[out[at + 1] != C_BLANK]
    out[at] = np.where(points[at] == 0x20, C_JOINING, C_LONE)
    apostrophes = np.flatnonzero(points == 0x27)
    apostrophes = apostrophes[~last[apostrophes]]
    following = points[apostrophes + 1]
    short = np.isin(following, [ord(c) for c in SHORT_ENDINGS])
    out[apostrophes[short]] = C_APOS2
    rest = apostrophes[~short]
    rest = rest[rest + 2 < n]
    rest = rest[~last[rest + 1]]
    for a, b in LONG_ENDINGS:
        hit = (points[rest + 1] == ord(a)) & (points[rest + 2] == ord(b))
        out[rest[hit]] = C_APOS3
    out[starts[starts < n]] += C_NONE + 1
    return out


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the code points that begin a slice, by a blocked scan over transition functions."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    m = machine()
    columns = -(-n // BLOCK)
    padded = np.full(columns * BLOCK, C_NONE, np.uint8)
    padded[:n] = classes(points, starts)
    grid = np.ascontiguousarray(padded.reshape(columns, BLOCK).T)
    width = m.by_class.shape[1]
    by_class, after = m.by_class.ravel(), m.after.ravel()
    # 1. The product of each block.
    member = np.zeros(columns, np.uint16)
    for line in grid:
        member = by_class[member * np.uint16(width) + line]
    # 2. Exclusive prefix products over the blocks: associative, so by doubling.
    size = m.after.shape[0]
    shift = 1
    while shift < columns:
        done = member.copy()
        done[shift:] = after[member[:-shift].astype(np.int32) * size + member[shift:]]
        member = done
        shift *= 2
    state = np.zeros(columns, np.uint8)
    state[1:] = m.functions[member[:-1], START]
    # 3. Every block from its own entry state.
    cut = np.zeros(grid.shape, bool)
    states, cuts = m.states.ravel(), m.cuts.ravel()
    for line, row in zip(grid, cut, strict=True):
        place = state * np.uint8(width) + line
        row[:] = cuts[place]
        state = states[place]
    return np.flatnonzero(cut.T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank is merged first, the leftmost of equal ones.

    A heap over a linked list, so a slice of n bytes takes n log n steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0: no part begins here
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of its parts was merged meanwhile
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i:end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PairTable:
    """Ranks of all mergeable pairs of ids, hashed into short buckets that numpy can probe."""

    BITS = 20
    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        place = self._place(key)
        order = np.argsort(place, kind="stable")
        counts = np.bincount(place, minlength=1 << self.BITS)
        self.deep = int(counts.max()) if len(keys) else 0
        self.first = (np.cumsum(counts) - counts).astype(np.int64)
        self.key = np.append(key[order], np.full(self.deep, 2**64 - 1, np.uint64))
        self.value = np.append(value[order], np.full(self.deep, self.NONE))

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self.first[self._place(key)]
        out = np.full(len(key), self.NONE)
        for k in range(self.deep):
            hit = self.key[at + k] == key
            out[hit] = self.value[at[hit] + k]
        return out


def merge_together(
    pieces: list[bytes], ranks: dict[bytes, int], pairs: PairTable
) -> tuple[np.ndarray, np.ndarray]:
    """`merge` for many slices: (ids of all one after the other, how many each has).

    Slices of like length share a matrix; each round merges one pair in every row that has one.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.cumsum(size) - size
    whole = np.fromiter((ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
    counts = np.ones(len(pieces), np.int64)
    parts, owners = [whole[whole >= 0].astype(np.int32)], [np.flatnonzero(whole >= 0)]
    for k in np.flatnonzero((whole < 0) & (size > 64)).tolist():
        found = merge(pieces[k], ranks)
        counts[k] = len(found)
        parts.append(np.array(found, np.int32))
        owners.append(np.full(len(found), k))
    byte_id = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int32)
    grade = np.where((whole < 0) & (size <= 64), -(-size // 4), 0)
    for width in np.unique(grade[grade > 0]).tolist():
        members = np.flatnonzero(grade == width)
        for k in range(0, len(members), 1 << 14):
            own = members[k:k + (1 << 14)]
            ids, there = _merge_rows(byte_id, raw, at[own], size[own], width * 4, pairs)
            counts[own] = there.sum(axis=1)
            parts.append(ids[there])
            owners.append(np.repeat(own, counts[own]))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(parts)[order], counts


def _merge_rows(byte_id, raw, at, size, width, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which of them are left) of slices of at most `width` bytes."""
    m, column = len(at), np.arange(width)
    there = column < size[:, None]
    ids = byte_id[raw[np.minimum(at[:, None] + column, len(raw) - 1)]]
    rank = np.full((m, width), PairTable.NONE)
    left = np.flatnonzero((column + 1 < size[:, None]).ravel())
    rank.ravel()[left] = pairs.ranks(ids.ravel()[left], ids.ravel()[left + 1])
    nxt = np.tile((column + 1).astype(np.int16), (m, 1))
    prv = np.tile((column - 1).astype(np.int16), (m, 1))
    active = np.arange(m)
    while True:
        best = rank[active].argmin(axis=1)
        value = rank[active, best]
        some = value != PairTable.NONE
        active, best, value = active[some], best[some], value[some]
        if not len(active):
            return ids, there
        gone = nxt[active, best].astype(np.int64)
        after = nxt[active, gone].astype(np.int64)
        ids[active, best] = value
        there[active, gone] = False
        rank[active, gone] = PairTable.NONE
        rank[active, best] = PairTable.NONE
        nxt[active, best] = after
        more = after < size[active]
        row, here, then = active[more], best[more], after[more]
        prv[row, then] = here
        rank[row, here] = pairs.ranks(ids[row, here], ids[row, then])
        before = prv[active, best].astype(np.int64)
        more = before >= 0
        row, here, then = active[more], before[more], best[more]
        rank[row, here] = pairs.ranks(ids[row, here], ids[row, then])


class SliceCache:
    """Ids of the slices met so far, as one flat array.

    `ids_of` gives the ids of new slices, all one after the other, and how many each has.  When
    there are more than `most`, those met more than once since the last time stay, the most
    frequent first and at most half as many; the others go.
    """

    def __init__(self, ids_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
                 most: int = MOST_CACHED):
        self.ids_of, self.most = ids_of, most
        self.row: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 12, np.int32)
        self.at = np.zeros(1 << 10, np.int64)
        self.size = np.zeros(1 << 10, np.int64)
        self.met = np.zeros(1 << 10, np.int32)
        self.used = 0

    @staticmethod
    def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(array):
            array = np.concatenate([array, np.zeros(at + len(values), array.dtype)])
        array[at:at + len(values)] = values
        return array

    def _shrink(self) -> None:
        met = self.met[:len(self.row)]
        kept = np.flatnonzero(met > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-met[kept], kind="stable")[:self.most // 2]])
        slices = list(self.row)  # in the order of their rows
        self.row = {slices[old]: new for new, old in enumerate(kept.tolist())}
        size = self.size[kept]
        self.flat = self.flat[gather(self.at[kept], size)]
        self.at, self.size = np.cumsum(size) - size, size
        self.met = np.zeros(len(kept), np.int32)
        self.used = len(self.flat)

    def rows(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.row) + len(pieces) > self.most:
            self._shrink()
        new = [p for p in pieces if p not in self.row]
        if new:
            ids, counts = self.ids_of(new)
            k = len(self.row)
            self.row.update(zip(new, range(k, k + len(new))))
            self.at = self._put(self.at, k, self.used + np.cumsum(counts) - counts)
            self.size = self._put(self.size, k, counts)
            self.met = self._put(self.met, k, np.zeros(len(new), np.int32))
            self.flat = self._put(self.flat, self.used, ids)
            self.used += len(ids)
        found = np.fromiter(map(self.row.__getitem__, pieces), np.int64, len(pieces))
        self.met[found] += 1  # pieces are distinct
        return found


def _listed(column: pa.BinaryArray) -> list[bytes]:
    data, offsets = text_buffer(column)
    raw, ends = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _occurrences(raw: bytes, offsets: np.ndarray, whole: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the matches that lie within one text."""
    spans = np.array([m.span() for m in whole.finditer(raw)], np.int64).reshape(-1, 2)
    inside = np.searchsorted(offsets, spans[:, 0], "right") == np.searchsorted(offsets, spans[:, 1], "left")
    return spans[inside, 0], spans[inside, 1]


def encode_chunk(data: np.ndarray, offsets: np.ndarray, cache: SliceCache,
                 whole: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, number of ids before each text and in all).

    Matches of `whole` are slices of their own, and what stands around them is cut as texts are.
    """
    raw = data.tobytes()
    points = codepoints(raw)
    begins = offsets[:-1][np.diff(offsets) > 0]
    if whole is not None:
        first, end = _occurrences(raw, offsets, whole)
        begins = np.unique(np.concatenate([begins, first, end]))
        begins = begins[begins < len(raw)]
    if len(points) == len(raw):
        starts = begins
    else:
        place = np.concatenate([[0], np.cumsum(widths(points))])
        starts = np.searchsorted(place, begins)
    cut = boundaries(points, starts)
    if len(points) != len(raw):
        cut = place[cut]
    if whole is not None and len(first):
        near = np.maximum(np.searchsorted(first, cut, "right") - 1, 0)
        cut = cut[(cut <= first[near]) | (cut >= end[near])]
    if not len(cut):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    bounds = np.append(cut, len(raw)).astype(np.int32)
    slices = pa.Array.from_buffers(
        pa.binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
    row = cache.rows(_listed(slices.dictionary))[slices.indices.to_numpy()]
    size = cache.size[row]
    ids = cache.flat[gather(cache.at[row], size)]
    before = np.concatenate([[0], np.cumsum(size)])
    return ids, before[np.searchsorted(cut, offsets)]


@lru_cache(maxsize=4)
def _ranked(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank)
            for token, rank in map(bytes.split, content.splitlines()) if token}


class _Vocabulary:
    """A rank file read on the driver and broadcast: its size is checked, it never grows with data."""

    def __init__(self, df: DataFrame, path: str):
        size = os.path.getsize(path)
        if size > MOST_VOCABULARY_BYTES:
            raise ValueError(f"{path}: {size} bytes, more than a vocabulary to broadcast may have")
        with open(path, "rb") as file:
            self.content = df.sparkSession.sparkContext.broadcast(file.read())


_caches: dict[int, SliceCache] = {}


def _cache(content: bytes) -> SliceCache:
    """One per worker process and vocabulary, so that tasks share it."""
    key = hash(content)
    if key not in _caches:
        ranks = _ranked(content)
        pairs = PairTable(ranks)
        _caches[key] = SliceCache(lambda new: merge_together(new, ranks, pairs))
    return _caches[key]


@lru_cache(maxsize=4)
def _pieces(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after the other, and where each token's begin and how many."""
    ranks = _ranked(content)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    tokens = [b""] * len(size)
    for token, rank in ranks.items():
        tokens[rank], size[rank] = token, len(token)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: its key, `ids` and `starts`, each id's first byte in the text.

    `path` names a rank file (base64 token and rank per line) that the driver can read.
    """
    vocabulary = _Vocabulary(docs, path).content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(vocabulary.value)
        _, _, token_size = _pieces(vocabulary.value)
        for batch in batches:
            for part in chunks(batch, "text", SLICED_BYTES):
                data, offsets = text_buffer(part.column("text"))
                ids, before = encode_chunk(data, offsets, cache)
                ends = np.cumsum(token_size[ids])
                counts = np.diff(before)
                starts = ends - token_size[ids] - np.repeat(offsets[:-1], counts)
                lists = pa.array(before.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"),
                     pa.ListArray.from_arrays(lists, pa.array(ids, pa.int32())),
                     pa.ListArray.from_arrays(lists, pa.array(starts.astype(np.int32)))],
                    names=["key", "ids", "starts"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, starts array<int>").withColumnRenamed(
        "key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Per row of `encode`'s result: its key and `decoded`, the bytes of its ids.

    Each id's bytes go to the offset that was kept for it, so any run of ids can be decoded alone.
    """
    vocabulary = _Vocabulary(encoded, path).content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at, token_size = _pieces(vocabulary.value)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                column = part.column("ids")
                ids = column.flatten().to_numpy()
                starts = part.column("starts").flatten().to_numpy().astype(np.int64)
                before = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
                size = token_size[ids]
                ends = np.concatenate([[0], np.cumsum(size)])[before]
                base = np.repeat(ends[:-1], np.diff(before))
                out = np.empty(int(ends[-1]), np.uint8)
                out[gather(base + starts, size)] = flat[gather(at[ids], size)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"),
                     pa.Array.from_buffers(pa.binary(), part.num_rows, [
                         None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])],
                    names=["key", "decoded"])

    kind = dict(encoded.dtypes)[key]
    rows = encoded.select(F.col(key).alias("key"), "ids", "starts")
    return rows.mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)
