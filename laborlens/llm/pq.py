"""Near-duplicate vectors by product quantisation.

Unit vectors go to the coarse inverted list of their nearest centroid; what is left of them is
coded by subspace.  A vector probes its own list and every list beyond whose border another vector
could lie within the distance that the similarity allows, so the probes are sufficient.  In a list,
the distance to every code comes from lookup tables; a code is passed over only if even its stored
coding error cannot bring it near enough.  What remains is compared by exact cosine.  Neither step
loses a link, so the training sample, bounded and documented, decides speed alone.

Vectors link only within one label, and with vectors of as many components; those without a label,
null, empty, all zero or with null or non-finite components link with nothing.  Equal vectors of a
label are one class: they are compared once, and counted as often as there are ids.  Rows that
repeat an id are one node; without an id a row has no links and no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, cut_lineage

SAMPLE = 8192  # vectors that centroids and codebooks are learned from, about, at most
SUBSPACES = 8
CODES = 32
BLOCK_ROWS = 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centroids, started from evenly spread rows; an empty cell keeps its old centroid."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        cell = _nearest(x, centres)
        size = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """For vectors of one width: coarse centroids and a codebook per subspace."""

    centres: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    @classmethod
    def learned(cls, x: np.ndarray, width: int, lists: int) -> Quantiser:
        if not len(x):
            x = np.zeros((1, width))
        edges = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int).tolist()
        centres = k_means(x, lists)
        rest = x - centres[_nearest(x, centres)]
        return cls(centres, [k_means(rest[:, a:b], CODES) for a, b in zip(edges, edges[1:])], edges)

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, coding errors)."""
        codes = np.zeros((len(rest), len(self.books)), np.uint8)
        error = np.zeros(len(rest))
        for m, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:])):
            codes[:, m] = _nearest(rest[:, a:b], book)
            error += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances [subspace, row, code] to every entry of the codebooks."""
        out = np.zeros((len(self.books), len(rest), max(len(b) for b in self.books)))
        for m, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:])):
            part = rest[:, a:b]
            out[m, :, :len(book)] = ((part**2).sum(axis=1)[:, None] - 2 * part @ book.T
                                     + (book**2).sum(axis=1))
        return out

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(own list, which lists to probe): lists numbered from the own on, within reach."""
        square = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        own = square.argmin(axis=1)
        apart = np.sqrt(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2))
        beyond = square - square[np.arange(len(x)), own][:, None]
        near = beyond <= 2 * reach * apart[own] + 1e-9
        near &= np.arange(len(self.centres)) > own[:, None]
        near[np.arange(len(x)), own] = True
        return own, near


def _unit(flat: np.ndarray, width: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _classes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(label, v, id, n): equal usable vectors of a label, their smallest id and number of ids."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(vector) > 0)
                            & fine & F.exists(vector, lambda x: x != 0))
              .select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"),
                      F.transform(vector, lambda x: x.cast("double")).alias("v")).distinct())
    return usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def _train(classes: DataFrame, sample: int) -> dict[int, Quantiser]:
    sizes = classes.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count")).limit(64).collect()
    out = {}
    for width, n in sizes:  # vectors of rarer widths are one list each, which loses nothing
        share = int(min(1.0, sample / n) * (1 << 20))
        chosen = classes.where((F.size("v") == width)
                               & (F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < share))
        rows = chosen.select("v").toArrow().column("v").combine_chunks()
        x = _unit(_flat(rows), width) if len(rows) else np.zeros((0, width))
        out[width] = Quantiser.learned(x, width, -(-int(n**0.5) // 32))
    return out


def _listed(classes: DataFrame, model, reach: float) -> DataFrame:
    """Classes with `own`, their list, and `probes`, the lists to search."""
    kind = dict(classes.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(batch.column("v").offsets.to_numpy())
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                own, near = _quantiser(model.value, width).probes(_unit(_flat(part.column("v")), width), reach)
                row, probed = np.nonzero(near)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("label", "rep", "n", "v")]
                    + [pa.array(np.full(part.num_rows, width, np.int32)), pa.array(own.astype(np.int32)),
                       pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                                pa.array(probed.astype(np.int32)))],
                    names=["label", "rep", "n", "v", "width", "own", "probes"])

    return classes.select("label", "rep", "n", "v").mapInArrow(
        run, f"label {kind}, rep bigint, n bigint, v array<double>, width int, own int, probes array<int>")


def _quantiser(model: dict[int, Quantiser], width: int) -> Quantiser:
    return model.get(width) or Quantiser.learned(np.zeros((0, width)), width, 1)


def _blocks(rows: DataFrame, sizes: DataFrame, n: str) -> DataFrame:
    """Rows of every list in blocks of about BLOCK_ROWS: `block`, and lists of their columns."""
    keys = ["label", "width", "list"]
    dealt = rows.join(sizes, keys).withColumn(
        "block", F.pmod(F.xxhash64("rep", "v"), F.col(n)).cast("int"))
    return dealt.groupBy(*keys, "block", "members_n", "queries_n").agg(
        F.collect_list(F.struct("rep", "n", "own", "v")).alias("rows"))


def _work(listed: DataFrame) -> DataFrame:
    """One row per block of queries and block of members of a list."""
    keys = ["label", "width", "list"]
    members = listed.select("label", "width", F.col("own").alias("list"), "rep", "n", "own", "v")
    queries = listed.select("label", "width", F.explode("probes").alias("list"), "rep", "n", "own", "v")
    count = lambda df, name: df.groupBy(*keys).agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    sizes = cut_lineage(count(members, "members_n").join(count(queries, "queries_n"), keys))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = _blocks(members, sizes, "members_n").select(
        *keys, F.col("block").alias("m"), upto("queries_n").alias("q"), F.col("rows").alias("members"))
    right = _blocks(queries, sizes, "queries_n").select(
        *keys, F.col("block").alias("q"), upto("members_n").alias("m"), F.col("rows").alias("queries"))
    return left.join(right, [*keys, "m", "q"])


def _read(column: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    rows = column.flatten()
    rep, n, own, v = (rows.field(k) for k in range(4))
    return (rep.to_numpy(), n.to_numpy(), own.to_numpy(), _unit(_flat(v), width))


def _compare(quantiser: Quantiser, place: int, members, queries, least: float) -> tuple[np.ndarray, ...]:
    """(ids, partners counted, an id of the same component) over one block of work."""
    reach = np.sqrt(2 - 2 * least) + 1e-9
    rep, weight, _, x = members
    asked, asked_weight, own, y = queries
    rest = x - quantiser.centres[place]
    codes, error = quantiser.code(rest)
    tables = quantiser.tables(y - quantiser.centres[place])
    all_ids, at = np.unique(np.concatenate([rep, asked]), return_inverse=True)
    of_member, of_query = at[:len(rep)], at[len(rep):]
    links = np.zeros(len(all_ids), np.int64)
    group = np.arange(len(all_ids))
    for k in range(len(asked)):
        square = tables[0, k, codes[:, 0]]
        for m in range(1, len(tables)):
            square = square + tables[m, k, codes[:, m]]
        near = np.sqrt(np.maximum(square, 0)) - error <= reach
        near &= rep > asked[k] if own[k] == place else rep != asked[k]
        found = np.flatnonzero(near)
        found = found[x[found] @ y[k] >= least] if len(found) else found
        if not len(found):
            continue
        links[of_query[k]] += weight[found].sum()
        np.add.at(links, of_member[found], asked_weight[k])
        groups = np.unique(np.append(group[of_member[found]], group[of_query[k]]))
        if len(groups) > 1:
            group[np.isin(group, groups)] = groups[0]
    some = links > 0
    return all_ids[some], links[some], all_ids[group][some]


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id",
                    vector: str = "embedding", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `vectors`: key, n_links, component_id and kept (whether it is its
    component's smallest id).

    Tasks return counts and a spanning set of links, not all pairs of a dense group.
    """
    classes = cut_lineage(_classes(vectors, key, vector, label))
    context = vectors.sparkSession.sparkContext
    model = context.broadcast(_train(classes, sample))
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9
    listed = cut_lineage(_listed(classes, model, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in range(batch.num_rows):
                row = batch.slice(line, 1)
                width, place = row.column("width")[0].as_py(), row.column("list")[0].as_py()
                found = _compare(_quantiser(model.value, width), place,
                                 _read(row.column("members"), width),
                                 _read(row.column("queries"), width), least)
                label_of = pa.array([row.column("label")[0].as_py()] * len(found[0]), row.column("label").type)
                yield pa.RecordBatch.from_arrays([label_of, *map(pa.array, found)],
                                                 names=["label", "rep", "links", "other"])

    kind = dict(classes.dtypes)["label"]
    found = cut_lineage(_work(listed).mapInArrow(
        run, f"label {kind}, rep bigint, links bigint, other bigint"))
    counted = found.groupBy("label", "rep").agg(F.sum("links").alias("links"))
    ids = (vectors.where(F.col(key).isNotNull())
           .select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"),
                   F.transform(vector, lambda x: x.cast("double")).alias("v")).distinct()
           .join(classes, ["label", "v"])
           .select("id", "label", "rep", "n"))
    ids = cut_lineage(ids)
    counts = (ids.join(counted, ["label", "rep"], "left")
              .groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    links = found.select("rep", "other").union(ids.select("id", "rep"))
    member = components(links, "rep", "other").withColumnRenamed("node", "id")
    node = F.col(key).cast("long")
    return (vectors.select(F.col(key), node.alias("id"))
            .join(counts, "id", "left").join(member, "id", "left")
            .select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col(key) == F.col("component_id")))
