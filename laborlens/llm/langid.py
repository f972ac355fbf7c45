"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled rows in Spark, at most about `rows_per_lang` rows of each
language, chosen by a hash of their id; that bound is the only sample here.  Scoring reads whole
texts: the matrix of log probabilities, of fixed size, is broadcast, and numpy sums its columns
over the n-grams of many texts at once.

A text that is null or has no letter is `und` with score 0.  Without any labelled row every text
is.  Rows with a null label are not learned from.  Equal scores go to the language that sorts
first; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import chunks, text_buffer
from .codepoints import LETTER, decode, kinds, lowered, widths

NONE = "und"
SIZES = (1, 2, 3)
BUCKETS = 1 << 15
MOST_LANGUAGES = 512


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # [bucket, language]
    prior: np.ndarray

    def expected(self) -> np.ndarray:
        """Mean log probability of an n-gram of each language's own texts."""
        own = self.weights[:-1]
        return (np.exp(own) * own).sum(axis=0)


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams of every size, code point where each text begins, whether it has a letter).

    What is not a letter reads as one blank, so that digits and signs say nothing.  The n-grams of
    one size fill a row; those that cross into the next text get the extra bucket.
    """
    points = decode(data.tobytes())
    edges = offsets
    if len(points) != len(data):
        edges = np.searchsorted(np.concatenate([[0], np.cumsum(widths(points))]), offsets)
    letter = kinds()[points] == LETTER
    known = np.concatenate([[0], np.cumsum(letter)])
    has_letter = known[edges[1:]] > known[edges[:-1]]
    low = np.where(letter, lowered()[points], 32).astype(np.uint64)
    n = len(low)
    out = np.full((len(SIZES), n), buckets, np.int32)
    cuts = edges[1:-1]
    rolled = np.zeros(n, np.uint64)
    for row, size in enumerate(SIZES):
        if n < size:
            continue
        rolled = rolled[:n - size + 1] * np.uint64(0x100000001B3) + low[size - 1:] + np.uint64(1)
        mixed = rolled * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        out[row, :n - size + 1] = (mixed >> np.uint64(40)) % np.uint64(buckets)
        for back in range(1, size):
            at = cuts - back
            out[row, at[at >= 0]] = buckets
    return out, edges, has_letter


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        rows_per_lang: int = 4000, buckets: int = BUCKETS) -> Model:
    """Learn from rows with a label and a text."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(label).count().orderBy(label).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r[0] for r in sizes]
    if not languages:
        return Model([], np.zeros((buckets + 1, 0)), np.zeros(0))
    share = F.create_map(*[x for r in sizes for x in (
        F.lit(r[0]), F.lit(min(1.0, rows_per_lang / r[1])))])[F.col(label)]
    chosen = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * (1 << 20))
    number = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), buckets + 1), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, edges, _ = _grams(*text_buffer(part.column("text")), buckets)
                for lang, a, b in zip(part.column("label").to_pylist(), edges[:-1], edges[1:]):
                    counts[number[lang]] += np.bincount(
                        grams[:, a:b].ravel(), minlength=buckets + 1)
        for row, lang in zip(counts[:, :buckets], languages):
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(row[seen])],
                names=["label", "bucket", "n"])

    table = (chosen.select(F.col(label).alias("label"), F.col(text).alias("text"))
             .mapInArrow(run, "label string, bucket int, n bigint")
             .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((buckets + 1, len(languages)))
    place = np.array([number[x] for x in table.column("label").to_pylist()], np.int64)
    counts[table.column("bucket").to_numpy(), place] = table.column("n").to_numpy()
    smooth = counts[:buckets] + 0.5
    weights = np.zeros((buckets + 1, len(languages)))
    weights[:buckets] = np.log(smooth / smooth.sum(axis=0))
    prior = np.array([r[1] for r in sizes], float)
    return Model(languages, weights, np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
            with_text: bool = False) -> DataFrame:
    """Per row its key, `lang_pred`, `score`, the probability of that language, `fit` and `n_grams`.

    `fit` does not depend on the length of a text: the mean log probability of its n-grams in that
    language, less the mean that the language's own texts have; null for `und`.  `with_text` keeps the text too, so that a filter needs no join.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    buckets = len(model.weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = np.array([*known.languages, NONE], object)
        usual = known.expected()
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, edges, has_letter = _grams(*text_buffer(part.column("text")), buckets)
                lang = np.full(part.num_rows, len(known.languages))
                score, fit = np.zeros(part.num_rows), np.full(part.num_rows, np.nan)
                count = sum(np.maximum(np.diff(edges) - size + 1, 0) for size in SIZES)
                rows = np.flatnonzero(has_letter)
                if len(rows) and known.languages:
                    total = np.tile(known.prior, (len(rows), 1))
                    spans = np.stack([edges[rows], edges[rows + 1]], axis=1).ravel()
                    for k in range(len(known.languages)):
                        column = known.weights[:, k]
                        each = np.append(sum(column[line] for line in grams), 0.0)
                        total[:, k] += np.add.reduceat(each, spans)[::2]
                    best = total.argmax(axis=1)
                    mean = (total[np.arange(len(rows)), best] - known.prior[best]) / count[rows]
                    fit[rows] = mean - usual[best]
                    total -= total.max(axis=1, keepdims=True)
                    lang[rows], score[rows] = best, 1 / np.exp(total).sum(axis=1)
                kept = [part.column("text")] if with_text else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(names[lang].tolist(), pa.string()),
                     pa.array(score), pa.array(fit, from_pandas=True), pa.array(count.astype(np.int64)),
                     *kept],
                    names=["key", "lang_pred", "score", "fit", "n_grams", *["text"] * with_text])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(
        run, f"key {kind}, lang_pred string, score double, fit double, n_grams bigint"
             + ", text string" * with_text)
    return found.select(F.col("key").alias(key), "lang_pred", "score", "fit", "n_grams",
                        *[F.col("text").alias(text)] * with_text)
