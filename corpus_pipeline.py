"""The corpus pipeline: documents in, packed pieces out.

Each stage works on all that the one before kept and, but for the last, returns the columns of
documents.  Every stage is written as Parquet in the folder that spark.checkpoint.dir names and
read again, so that a lost executor costs one stage's tasks and not the whole chain.

Null and empty texts have no language and go with the first stage.  Later stages may leave texts
empty; those stay, as documents of the end token alone.  A row that repeats both id and text is the
same document again: no stage tells the two apart, so both stay or go.  Columns other than those of
documents are dropped by the first stage.

Stages hand texts to Python in small batches: they set Spark's number of rows an Arrow batch of the
session to `BATCH_ROWS`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from laborlens.llm import langid, line_dedup, minhash_forest, packing, suffix_dedup
from laborlens.llm.common import cut_lineage, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Texts of a language that was learned lie above it by far, whatever their length; others below.
LEAST_FIT = -3.5
FEW_N_GRAMS = 200  # shorter texts cannot be told apart and stay
BATCH_ROWS = 1000
TOKENIZER = "byte_bpe_50k.json"


def _documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with the text's length brought up to date."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source",
                       F.length(text).cast("long").alias("n_chars"))


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing label is filled with the one found.

    Those without a letter go, and those whose n-grams are, on average, far less likely than the
    n-grams of the language's own texts.

    Where no document has a label, no language is known, and all documents stay.
    """
    _small_batches(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs.select(*COLUMNS)
    keyed = docs.select(F.struct(*[c for c in COLUMNS if c != "text"]).alias("doc"), "text")
    found = langid.predict(keyed, model, key="doc", with_text=True).where(
        (F.col("lang_pred") != langid.NONE)
        & ((F.col("n_grams") < FEW_N_GRAMS) | (F.col("fit") >= LEAST_FIT)))
    return found.select("doc.doc_id", "text", F.coalesce("doc.lang", "lang_pred").alias("lang"),
                        "doc.source", "doc.n_chars")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    return _documents(line_dedup.apply(docs, line_dedup.build(docs)), "kept_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    _small_batches(spark)
    judged = minhash_forest.near_duplicates(docs, words=5, percent=80)
    gone = judged.where("not kept").select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; no character is cut in two."""
    _small_batches(spark)
    kept = suffix_dedup.remove_repeats(docs, 100, whole_characters=True, keep=("lang", "source"))
    return _documents(kept.withColumn("text", F.col("kept").cast("string")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    _small_batches(spark)
    cut = packing.pieces(docs, public_tokenizers.path(TOKENIZER))
    cut = cut_lineage(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32",
                                    "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]
# Classifiers, token ids and packing are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
