"""A training corpus from ``documents``: stages that each take the table and give it on, and ``run`` for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import exact_dedup, langid, minhash, mixing, pieces
from webloom.llm.common import stored
from webloom.llm.queries import TOKENIZERS, labels

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text that Spark hands to a Python worker at once. A task holds a batch several times: as vectors and as a stream
#: beside the heap, and in its worker. Spark's own limit is 64 MB, so a whole split was one batch.
BATCH = "2m"


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand texts to Python in batches of about ``BATCH``, unless it has a limit of its own. The limit
    stays, since stages are lazy; results do not depend on it."""
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, BATCH)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found and not ambiguous."""
    small_batches(spark)
    return langid.drop_unidentified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups (shingles of five words, similarity 0.8 or more), the document with the smallest id."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; labelled quality sets the odds."""
    return mixing.take_mix(docs, labels(spark, sf_dir))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256, decoded_sha256, lossless, pieces): a sampled segmentation of each document,
    decoded in the same Python stage, and whether its pieces give the text back. Null text counts as empty; an empty
    table gives no rows."""
    small_batches(spark)
    return pieces.round_trip(docs, f"{TOKENIZERS}/piece_bpe_32k.model", with_pieces=True)


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# Classifiers, MinHash and sampled segmentations are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
