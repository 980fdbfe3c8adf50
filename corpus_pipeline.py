"""The corpus pipeline: quality, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, folder) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agentmetrics.llm import exact_dedup, mixing, piece_encoding, quality, simhash
from agentmetrics.llm.common import small_batches, table, tokenizer
from agentmetrics.session import durable


#: Cuts that a worker of the encoding stage remembers: its memory also holds what earlier stages left.
REMEMBERED = 150_000


def keep_good_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose noisy importance weight is among the greatest stay."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, folder, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents with the same text one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of texts that share 0.8 of their five-word shingles one document stays.

    Fingerprints propose the pairs, whole shingle sets decide."""
    small_batches(spark)
    return simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """As many tokens as there are, shared out by weight; a document comes once an epoch."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids of every document, as counts and hashes."""
    small_batches(spark)
    return piece_encoding.encode_table(docs, tokenizer("piece_bpe_32k.model"), remembered=REMEMBERED, lasting=False)


STAGES = [
    ("quality", keep_good_texts),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Fitted weights, components and library encodings have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
