"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    clustering, exact_dedup, language_id, merkle, mixing, packing, pii, piece_encoding, quality, simhash,
    toxicity, url_filter, vector_search)
from .common import table, tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return register


@query("op6_exact_dedup", r"""
WITH prints AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM prints)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@query("op4_piece_encoding")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return piece_encoding.encode_table(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op9_vector_search", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.top_k(table(spark, folder, "embeddings"))


@query("op1_mixing", mixing.mix_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_table(table(spark, folder, "documents"))


@query("op3_url_filter")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality.select(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query("op11_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op12_clustering", clustering.cluster_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings"))


@query("op13_merkle", merkle.manifest_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))
