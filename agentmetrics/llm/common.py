"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

#: A table is broadcast only if its rows, at this many bytes each, stay under the limit.
BROADCAST_BYTES = 64 << 20
#: Most bytes of an Arrow batch in the pipeline.
BATCH_BYTES = 4 << 20
#: A broadcast (id, label) row as the check tool measured it (6 MB for 68,226 rows), rounded up.
LABEL_BYTES = 96
#: Keys with at least this share of all rows are joined as heavy ones; there are at most 1/share.
HEAVY_SHARE = 0.001


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, which Spark bounds by rows: ten thousand long texts are held
    several times over by the task and its Python worker. A lower bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name).lower())
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tokenizer(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(col: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def id_remainder(col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % divisor


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marked for broadcast where ``rows`` counted rows fit the limit; else any join will do."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, safe where a group holds most rows.

    ``size`` is the number of ``rows`` of a group and ``total`` their sum, so at
    most 1 / HEAVY_SHARE groups are heavy: those are broadcast and their rows stay
    where they are. Any other key holds under HEAVY_SHARE of the rows.
    """
    heavy = F.broadcast(groups.where(F.col(size) >= F.lit(max(2.0, total * HEAVY_SHARE))))
    light = groups.where(F.col(size) < F.lit(max(2.0, total * HEAVY_SHARE)))
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key))


def stretches(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes that end at white space where they can."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(b" ", at, at + size), data.rfind(b"\n", at, at + size)) + 1
        yield data[at:cut or at + size]
        at = cut or at + size
    yield data[at:]


def known_labels(labels: DataFrame, label: str, among: Column | None = None) -> DataFrame:
    """(_id, _label): every id of the classes 0 and 1, once.

    Null ids and labels are left out; of several labels of an id the lowest counts.
    """
    return labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"),
                         (F.lit(True) if among is None else among).alias("_among")) \
        .where("_among AND _id IS NOT NULL AND _label IN (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))


def labelled_sample(known: DataFrame, rows: int) -> DataFrame:
    """(_id, _label): at most ``rows`` of the known labels of each class, lowest hash of the id first."""
    known = durable(known.withColumn("_order", F.xxhash64("_id")))
    parts = [known.where(F.col("_label") == c).orderBy("_order", "_id").limit(rows) for c in (0, 1)]
    return durable(parts[0].unionByName(parts[1]).select("_id", "_label"))


def with_label(docs: DataFrame, known: DataFrame, text: str, doc_id: str, how: str = "left") -> DataFrame:
    """(_id, _text, _label) of documents; narrow labels too many for a broadcast are joined by a shuffle."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return rows.join(maybe_broadcast(known, known.count(), LABEL_BYTES), "_id", how).select("_id", "_text", "_label")
