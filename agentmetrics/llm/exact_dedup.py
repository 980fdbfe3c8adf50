"""Exact dedup by two passes over a Bloom filter; DataFrame functions only.

Pass one sets a few bits of one 64-bit block per distinct text and keeps, per
block, the bits that were set more than once. Pass two tests each row: a row with
a bit that nothing else has set is the only one of its text, and goes straight
through. Only the others are shuffled, as narrow rows, and grouped by their hash.
False alarms of the filter end as groups of one, so the result is exact.

The filter has BITS_PER_ROW bits a row. It is broadcast while it fits
``common.BROADCAST_BYTES``; a larger one is joined by block.

Defined cases: null text counts as empty, and all empty texts are one group; of
rows with the same id and length, one stays; a null id comes before all others;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import join_groups, maybe_broadcast, whole_text

BITS_PER_ROW = 16
BITS_SET = 6
FILTER_ROW_BYTES = 48
#: Fixed by the contract: the characters that do not count.
IGNORED = r"[\x20\x09-\x0D]+"


def text_hash(text: str = "text") -> Column:
    """SHA-256 of the normalised text, in lowercase hex."""
    return F.sha2(F.regexp_replace(whole_text(text), IGNORED, "").cast("binary"), 256)


def with_bits(df: DataFrame, blocks: int, sha: str = "_sha") -> DataFrame:
    """Adds the block of a hash and the bits it sets there."""
    bits = F.xxhash64(sha, F.lit(2))
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        position = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), position))
    return df.withColumn("_block", F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(blocks).cast("long"))) \
        .withColumn("_mask", mask)


def repeat_filter(prints: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Per block the bits set at least twice, and the number of blocks.

    Equal hashes are counted before they meet in a block, so copies, however many,
    reach it as one entry, and a block's list holds a handful of entries.
    """
    blocks = max(1, rows * BITS_PER_ROW // 64)
    entries = with_bits(prints.select("_sha"), blocks).groupBy("_block", "_mask").agg(
        F.count(F.lit(1)).alias("_n"))
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("once"), none.alias("more"))

    def add(seen: Column, entry: Column) -> Column:
        mask, repeated = entry["_mask"], entry["_n"] > 1
        more = seen["more"].bitwiseOR(F.when(repeated, mask).otherwise(seen["once"].bitwiseAND(mask)))
        return F.struct(seen["once"].bitwiseOR(mask).alias("once"), more.alias("more"))

    return entries.groupBy("_block").agg(F.collect_list(F.struct("_mask", "_n")).alias("_all")).select(
        "_block", F.aggregate("_all", start, add)["more"].alias("_more")), blocks


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One narrow row per document, written down: its id, hash, length and a row number."""
    return durable(docs.select(
        F.col(doc_id).alias("_id"), text_hash(text).alias("_sha"),
        F.length(whole_text(text)).cast("long").alias("_len")).withColumn("_row", F.monotonically_increasing_id()))


def split_by_filter(rows: DataFrame, seen: DataFrame, blocks: int, blocks_used: int) -> DataFrame:
    """Adds ``_maybe``: whether all bits of the row's hash were set more than once."""
    probed = with_bits(rows, blocks).join(
        maybe_broadcast(seen, blocks_used, FILTER_ROW_BYTES), "_block", "left")
    hit = F.coalesce(F.col("_more"), F.lit(0)).bitwiseAND(F.col("_mask")) == F.col("_mask")
    return probed.withColumn("_maybe", hit).drop("_block", "_mask", "_more")


def verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: _id, _sha, _len, the group's _keep_id and _size, and _kept."""
    prints = fingerprints(docs, text, doc_id)
    seen, blocks = repeat_filter(prints, prints.count())
    probed = split_by_filter(prints, durable(seen), blocks, blocks)
    alone = probed.where(~F.col("_maybe")).select(
        "_id", "_sha", "_len", F.col("_id").alias("_keep_id"),
        F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    maybe = durable(probed.where("_maybe").drop("_maybe"))
    # by length first: two hash aggregates, each combined before its shuffle
    best = maybe.groupBy("_sha", "_len").agg(
        F.min(F.struct("_id", "_row")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = best.groupBy("_sha").agg(
        F.max_by("_first", "_len").alias("_first"), F.sum("_n").alias("_size"))
    joined = join_groups(maybe, groups, "_sha", "_size", maybe.count())
    return alone.unionByName(joined.select(
        "_id", "_sha", "_len", F.col("_first._id").alias("_keep_id"), "_size",
        (F.col("_row") == F.col("_first._row")).alias("_kept")))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return verdicts(docs, text, doc_id).select(
        F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Texts of rows that the filter clears never leave their task; of the others,
    only those that equal their group's choice are shuffled.
    """
    columns = docs.columns
    prints = fingerprints(docs, text, doc_id)
    seen, blocks = repeat_filter(prints, prints.count())
    seen = durable(seen)
    maybe = split_by_filter(prints, seen, blocks, blocks).where("_maybe")
    best = maybe.groupBy("_sha", "_len").agg(F.min("_id").alias("_id"), F.count_if(F.col("_id").isNull()).alias("_nulls"))
    chosen = durable(best.groupBy("_sha").agg(
        F.max_by(F.struct(F.when(F.col("_nulls") == 0, F.col("_id")).alias("_best"), "_len"), "_len").alias("_first"))
        .select("_sha", F.col("_first._best").alias("_best"), F.col("_first._len").alias("_best_len")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"),
                       F.col(doc_id).alias("_id"), text_hash(text).alias("_sha"),
                       F.length(whole_text(text)).cast("long").alias("_len"))
    probed = split_by_filter(rows, seen, blocks, blocks)
    alone = probed.where(~F.col("_maybe")).select("_doc.*")
    same = (F.col("c._sha") == F.col("r._sha")) & (F.col("c._best_len") == F.col("r._len")) \
        & F.col("c._best").eqNullSafe(F.col("r._id"))
    kept = probed.where("_maybe").alias("r").join(chosen.alias("c"), same, "left_semi")
    return alone.unionByName(kept.dropDuplicates(["_sha"]).select("_doc.*"))
