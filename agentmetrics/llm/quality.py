"""Quality by importance resampling: two hashed n-gram models and a Gumbel top-k.

Words, runs of signs and pairs of neighbours are hashed into BUCKETS; a word that
follows itself is the same pair for all words. One model
counts them in target texts (documents labelled as good), one in all texts; the log
weight of a text is the sum, over its n-grams, of the log ratio of the two. Texts
are drawn without replacement in proportion to their weights: each log weight gets
Gumbel noise, seeded by the id, and the k greatest sums are selected.

k is the number of texts over the cut that parts labelled good from labelled bad
texts best (least sum of the two error rates). The kth sum is found by counting its
digits from the top, four small aggregates; nothing is sorted as a whole.

Counts cover all texts, and target texts and the labels for the cut are all labelled
ones. Labels are broadcast while they fit ``common.BROADCAST_BYTES``; more are joined by
a shuffle.

Defined cases: null and empty texts, and texts without n-grams, have log weight 0;
of several labels of a document the lowest counts, null labels do not; without
labels of both classes the cut is unbounded and all texts are selected; rows tied
with the kth are all selected, so repeated rows are treated alike; a null id draws
the noise of an empty one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import known_labels, stretches, whole_text, with_label

BUCKETS = 10_000
#: Pseudo-counts of a bucket in either model.
PRIOR = 1.0
TOKENS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
#: The n-gram of a word and itself, whatever the word.
REPEATED = np.uint64(0x5245504541544544)
#: Sums of weights and noise are kept in steps of 2 ** -20.
STEPS = 1 << 20


def grams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's words, runs of signs, and pairs of neighbours."""
    last = None
    for part in stretches(text.encode()):
        tokens = TOKENS.findall(part)
        if not tokens:
            continue
        hashes = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
        before = hashes[:-1] if last is None else np.concatenate([[last], hashes[:-1]]).astype(np.uint64)
        after = hashes[len(hashes) - len(before):]
        pairs = (before * np.uint64(0x9E3779B97F4A7C15) + after) >> np.uint64(20)
        pairs[before == after] = REPEATED
        last = hashes[-1]
        yield (np.concatenate([hashes, pairs]) % np.uint64(buckets)).astype(np.int64)


def log_ratios(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket the log of its share in target texts over that in all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                for found in grams(text.as_py() or "", buckets):
                    counts = np.bincount(found, minlength=buckets)
                    every += counts
                    if label == 1:
                        target += counts
        used = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(every[used]), pa.array(target[used])],
                                         ["_bucket", "_all", "_target"])

    counts = rows.select("_text", "_label").mapInArrow(count, "_bucket long, _all long, _target long") \
        .groupBy("_bucket").agg(F.sum("_all").alias("_all"), F.sum("_target").alias("_target"))
    every, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # at most one row a bucket
        every[row["_bucket"]], target[row["_bucket"]] = row["_all"], row["_target"]
    if not target.any():
        return np.zeros(buckets)
    return np.log((target + PRIOR) / (target.sum() + PRIOR * buckets)) \
        - np.log((every + PRIOR) / (every.sum() + PRIOR * buckets))


def weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """The log weight of each text."""
    return np.array([sum(ratios[found].sum() for found in grams(text.as_py() or "", len(ratios))) for text in texts], float)


def with_weight(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(_id, _sum, _label, _weight), with a checksum of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)
    kind = rows.schema["_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights(batch.column(3), shared.value))],
                                             ["_id", "_sum", "_label", "_weight"])

    return rows.select("_id", F.xxhash64(whole_text("_text")).alias("_sum"), "_label", "_text").mapInArrow(
        weigh, f"_id {kind}, _sum long, _label int, _weight double")


def best_cut(scored: DataFrame) -> float | None:
    """The log weight that parts the labelled classes best; None without both."""
    place = F.round(F.asinh("_weight") * 100).cast("int")  # some thousand steps at most
    counts = sorted(tuple(r) for r in scored.where("_label IS NOT NULL").groupBy(place.alias("_place")).agg(
        F.count_if(F.col("_label") == 0), F.count_if(F.col("_label") == 1)).collect())
    bad, good = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not bad or not good:
        return None
    best, cut, lost, caught = 0.0, None, 0, 0
    for i, (step, b, g) in enumerate(counts[:-1]):
        caught, lost = caught + b, lost + g
        gain = caught / bad - lost / good
        if gain > best:
            best, cut = gain, float(np.sinh((step + counts[i + 1][0]) / 200))
    return cut


def gumbel(doc_id: str, seed: int) -> Column:
    """Noise of the Gumbel law from the id's hash."""
    even = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(even))


def kth_greatest(keys: DataFrame, k: int) -> int | None:
    """The kth greatest of the whole numbers _key, by 16 bits at a time; None if there are fewer."""
    shifted = keys.select((F.col("_key").cast("decimal(20,0)") + F.lit(1 << 61)).cast("long").alias("_key"))
    prefix = 0
    for shift in (48, 32, 16, 0):
        inside = shifted if shift == 48 else shifted.where(F.shiftright("_key", shift + 16) == prefix)
        digits = inside.groupBy(F.shiftright("_key", shift).bitwiseAND(F.lit(0xFFFF)).alias("_digit")).count()
        for digit, count in sorted(((r["_digit"], r["count"]) for r in digits.collect()), reverse=True):
            if k <= count:
                prefix = prefix << 16 | digit
                break
            k -= count
        else:
            return None
    return prefix - (1 << 61)


def noisy_key(seed: int) -> Column:
    """Weight and noise of a row (_id, _weight) as a whole number."""
    bound = float(1 << 40)
    return F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("_weight") + gumbel("_id", seed))) * STEPS)


def decision(docs: DataFrame, labels: DataFrame, seed: int, text: str, doc_id: str,
             k: int | None) -> tuple[DataFrame, np.ndarray, Column]:
    """All rows (_id, _sum, _label, _weight, _key), the ratios behind the weights, and which keys are selected."""
    rows = with_label(docs, durable(known_labels(labels, "quality")), text, doc_id)
    ratios = log_ratios(rows)
    scored = durable(with_weight(rows, ratios).withColumn("_key", noisy_key(seed)))
    if k is None:
        cut = best_cut(scored)
        k = scored.count() if cut is None else scored.where(F.col("_weight") >= cut).count()
    least = kth_greatest(scored, k) if k else None
    return scored, ratios, F.lit(k > 0) if least is None else F.col("_key") >= F.lit(least)


def weighted(docs: DataFrame, labels: DataFrame, seed: int = 0, text: str = "text", doc_id: str = "doc_id",
             k: int | None = None) -> DataFrame:
    """Per row: _id, _sum, _label, _weight, _key (weight and noise) and _selected."""
    scored, _, chosen = decision(docs, labels, seed, text, doc_id, k)
    return scored.withColumn("_selected", chosen)


def select(docs: DataFrame, labels: DataFrame, seed: int = 0, text: str = "text", doc_id: str = "doc_id",
           k: int | None = None) -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept for every document."""
    return weighted(docs, labels, seed, text, doc_id, k).select(
        F.col("_id").alias("doc_id"), F.col("_weight").alias("log_weight"),
        (F.col("_key") / STEPS).alias("gumbel_key"), F.col("_selected").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 0, text: str = "text",
              doc_id: str = "doc_id") -> DataFrame:
    """The selected rows, with their own columns.

    With the ratios and the least key known, a row's fate follows from its text and id
    alone, so rows are weighed once more and filtered where they are; none is shuffled.
    """
    _, ratios, chosen = decision(docs, labels, seed, text, doc_id, None)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                        F.col(doc_id).alias("_id"))
    place = docs.columns.index(text)
    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in ("_doc", "_id"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [place])  # not sent a second time
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights(texts, shared.value))],
                                             ["_doc", "_id", "_weight"])

    weighed = whole.mapInArrow(weigh, f"{kinds}, _weight double")
    return weighed.withColumn("_key", noisy_key(seed)).where(chosen).select("_doc.*")
