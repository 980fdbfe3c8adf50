"""SimHash near-dedup: fingerprints of word shingles, compared as bit planes.

A fingerprint's bit is set if more than half of the shingles' hashes set it. Two
fingerprints link at RADIUS or fewer differing bits, and groups are the connected
components of the links.

Search: 64 bits are cut into BLOCKS parts; linked fingerprints differ in at most
RADIUS of them, so at least BLOCKS - RADIUS parts agree, and each choice of such
parts is a key. Only distinct fingerprints are keyed, and a key's bucket is compared
in one task. A bucket of more than TILE is cut into tiles; each pair of tiles is a
bucket of its own, so no task holds more than two tiles and no link is lost.

Comparison: the bit planes of many fingerprints lie one below the other, so that an
XOR of two rows of bytes compares one bit of eight pairs at once. Carry-save
counters of two planes sum the differences; a byte is given up once all its pairs
have overflowed. Inside a bucket the links are thinned to a spanning forest.

Defined cases: null and empty texts have fingerprint zero, linked like any other;
texts of one or two words are one shingle; repeated rows share their component; a
null id takes no part in the smallest id; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, job_scratch
from . import shingle_links
from .common import join_groups, maybe_broadcast, whole_text
from .components import components

RADIUS = 3
#: Words of a shingle.
WIDTH = 3
BLOCKS = (13, 13, 13, 13, 12)
TILE = 4096
SHINGLES_AT_ONCE = 1 << 16
COUNTERS = (RADIUS + 1).bit_length() - 1  # planes; RADIUS + 1 is a power of two


def fingerprint(text: str, width: int = WIDTH) -> bytes:
    """Eight bytes, most significant first. Upper-case A-Z count as lower case."""
    words = text.encode().lower().split()
    if not words:
        return bytes(8)
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    number, counts = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    hashes = b"".join(map(xxhash.xxh64_digest, shingles, repeat(42)))
    for at in range(0, number, SHINGLES_AT_ONCE):
        part = np.frombuffer(hashes[8 * at:8 * (at + SHINGLES_AT_ONCE)], np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > number).tobytes()


def with_fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(_id, _sum, _print): id, a checksum of the text, fingerprint as a signed number."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(text.as_py() or "", width) for text in batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.frombuffer(found, ">i8").astype(np.int64))],
                ["_id", "_sum", "_print"])

    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(whole_text(text)).alias("_sum"),
                       F.col(text).alias("_text")).mapInArrow(prints, f"_id {kind}, _sum long, _print long")


def near_pairs(prints: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lanes within RADIUS; lane i is compared with those from i + 1 to ends[i] - 1."""
    n = len(prints)
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    planes: dict[int, np.ndarray] = {}

    def shifted(by: int) -> np.ndarray:
        if by not in planes:
            planes[by] = np.packbits(np.vstack([bits[by:], np.zeros((by + 8, 64), np.uint8)]).T, axis=1)
        return planes[by]

    lanes = np.arange(n)
    for distance in range(1, int((ends - lanes).max(initial=0))):
        valid = np.packbits(ends - lanes > distance)
        at = np.flatnonzero(valid)
        live, whole, rest = valid[at], distance // 8, distance % 8
        counters = [np.zeros(len(at), np.uint8) for _ in range(COUNTERS)]
        for j in range(0, 64, 8):
            rows = shifted(0)[j:j + 8][:, at] ^ shifted(rest)[j:j + 8][:, at + whole]
            for carry in rows:
                for k in range(COUNTERS):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                live = live & ~carry
            keep = live != 0
            if not keep.all():
                at, live, counters = at[keep], live[keep], [c[keep] for c in counters]
            if not len(at):
                break
        if len(at):
            left = (at[:, None] * 8 + np.arange(8))[np.unpackbits(live).reshape(-1, 8) == 1]
            yield left, left + distance


def forest(prints: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what near_pairs connects, at most one for each fingerprint."""
    parent: dict[int, int] = {}
    a, b = [], []

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    for left, right in near_pairs(prints, ends):
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
    return prints[np.array(a, int)], prints[np.array(b, int)]


def link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, high, print) sorted by bucket to links (a, b)."""
    held: pa.Table | None = None

    def linked(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(c).to_numpy() for c in range(4)]
        n = len(columns[0])
        new = np.zeros(n, bool)
        new[:1] = True
        for column in columns[:3]:
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        several = np.repeat(sizes > 1, sizes)
        ends = np.repeat(np.cumsum(sizes[sizes > 1]), sizes[sizes > 1])
        a, b = forest(columns[3][several], ends)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        changed = np.zeros(rows.num_rows - 1, bool)
        for c in range(3):
            column = rows.column(c).to_numpy()
            changed |= column[1:] != column[:-1]
        cut = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
        if cut:
            yield linked(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None:
        yield linked(held)


def keys(fp: str) -> Column:
    """One key for each choice of parts that linked fingerprints may agree on."""
    parts, offset = [], 0
    for width in BLOCKS:
        parts.append((F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1)), width))
        offset += width
    out = []
    for number, chosen in enumerate(combinations(parts, len(BLOCKS) - RADIUS)):
        key = F.lit(number).cast("long")
        for part, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(part)
        out.append(key)
    return F.array(*out)


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links between distinct fingerprints (column _print) that connect all within RADIUS."""
    keyed = distinct.select("_print", F.explode(keys("_print")).alias("_key"))
    large = durable(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
                    .select("_key", F.ceil(F.col("_n") / tile).cast("int").alias("_tiles")))
    own = F.pmod(F.xxhash64("_print"), F.col("_tiles").cast("long")).cast("int")
    tiled = keyed.join(maybe_broadcast(large, large.count(), 48), "_key", "left").withColumn(
        "_other", F.explode(F.when(F.col("_tiles").isNull(), F.array(F.lit(0)))
                            .otherwise(F.sequence(F.lit(0), F.col("_tiles") - 1))))
    own = F.coalesce(own, F.lit(0))
    buckets = tiled.select("_key", F.least(own, "_other").alias("_low"), F.greatest(own, "_other").alias("_high"),
                           "_print")
    return buckets.repartition("_key", "_low", "_high").sortWithinPartitions("_key", "_low", "_high").mapInArrow(
        link_buckets, "a long, b long")


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Per row: _id, _sum, _print and _component."""
    return with_component(durable(with_fingerprint(docs, text, doc_id, width)), links)


def grouped_by_similarity(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                          width: int = shingle_links.WIDTH) -> DataFrame:
    """As ``grouped``, with links between texts of similar shingle sets; _print tells the sets apart.

    Fingerprints of the sets are searched first, as in ``links``, and the pairs found are checked by
    whole sets. Similar sets whose fingerprints differ in more than RADIUS bits are found by shared shingles.
    """
    spark = docs.sparkSession
    with job_scratch(spark):
        rows = durable(shingle_links.with_keys(docs, text, doc_id, width))
        near = durable(near_sets(rows))
        return durable(with_component(rows.select("_id", "_sum", "_print"), lambda _: shingle_links.links(
            docs, rows, near, text, doc_id, width)), outlive=1)


def near_sets(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of _print that connect all whose _sim is the same or links."""
    sets = durable(rows.select("_print", "_sim").distinct())
    one = durable(sets.groupBy("_sim").agg(F.min("_print").alias("_one")))
    same = sets.join(maybe_broadcast(one, one.count(), 32), "_sim").select(F.col("_one").alias("a"), F.col("_print").alias("b"))
    found = durable(links(one.select(F.col("_sim").alias("_print"))))
    linked = found.join(one.select(F.col("_sim").alias("a"), F.col("_one").alias("_a")), "a").join(
        one.select(F.col("_sim").alias("b"), F.col("_one").alias("_b")), "b").select(
        F.col("_a").alias("a"), F.col("_b").alias("b"))
    both = same.unionByName(linked).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_component(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds to rows (_id, _sum, _print) the least id of all whose _print is connected."""
    distinct = durable(rows.groupBy("_print").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    roots = durable(components(durable(link(distinct))))
    placed = distinct.join(roots.select(F.col("node").alias("_print"), F.col("root").alias("_root")), "_print", "left") \
        .withColumn("_linked", F.col("_root").isNotNull())
    least = placed.where("_linked").groupBy("_root").agg(
        F.min("_least").alias("_component"), F.count(F.lit(1)).alias("_prints"))
    linked = durable(placed.where("_linked").select("_print", "_root", "_n"))
    named = join_groups(linked, least, "_root", "_prints", linked.count()).select("_print", "_component", "_n") \
        .unionByName(placed.where("NOT _linked").select("_print", F.col("_least").alias("_component"), "_n"))
    return join_groups(rows, durable(named), "_print", "_n", rows.count())


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    return grouped(docs, text, doc_id, width).select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The row with the smallest id of each component, with its own columns.

    Rows are dropped by a join with the narrow table of those that go, so kept texts
    are not grouped. Should a smallest id have several rows, one of them stays.
    """
    return least_of_each(docs, grouped(docs, text, doc_id, width), text, doc_id)


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 width: int = shingle_links.WIDTH) -> DataFrame:
    """As ``drop_near_copies``, for components of texts with similar shingle sets."""
    return least_of_each(docs, grouped_by_similarity(docs, text, doc_id, width), text, doc_id)


def least_of_each(docs: DataFrame, placed: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component of ``placed``."""
    rows = durable(placed)
    choice = rows.where(F.col("_id").eqNullSafe(F.col("_component"))).groupBy("_id", "_sum", "_component").agg(
        F.count(F.lit(1)).alias("_n"))
    several = choice.groupBy("_component").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_component")
    again = durable(choice.join(several, "_component").select("_id", "_sum", "_component"))
    go = durable(rows.where(~F.col("_id").eqNullSafe(F.col("_component"))).select("_id", "_sum").unionByName(
        again.select("_id", "_sum")).distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                        F.col(doc_id).alias("_id"), F.xxhash64(whole_text(text)).alias("_sum"))

    def same(other: DataFrame) -> Column:
        return whole["_id"].eqNullSafe(other["_id"]) & (whole["_sum"] == other["_sum"])

    stay = whole.join(maybe_broadcast(go, go.count(), 64), same(go), "left_anti")
    one = whole.join(maybe_broadcast(again, again.count(), 64), same(again)).dropDuplicates(["_component"])
    return stay.select("_doc.*").unionByName(one.select("_doc.*"))
