"""Links between texts by the similarity of their word shingles, without loss.

A text is the set of hashes of its WIDTH-word shingles, in lower case A-Z; a text of
fewer words is one shingle. Two texts link if their sets have at least
SIMILAR_NUM / SIMILAR_DEN of their union in common (Jaccard, compared in whole numbers).

Search: all sets are read in one order. Sets that similar must share a shingle among
the first n - ceil(n * similarity) + 1 of each, so only these are keys; keys held by one
set alone are dropped in one pass over sorted rows. Shingles that a sample of texts
holds often come last in the order. The sample decides the cost, never the result. A key
whose sets all hold one same key just before it is dropped, as its pairs meet there.

Candidates: pairs proposed by the caller (those of near SimHash fingerprints) come first.
For what they leave, the sizes and places of a shared key bound what two sets can have in
common. First each key's sets are compared with one of them, STARS times with
another centre, so that a large group of near copies joins without all its pairs;
then with the set whose sketch is nearest, of those not joined yet; then all pairs of a key whose
sets are not joined yet. The last two compare a key's sets inside a task, by sizes, places and
folded sketches, and only pairs that these leave become rows. A key of more than TILE sets is cut
into tiles; each pair of tiles is a bucket of its own.

Each set has a sketch of SKETCH_WORDS * 64 parities: which of its parts hold an odd
number of shingles. Two sketches differ in at most as many places as the sets do, so a pair
whose sketches differ in too many is settled by them. FOLD words, the sketch folded on
itself, are at hand where keys meet, so that a pair they settle is never made. Texts of
the other pairs, few more than the similar ones, are cut into shingles again and compared in
whole sets. What a round lands is deleted when its links are known.

Defined cases: null and empty texts are one set, linked as copies; texts with the same
set are one node; an empty table has no links. Shingles and sets are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, job_scratch
from .common import maybe_broadcast, whole_text
from .components import components

WIDTH = 5
SIMILAR_NUM, SIMILAR_DEN = 4, 5
STARS = 2
NEAREST = -1
SKETCH_WORDS, FOLD = 64, 16
FOLDED = [f"_f{i}_" for i in range(FOLD)]
#: Sets of a key that are compared with each other, or with those of another tile, in one task.
TILE = 4096
#: Texts whose shingles are counted for the order, and from how many a shingle is common.
ORDER_TEXTS = 10_000
COMMON_FROM = 4
COMMON = 200_000


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = text.encode().lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), ">i8").astype(np.int64))


def node_of(found: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh64_digest(found.tobytes(), 7), ">i8")[0])


def majority(found: np.ndarray) -> int:
    """SimHash fingerprint of a set of hashes: a bit is set if more than half of them set it."""
    bits = np.unpackbits(found.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(found)).view(">i8")[0])


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def with_sets(texts: DataFrame, width: int) -> DataFrame:
    """(_print, _set) of a column of texts."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py() or "", width) for t in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), lists(sets)], ["_print", "_set"])

    return texts.mapInArrow(find, "_print long, _set array<long>")


def common_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles that many sampled texts hold, the most frequent last."""
    share = min(1.0, ORDER_TEXTS / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64(F.col(text), F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)) \
        .select(F.col(text).alias("_text"))
    counts = with_sets(picked, width).select(F.explode("_set").alias("_key")).groupBy("_key").count()
    return np.array([r["_key"] for r in counts.where(F.col("count") >= COMMON_FROM)
                     .orderBy(F.col("count").desc(), "_key").limit(COMMON).collect()][::-1], np.int64)


def with_keys(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(_id, _sum, _print, _sim, _n, _bits, _keys): id, checksum of the text, node, fingerprint, size and sketch
    of its set, its first shingles."""
    common = common_shingles(docs, text, width)
    by_value = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[by_value], by_value + 1))
    kind = docs.schema[doc_id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, places = shared.value
        for batch in batches:
            nodes, sims, sizes, bits, keys = [], [], [], [], []
            for t in batch.column(2):
                found = shingle_set(t.as_py() or "", width)
                n = len(found)
                nodes.append(node_of(found))
                sims.append(majority(found))
                sizes.append(n)
                bits.append(sketch(found))
                if len(values):
                    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                    found = found[np.lexsort((found, np.where(values[at] == found, places[at], 0)))]
                keys.append(found[:n + (-n * SIMILAR_NUM // SIMILAR_DEN) + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sims, pa.int64()),
                 pa.array(sizes, pa.int32()), lists(bits), lists(keys)],
                ["_id", "_sum", "_print", "_sim", "_n", "_bits", "_keys"])

    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(whole_text(text)).alias("_sum"),
                       F.col(text).alias("_text")).mapInArrow(
        find, f"_id {kind}, _sum long, _print long, _sim long, _n int, _bits array<long>, _keys array<long>")


def several_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_key, _print, _n, _at) sorted by key and node, without repeats and keys of a single node."""
    held, joined = None, False  # the last row so far, and whether it shares its key with the one before
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        key, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        keep = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        rows, key = rows.filter(pa.array(keep)), key[keep]
        same = key[1:] == key[:-1]
        before, after = np.append(joined and held is not None, same), np.append(same, False)
        out = before | after
        held, joined = rows.slice(len(key) - 1), bool(before[-1])
        yield from rows.slice(0, len(key) - 1).filter(pa.array(out[:-1])).combine_chunks().to_batches()
    if held is not None and joined:
        yield from held.combine_chunks().to_batches()


def needed_keys(held: DataFrame) -> DataFrame:
    """``held`` without keys whose sets all hold the same key next before: their pairs meet at that one,
    with places that leave more room."""
    before = held.withColumn("_before", F.lag("_key").over(Window.partitionBy("_print").orderBy("_at")))
    own = before.groupBy("_key").agg(F.min("_before").alias("_low"), F.max("_before").alias("_high"),
                                     (F.count("_before") < F.count(F.lit(1))).alias("_first"))
    return held.join(own.where("_first OR _low <> _high").select("_key"), "_key", "left_semi")


def sketch(found: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Per part of the hashes whether the set holds an odd number of them, as whole numbers of 64 bits."""
    places = (found.view(np.uint64) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * words) & 1).astype(np.uint8)).view(np.int64)


def folded(bits: str) -> list[Column]:
    """The sketch folded into FOLD words: as part of a coarser cut, it differs in no more places than the sets."""
    def word(i: int) -> Column:
        out = F.col(bits)[i]
        for j in range(i + FOLD, SKETCH_WORDS, FOLD):
            out = out.bitwiseXOR(F.col(bits)[j])
        return out.alias(FOLDED[i])

    return [word(i) for i in range(FOLD)]


def settled_by_sketch(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out that their sets are similar."""
    left = sketches.select(F.col("_print").alias("a"), F.col("_n").alias("_n1"), F.col("_bits").alias("_bits1"))
    right = sketches.select(F.col("_print").alias("b"), F.col("_n").alias("_n2"), F.col("_bits").alias("_bits2"))
    differing = F.aggregate(F.zip_with("_bits1", "_bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                            F.lit(0), lambda total, n: total + n)
    # similar sets differ in at most (1 - s) / (1 + s) of the sum of their sizes
    room = (F.col("_n1") + F.col("_n2")).cast("long") * (SIMILAR_DEN - SIMILAR_NUM)
    return pairs.join(left, "a").join(right, "b").where(
        differing.cast("long") * (SIMILAR_DEN + SIMILAR_NUM) <= room).select("a", "b")


def sets_of(docs: DataFrame, rows: DataFrame, pairs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(_print, _set) of the sets in ``pairs``, cut from one text each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_print")).distinct()
    one = durable(rows.join(wanted, "_print", "left_semi").groupBy("_print").agg(
        F.min(F.struct("_id", "_sum")).alias("_doc")).select(F.col("_doc._id").alias("_id"), F.col("_doc._sum").alias("_sum")))
    texts = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(whole_text(text)).alias("_sum"), F.col(text).alias("_text"))
    chosen = maybe_broadcast(one, one.count(), 64)
    same = texts["_id"].eqNullSafe(chosen["_id"]) & (texts["_sum"] == chosen["_sum"])
    return with_sets(texts.join(chosen, same, "left_semi").select("_text"), width).dropDuplicates(["_print"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("_print").alias("a"), F.col("_set").alias("_left"))
    right = sets.select(F.col("_print").alias("b"), F.col("_set").alias("_right"))
    both = F.size(F.array_intersect("_left", "_right")).cast("long")
    every = F.size("_left") + F.size("_right") - both
    return pairs.join(left, "a").join(right, "b").where(both * SIMILAR_DEN >= every * SIMILAR_NUM).select("a", "b")


def met(rows: pa.Table, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of whole buckets, as ``meet`` takes them; with ``nearest`` at most one for each set."""
    key, low, high, own, node, n, at, root = (rows.column(c).to_numpy() for c in range(8))
    fold = rows.column(8).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), FOLD)
    n, room = n.astype(np.int64), n.astype(np.int64) - at
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    ends, i = np.repeat(starts + sizes, sizes), np.arange(len(key))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    least, other = np.full(len(key), 64 * FOLD + 1), np.full(len(key), -1)

    def pairs() -> pa.RecordBatch:
        a, b = (node[np.concatenate(side)] for side in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    waiting = 0
    for distance in range(1, int(sizes.max())):
        i = i[i + distance < ends[i]]
        i = i[n[i] * SIMILAR_DEN >= n[i + distance] * SIMILAR_NUM]  # by size, so those further on are no less
        if not len(i):
            break
        j = i + distance
        both = n[i] + n[j]
        apart = (root[i] != root[j]) & ((own[i] != own[j]) == (low[i] != high[i])) & (
            np.minimum(room[i], room[j]) * (SIMILAR_NUM + SIMILAR_DEN) >= both * SIMILAR_NUM)
        x, y, both = i[apart], j[apart], both[apart]
        differing = np.bitwise_count(fold[x] ^ fold[y]).sum(axis=1, dtype=np.int64)
        near = differing * (SIMILAR_DEN + SIMILAR_NUM) <= both * (SIMILAR_DEN - SIMILAR_NUM)
        x, y, differing = x[near], y[near], differing[near]
        if nearest:
            for side, partner in ((x, y), (y, x)):
                nearer = differing < least[side]
                least[side[nearer]], other[side[nearer]] = differing[nearer], partner[nearer]
        elif len(x):
            found.append((x, y))
            waiting += len(x)
            if waiting > 1 << 16:
                yield pairs()
                found, waiting = [], 0
    if (other >= 0).any():
        found.append((np.flatnonzero(other >= 0), other[other >= 0]))
    if found:
        yield pairs()


def meet(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (_key, _low, _high, _own, _print, _n, _at, _root, _fold), sorted by bucket (the first three)
    and size, to pairs (a, b) that sizes, places and folded sketches do not settle."""
    held: pa.Table | None = None
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
            yield from met(rows.slice(0, cut), nearest)
        held = rows.slice(cut)
    if held is not None:
        yield from met(held, nearest)


def compared(placed: DataFrame, nearest: bool, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of sets that share a key, are not joined yet and that nothing at hand settles.

    With ``nearest``, of these for each set of a bucket the one whose sketch is nearest.
    """
    rows = placed.select("_key", "_print", "_n", "_at", "_root", F.array(*FOLDED).alias("_fold"))
    large = durable(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") > tile)
                    .select("_key", F.ceil(F.col("_held") / tile).cast("int").alias("_tiles")))
    tiled = rows.join(maybe_broadcast(large, large.count(), 48), "_key", "left").withColumn(
        "_own", F.coalesce(F.pmod(F.xxhash64("_print"), F.col("_tiles").cast("long")).cast("int"), F.lit(0))).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.coalesce("_tiles", F.lit(1)) - 1)))
    buckets = tiled.select("_key", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"),
                           "_own", "_print", "_n", "_at", "_root", "_fold")
    return buckets.repartition("_key", "_low", "_high").sortWithinPartitions("_key", "_low", "_high", "_n").mapInArrow(
        lambda batches: meet(batches, nearest), "a long, b long").distinct()


def candidates(placed: DataFrame, star: int | None) -> DataFrame:
    """Pairs (a, b) of sets that share a key, are not joined yet and whose sizes and places allow it.

    With the number of a star, of each key one set with all others; with NEAREST, each with the nearest.
    """
    if star is None or star == NEAREST:
        return compared(placed, star == NEAREST)
    names = ("_print", "_n", "_at", "_root", *FOLDED)
    centre = placed.groupBy("_key").agg(F.min_by(F.struct(*names), F.xxhash64("_print", F.lit(star))).alias("_c"))
    other = centre.select("_key", *[F.col(f"_c.{c}").alias(f"{c}2") for c in names])
    bound = F.least(F.col("_n") - F.col("_at"), F.col("_n2") - F.col("_at2")).cast("long") \
        * (SIMILAR_NUM + SIMILAR_DEN) >= (F.col("_n") + F.col("_n2")).cast("long") * SIMILAR_NUM
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in FOLDED), F.lit(0)).cast("long")
    bound &= differing * (SIMILAR_DEN + SIMILAR_NUM) <= (F.col("_n") + F.col("_n2")).cast("long") * (
        SIMILAR_DEN - SIMILAR_NUM)
    return placed.join(other, "_key").where((F.col("_root") != F.col("_root2")) & bound).select(
        F.least("_print", "_print2").alias("a"), F.greatest("_print", "_print2").alias("b")).distinct()


def links(docs: DataFrame, rows: DataFrame, proposed: DataFrame, text: str, doc_id: str, width: int,
          stars: int = STARS) -> DataFrame:
    """Links (a, b) between nodes that connect all similar ones; ``rows`` are those of with_keys.

    ``proposed`` are pairs (a, b) to look at first; those that are not similar are dropped.
    """
    spark = docs.sparkSession
    keyed = rows.select("_print", "_n", F.posexplode("_keys").alias("_at", "_key")).select("_key", "_print", "_n", "_at")
    held = keyed.repartition("_key").sortWithinPartitions("_key", "_print").mapInArrow(
        several_holders, "_key long, _print long, _n int, _at int")
    sketches = durable(rows.select("_print", "_n", "_bits").dropDuplicates(["_print"]))
    with job_scratch(spark):
        shared = durable(needed_keys(durable(held)).join(sketches.select("_print", *folded("_bits")), "_print"), outlive=1)
    found = new = None
    placed = shared.withColumn("_root", F.col("_print"))
    for step in range(-1, stars + 2):
        star = step if step < stars else NEAREST if step == stars else None
        with job_scratch(spark):
            if new is not None and not new.isEmpty():
                roots = durable(components(found))
                placed = shared.join(roots.select(F.col("node").alias("_print"), F.col("root").alias("_root")),
                                     "_print", "left").withColumn("_root", F.coalesce("_root", "_print"))
                mixed = placed.groupBy("_key").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")) \
                    .where("_low <> _high").select("_key")
                placed = durable(placed.join(mixed, "_key", "left_semi"), outlive=1)
                if placed.isEmpty():
                    break
            pairs = durable(proposed if step < 0 else candidates(placed, star))
            if step == stars and pairs.isEmpty():
                break
            left = durable(settled_by_sketch(pairs, sketches))
            sets = durable(sets_of(docs, rows, left, text, doc_id, width))
            new = durable(similar(left, sets), outlive=1)
        found = new if found is None else found.unionByName(new)
    return found
