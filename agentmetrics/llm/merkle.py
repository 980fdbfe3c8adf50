"""Merkle manifest of a dataset, with every row's inclusion proof from shared multiproofs.

Each row is a leaf. The leaves of a source, by ascending id, are the bottom of a tree
whose nodes are hashes of up to FAN children; the tops of all sources, in order, are
the bottom of one more tree, whose top is the root of the dataset.

Positions. Narrow rows (source, id, two digests) are range partitioned by source and
id, so a hot source is cut like any other range; what earlier partitions hold of a
source is added from a table of one row per partition and source.

Trees are built in tiers. FAN ** TIER consecutive nodes of a tree form a block, one
row with the list of their digests; a task derives all nodes above them up to the
block's top, and tops are the next tier's nodes. A tier is 1 / FAN ** TIER of the one below.

Proofs (octopus multiproof). A block of leaves can derive all nodes over its own
leaves, and for all proofs together it lacks only the siblings on the way from its top
to the root. Their coordinates follow from the block's number and the widths of the
levels. They are fetched once per block, by one join on coordinates in which nodes that
many blocks want are broadcast (at most 1 / HEAVY_SHARE of them), and the block expands the
proofs of its leaves from its own nodes and these, and folds each leaf back to the root.

Tampering is a parameter: a column with the text that a leaf is to be checked
with. By default line breaks are taken out of the texts of every other id.

Defined cases: null columns enter a leaf as `-`; a null id comes first in its source and
is not tampered with, null sources form one source that comes first; of equal ids the
lesser leaf comes first, and repeated rows are leaves of their own; a source of one row
is its own top; a table of one row has that leaf as its root and the hash of nothing as
its proof; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import join_groups, maybe_broadcast

FAN = 3
#: Levels that one block of nodes spans: FAN ** TIER nodes are one row.
TIER = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources; sources themselves begin with `-` (null) or `:`.
TOP = "*"
#: Rows of a range, where positions are given, and reckoned bytes of a broadcast row.
RANGE_ROWS = 500_000
ROW_BYTES = 200
#: Of a block's source, subroot and answers, some 60 nodes of up to 200 bytes.
ANSWER_BYTES = 12_000


def field(value: Column) -> Column:
    """How a value enters a leaf: its length in UTF-8 bytes, a colon and itself; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def without_line_breaks(text: Column, doc_id: Column) -> Column:
    """The text as the manifest is checked with it: of ids whose crc32 is even, line breaks are gone."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(_tree, _id, _leaf, _seen): tree of the source, id, digest, and digest of the text to check with."""
    columns = [F.col(f"`{c}`") for c in COLUMNS]
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-"))
    return docs.select(tree.alias("_tree"), F.col("doc_id").alias("_id"), F.unhex(leaf_hash(columns)).alias("_leaf"),
                       F.unhex(leaf_hash([*columns[:-1], tampered])).alias("_seen"))


def with_positions(rows: DataFrame, key: str, order: list[str], parts: int = 1) -> DataFrame:
    """Adds ``_pos``, the place of a row among those of its key, and ``_n``, their number; written down.

    ``order`` must part all rows of a key, so that no range has to hold equal ones.
    """
    ranged = durable(rows.repartitionByRange(max(parts, -(-rows.count() // RANGE_ROWS), 1), key, *order)
                     .sortWithinPartitions(key, *order).withColumn("_line", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_line", 33)
    held = ranged.groupBy(F.col(key).alias("_held"), part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_line").alias("_first"))
    earlier = Window.partitionBy("_held").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = durable(held.select("_held", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                               F.sum("_rows").over(Window.partitionBy("_held")).alias("_n")))
    # one row for each range and key in it
    same = (F.col(key) == F.col("_held")) & (part == F.col("_part"))
    return ranged.join(maybe_broadcast(held, held.count(), ROW_BYTES), same) \
        .withColumn("_pos", F.col("_line") - F.col("_first") + F.col("_before")) \
        .drop("_held", "_part", "_first", "_before", "_line")


def digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels_above(bottom: list[str], height: int) -> list[list[str]]:
    """The nodes of a block by level, its bottom first, ``height`` levels above it."""
    levels = [bottom]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def height_of(nodes: int) -> int:
    """Levels above so many nodes."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // FAN), height + 1
    return height


def missing(place: int, level: int, nodes: int) -> list[tuple[int, list[int], list[int]]]:
    """What a node lacks for proofs up to the top of its tree: per level the places left and right of it.

    ``nodes`` is the width of the node's level. All leaves below the node share these siblings.
    """
    wanted = []
    while nodes > 1:
        first = place // FAN * FAN
        wanted.append((level, list(range(first, place)), list(range(place + 1, min(first + FAN, nodes)))))
        place, level, nodes = place // FAN, level + 1, -(-nodes // FAN)
    return wanted


def as_blocks(nodes: DataFrame, columns: list[str], tier: int) -> DataFrame:
    """(_tree, _n, _block, _items): rows of FAN ** tier consecutive nodes, in order; a list is bounded by that."""
    items = F.array_sort(F.collect_list(F.struct("_pos", *columns)))
    block = F.floor(F.col("_pos") / F.lit(FAN ** tier)).cast("long")
    return durable(nodes.groupBy("_tree", "_n", block.alias("_block")).agg(items.alias("_items"))
                   .withColumn("_owner", F.monotonically_increasing_id()))


def tops(blocks: DataFrame, name: str, tier: int, level: int, every: bool) -> DataFrame:
    """(_tree, _n, _level, _pos, _digest) of each block's top, or of every node over its bottom."""
    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for at, (tree, n, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                bottom = [d.hex() for d in batch.column(3)[at].values.field(name).to_pylist()]
                height = min(tier, height_of(n))
                for up, nodes in enumerate(levels_above(bottom, height)):
                    if (every and up) or up == height:
                        first = block * FAN ** (tier - up)
                        for i, found in enumerate(nodes):
                            for column, value in zip(out, (tree, -(-n // FAN ** up), level + up, first + i, bytes.fromhex(found))):
                                column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["_tree", "_n", "_level", "_pos", "_digest"])

    return durable(blocks.mapInArrow(derive, "_tree string, _n long, _level int, _pos long, _digest binary"))


def built(bottom: DataFrame, tier: int) -> DataFrame:
    """All nodes (_tree, _n, _level, _pos, _digest) from ``bottom`` (one level of each tree) up to the tops."""
    every = bottom
    current = bottom.where("_n > 1")
    while not current.isEmpty():
        level = current.agg(F.max("_level")).first()[0]
        above = tops(as_blocks(current, ["_digest"], tier), "_digest", tier, level, True)
        every = every.unionByName(above)
        current = above.where((F.col("_level") == level + tier) & (F.col("_n") > 1))
    return every


def name_of(tree: str, level: int, place: int) -> str:
    return f"{level}|{place}|{tree}"


def lacking(tree: str, n: int, block: int, source: int, sources: int, tier: int) -> list[tuple[str, int, list[int], list[int]]]:
    """Per level from a block's top to the root: tree, level, and the places left and right of the way."""
    height = min(tier, height_of(n))
    own = missing(block, height, -(-n // FAN ** height))
    return [(tree, *step) for step in own] + [(TOP, *step) for step in missing(source, 0, sources)]


def fetched(blocks: DataFrame, nodes: DataFrame, tier: int) -> DataFrame:
    """(_owner, _names, _digests): what each block lacks, fetched once, by coordinates."""
    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, names = [], []
            for owner, *block in zip(*(c.to_pylist() for c in batch.columns)):
                for tree, level, left, right in lacking(*block, tier):
                    names.extend(name_of(tree, level, place) for place in [*left, *right])
                    owners.extend([owner] * (len(left) + len(right)))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(names, pa.string())],
                                             ["_owner", "_name"])

    wanted = durable(blocks.select("_owner", "_tree", "_n", "_block", "_source", "_sources").mapInArrow(
        want, "_owner long, _name string"))
    named = nodes.select(F.concat_ws("|", "_level", "_pos", "_tree").alias("_name"), "_digest")
    asked = wanted.groupBy("_name").agg(F.count(F.lit(1)).alias("_asked"))
    answers = join_groups(wanted, durable(named.join(asked, "_name")), "_name", "_asked", wanted.count())
    # at most FAN - 1 nodes a level
    return answers.groupBy("_owner").agg(F.collect_list(F.struct("_name", "_digest")).alias("_answers"))


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The top that a digest leads to; each step is what stands left and right of it among its siblings."""
    for left, right in path:
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def around(nodes: list[str], place: int) -> tuple[str, str]:
    """What stands left and right of a node among its siblings."""
    first = place // FAN * FAN
    return "".join(nodes[first:place]), "".join(nodes[place + 1:first + FAN])


def expanded(bottom: list[str], height: int, above: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """The proof of each leaf of a block: its own siblings, then the block's."""
    levels = levels_above(bottom, height)
    shared = {len(levels) - 1: {0: above}}  # of each node, the steps above it
    for level in range(len(levels) - 2, -1, -1):
        up = shared[level + 1]
        shared[level] = {i: [around(levels[level], i), *up[i // FAN]] for i in range(len(levels[level]))}
    for i in range(len(bottom)):
        yield shared[0][i]


def proofs(blocks: DataFrame, id_kind: str, root: str, tier: int) -> DataFrame:
    """A row per leaf from blocks with their _source, _sources, _subroot and _answers."""
    columns = ["_tree", "_n", "_block", "_source", "_sources", "_subroot", "_items", "_answers"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                *block, subroot = (batch.column(c)[at].as_py() for c in range(6))
                items = batch.column(6)[at].values
                bottom, seen = ([d.hex() for d in items.field(c).to_pylist()] for c in ("_leaf", "_seen"))
                known = {a["_name"]: a["_digest"].hex() for a in batch.column(7)[at].as_py() or []}
                above = [tuple("".join(known[name_of(tree, level, place)] for place in side) for side in sides)
                         for tree, level, *sides in lacking(*block, tier)]
                hashes, folded = [], []
                for place, path in enumerate(expanded(bottom, min(tier, height_of(block[1])), above)):
                    hashes.append(digest([side for step in path for side in step]))
                    folded.append(fold(seen[place], path))
                n = len(bottom)
                yield pa.RecordBatch.from_arrays(
                    [items.field("_id"), pa.array(bottom), pa.array([subroot.hex()] * n), pa.array([root] * n),
                     pa.array(hashes), pa.array(folded), pa.array([f == root for f in folded])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.select(*columns).mapInArrow(
        expand, f"doc_id {id_kind}, leaf string, subroot string, root string, proof_sha256 string, "
                "folded_root string, verified boolean")


def manifest(docs: DataFrame, tamper: Callable[[Column, Column], Column] = without_line_breaks,
             tier: int = TIER) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    spark = docs.sparkSession
    rows = durable(leaves(docs, tamper(F.col("text"), F.col("doc_id"))).withColumn("_any", F.monotonically_increasing_id()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = as_blocks(with_positions(rows, "_tree", ["_id", "_leaf", "_any"], parts), ["_id", "_leaf", "_seen"], tier)
    nodes = built(tops(blocks, "_leaf", tier, 0, False), tier)
    subroots = nodes.where("_n = 1").select(F.lit(TOP).alias("_top"), "_tree", F.col("_digest").alias("_subroot"))
    ranked = durable(with_positions(subroots, "_top", ["_tree"]).select(
        "_tree", "_subroot", F.col("_pos").alias("_source"), F.col("_n").alias("_sources")))
    above = built(ranked.select(F.lit(TOP).alias("_tree"), F.col("_sources").alias("_n"), F.lit(0).alias("_level"),
                                F.col("_source").alias("_pos"), F.col("_subroot").alias("_digest")), tier)
    root = above.where("_n = 1").first()
    names = blocks.select("_owner", "_tree", "_n", "_block")
    sizes = blocks.groupBy("_tree").agg(F.count(F.lit(1)).alias("_blocks"))
    placed = durable(join_groups(names, durable(ranked.join(sizes, "_tree")), "_tree", "_blocks", names.count())
                     .drop("_blocks"))
    answers = fetched(placed, nodes.unionByName(above), tier)
    told = durable(placed.select("_owner", "_source", "_sources", "_subroot").join(answers, "_owner", "left"))
    whole = blocks.join(maybe_broadcast(told, told.count(), ANSWER_BYTES), "_owner")
    return proofs(whole, docs.schema["doc_id"].dataType.simpleString(), bytes(root["_digest"]).hex() if root else "", tier)


def manifest_sql(levels: int = 16) -> str:
    """The same in SQL, level by level, for trees of up to FAN ** levels nodes."""
    def leaf(text: str) -> str:
        values = [*COLUMNS[:-1], text]
        return "sha256(" + " || ".join(
            f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"

    def tree(start: str, name: str) -> list[str]:
        """Tables {name}n (nodes) and {name}p (paths) of every level."""
        steps = []
        for i in range(levels):
            nodes, paths = (f"{start}n", f"{start}p") if i == 0 else (f"{name}n{i}", f"{name}p{i}")
            side = f"OVER (PARTITION BY key, pos // {FAN} ORDER BY pos ROWS BETWEEN"
            steps.append(f"""{name}s{i} AS MATERIALIZED (
  SELECT key, pos, coalesce(string_agg(digest, '') {side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') {side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rr FROM {nodes}),
{name}n{i + 1} AS MATERIALIZED (
  SELECT key, pos // {FAN} AS pos, (n + {FAN - 1}) // {FAN} AS n,
         CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
  FROM {nodes} GROUP BY key, n, pos // {FAN}),
{name}p{i + 1} AS MATERIALIZED (
  SELECT r, key, pos // {FAN} AS pos, (n + {FAN - 1}) // {FAN} AS n,
         CASE WHEN n = 1 THEN cur ELSE sha256(l || cur || rr) END AS cur,
         CASE WHEN n = 1 THEN proof ELSE proof || l || rr END AS proof
  FROM {paths} JOIN {name}s{i} USING (key, pos))""")
        return steps

    even = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    # DuckDB has no crc32: the remainders of the table's bytes, eight steps a byte
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(CAST(doc_id AS VARCHAR))),
      lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
    return ",\n".join([f"""WITH d AS MATERIALIZED (
  SELECT *, row_number() OVER () AS r, coalesce(':' || source, '-') AS key, xor({crc}, 4294967295) AS crc FROM documents),
e AS MATERIALIZED (SELECT r, doc_id, key, {leaf('text')} AS leaf, {leaf(even)} AS seen FROM d),
f AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
         count(*) OVER (PARTITION BY key) AS n FROM e),
an AS (SELECT key, pos, n, leaf AS digest FROM f),
ap AS (SELECT r, key, pos, n, seen AS cur, '' AS proof FROM f)""", *tree("a", "a"),
        f"""bn AS MATERIALIZED (
  SELECT '' AS key, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n, digest, key AS source
  FROM an{levels}),
bp AS (SELECT r, bn.key, bn.pos, bn.n, cur, proof FROM ap{levels} p JOIN bn ON bn.source = p.key)""",
        *tree("b", "b")]) + f"""
SELECT f.doc_id, f.leaf, bn.digest AS subroot, top.digest AS root, sha256(p.proof) AS proof_sha256,
       p.cur AS folded_root, p.cur = top.digest AS verified
FROM f JOIN bp{levels} p USING (r) JOIN bn ON bn.source = f.key, bn{levels} top"""
