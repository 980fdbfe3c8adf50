"""Exact top-k by inner product over vector-approximation files.

Each component of a vector is approximated by the number of a cell; a block of the
file keeps, beside the cell numbers, where its cells begin and how wide they are.
The cells of a row bound its score with any query from above. A data block scans
its cells for a block of queries, orders its rows by that bound, and reads exact
vectors in this order until no bound is left that reaches the kth score found; so
what a block returns for a query is exact, and so is the best of all blocks.

Equal vectors are one entry with their k + 1 smallest ids, which is all that can
be asked for. Data and query blocks hold at most BLOCK_ROWS vectors; every pair of
blocks is one row of a join on block numbers, so neither side has to fit in a task,
and what is moved falls with the size of the blocks.

Defined cases: vectors that are null, empty or hold a null or a non-finite
component take no part, neither do rows with a null id; vectors only meet those of
the same length; equal scores go to the smaller id; a query with fewer than k
candidates returns all; rows with the query's own id are never its results;
repeated rows count once; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

CELLS = 64
BLOCK_ROWS = 4096
SCALE = 256
#: Queries of a block whose bounds are in memory at a time.
QUERIES_AT_ONCE = 256
#: Rows whose exact vectors are read at a time, for all queries that still need some.
STEP = 32


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * component) per component; null if the vector takes no part."""
    number = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fit = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fit & (F.size(vector) > 0), number)


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (ids array, vector array) as blocks: width, number, ids, exact vectors, cells.

    There are about as many partitions as blocks, and rows are dealt out evenly.
    """
    rows = rows.repartition(max(1, -(-rows.count() // size)))
    columns = ["width", "block", "ids", "values", "codes", "low", "step"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(width: int, held: list) -> pa.RecordBatch:
            values = np.array([v for _, v in held], np.int64)
            parts = [np.array([i for i, _ in held], np.int64), values, *cells_of(values)]
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in parts],
                [f"{name}_{c}" for c in columns if c != "block"])

        for batch in batches:
            for ids, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = waiting.setdefault(len(vector), [])
                held.append((ids, vector))
                if len(held) == size:
                    yield block(len(vector), waiting.pop(len(vector)))
        for width, held in waiting.items():
            yield block(width, held)

    blobs = ", ".join(f"{name}_{c} binary" for c in columns if c not in ("width", "block"))
    return durable(rows.mapInArrow(pack, f"{name}_width int, {blobs}")
                   .withColumn(f"{name}_block", F.monotonically_increasing_id()))


def cells_of(values: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers, and per component the least whole number and the width of a cell."""
    low = values.min(axis=0)
    step = np.maximum(1, -(-(values.max(axis=0) - low + 1) // cells))
    return ((values - low) // step).astype(np.uint8), low, step


def search_block(ids: np.ndarray, values: np.ndarray, codes: np.ndarray, low: np.ndarray, step: np.ndarray,
                 query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """The exact k best of a block for each query: query, id, score, and exact vectors read.

    ``ids`` has a row of ids for each vector, smallest first, padded with the last.
    """
    floor = low + codes * step
    lower, upper = floor.astype(float).T, (floor + step - 1).astype(float).T
    out: tuple[list, list, list] = ([], [], [])
    read = 0
    for begin in range(0, len(queries), QUERIES_AT_ONCE):
        asked, own = queries[begin:begin + QUERIES_AT_ONCE], query_ids[begin:begin + QUERIES_AT_ONCE].tolist()
        bounds = np.maximum(asked, 0).astype(float) @ upper + np.minimum(asked, 0).astype(float) @ lower
        order = np.argsort(-bounds, axis=1, kind="stable")
        found: list[list[tuple[int, int]]] = [[] for _ in own]
        unsure = np.arange(len(own))
        for at in range(0, len(values), STEP):
            chosen = order[unsure, at:at + STEP]
            exact = np.einsum("qsd,qd->qs", values[chosen], asked[unsure])
            read += chosen.size
            still = []
            for q, rows, scores in zip(unsure.tolist(), chosen.tolist(), exact.tolist()):
                best = found[q]
                for row, score in zip(rows, scores):
                    if len(best) < k or score >= -best[-1][0]:
                        best.extend((-score, i) for i in dict.fromkeys(ids[row].tolist()) if i != own[q])
                        best.sort()
                        del best[k:]
                following = at + STEP
                if following < len(values) and (
                        len(best) < k or bounds[q, order[q, following]] >= -best[-1][0]):
                    still.append(q)
            if not still:
                break
            unsure = np.array(still)
        for q, best in zip(own, found):
            out[0].extend([q] * len(best))
            out[1].extend(i for _, i in best)
            out[2].extend(-score for score, _ in best)
    return *out, read


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", row_id: str = "vec_id",
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score; queries are the rows whose id is divisible by ``every``."""
    rows = durable(vectors.select(F.col(row_id).cast("long").alias("_id"), whole_numbers(vector).alias("_v"))
                   .where("_id IS NOT NULL AND _v IS NOT NULL").distinct())
    # a rank up to a limit is taken in each task before the shuffle, so copies do not meet in one
    smallest = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_v").orderBy("_id"))) \
        .where(F.col("_rank") <= k + 1)
    ids = F.array_sort(F.collect_list("_id"))
    entries = durable(smallest.groupBy("_v").agg(ids.alias("_ids")).select(
        F.concat("_ids", F.array_repeat(F.element_at("_ids", -1), F.lit(k + 1) - F.size("_ids"))).alias("_ids"), "_v"))
    data = packed(entries, block_rows, "d")
    queries = packed(rows.where(F.col("_id") % every == 0).select(F.array("_id").alias("_ids"), "_v"), block_rows, "q")
    # block numbers first, so that each data block meets each query block of its width
    met = data.select("d_width", "d_block").join(
        queries.select(F.col("q_width").alias("d_width"), "q_block"), "d_width").select("d_block", "q_block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                width = row["d_width"]
                values, low, step, ids, asked, asked_ids = (
                    np.frombuffer(row[c], np.int64) for c in ("d_values", "d_low", "d_step", "d_ids", "q_values", "q_ids"))
                values = values.reshape(-1, width)
                who, found, scores, _ = search_block(
                    ids.reshape(len(values), -1), values, np.frombuffer(row["d_codes"], np.uint8).reshape(-1, width),
                    low, step, asked_ids, asked.reshape(-1, width), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (who, found, scores)], ["query_id", "vec_id", "score"])

    blocks = met.join(data, "d_block").join(queries.select("q_block", "q_ids", "q_values"), "q_block")
    best = blocks.select("d_width", "d_values", "d_codes", "d_low", "d_step", "d_ids", "q_ids", "q_values") \
        .mapInArrow(search, "query_id long, vec_id long, score long")
    # each data block gives a query at most k rows
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
