"""Centroid clustering over vector-approximation files.

Vectors are whole numbers. A component is approximated by the number of its cell,
BITS bits of it; half of the cells are of one width from the least to the greatest value
of all vectors, the others are cut where the components of a bounded sample lie. For each centroid
a lookup table gives, per dimension and cell, the least and the greatest squared
difference, so that a scan of the cells alone bounds the distance to every centroid from
both sides. A vector whose bounds name one nearest centroid is settled; full vectors
are read for the others only.

Rounds. The first scan makes the cells, has the vectors at hand anyway and sums them by
centroid. Later rounds scan cells (a byte a component, with the centroid so far) and
keep sums by differences: full vectors are fetched by row number for rows that are
unsettled or have moved, the wanted rows being broadcast while they fit the limit of
``common.maybe_broadcast`` and joined by a shuffle beyond it. The last scan reads cells and
vectors together, as every distance is wanted exactly. What reaches the driver are sums
per task and centroid already added up: centroids times dimensions numbers a round.

Defined cases: vectors of another width, null ones and those with a null or non-finite
component take no part, nor do those with a component of 2**BOUND_BITS or more in size
after scaling, whose squared distances need not fit a long; with fewer vectors than
centroids there are as many centroids as vectors; a null id hashes as an empty one;
repeated rows are vectors of their own, and of those with equal ids the lesser components
come first; equal distances go to the smaller number; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import maybe_broadcast

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
BITS = 7
BOUND_BITS = 27
#: Vectors whose components decide where cells are cut; they decide the cost, never the result.
SAMPLE_ROWS = 20_000
#: Vectors that a task compares with all centroids at a time.
AT_ONCE = 4096
#: Reckoned bytes of a wanted row in a broadcast: number, cells and the overhead of the table.
ROW_BYTES = 256

SUMS = "_cluster int, _n long, _sum array<long>"


def whole_vectors(vectors: DataFrame, vector: str, row_id: str, width: int, scale: int) -> DataFrame:
    """(_row, _id, _v): the vectors that take part, as whole numbers, written down."""
    x = F.col(vector)
    bound = float(1 << BOUND_BITS) / scale
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(bound)))
    return durable(vectors.where((F.size(x) == width) & fit).select(
        F.monotonically_increasing_id().alias("_row"), F.col(row_id).alias("_id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("int")).alias("_v")))


def first_centroids(rows: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    chosen = rows.select(F.sha2(name, 256).alias("_hash"), "_v").orderBy("_hash", "_v").limit(count).collect()
    return np.array([r["_v"] for r in chosen], np.int64)


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A list column whose lists are of one length, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1)


def extremes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each component."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch.column(0), np.int64)
                low = values.min(axis=0) if low is None else np.minimum(low, values.min(axis=0))
                high = values.max(axis=0) if high is None else np.maximum(high, values.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)],
                                             ["_at", "_low", "_high"])

    found = rows.select("_v").mapInArrow(find, "_at long, _low long, _high long").groupBy("_at").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high")).orderBy("_at").collect()
    return np.array([r["_low"] for r in found]), np.array([r["_high"] for r in found])


class Cells:
    """Where the cells of each dimension begin, and the least and greatest value each can hold."""

    def __init__(self, low: np.ndarray, high: np.ndarray, sample: np.ndarray, bits: int):
        half = 1 << bits - 1
        shares = np.linspace(0, 1, half + 1)[1:-1]
        widths = np.maximum(1, -(-(high - low + 1) // half))
        self.starts = [np.unique(np.append(np.arange(a + w, b + 1, w), np.quantile(column, shares, method="lower")))
                       for a, b, w, column in zip(low, high, widths, sample.T)]
        most = 1 + max(map(len, self.starts))
        self.least = np.zeros((len(low), most), np.int64)
        self.greatest = np.zeros((len(low), most), np.int64)
        for d, starts in enumerate(self.starts):
            n = len(starts) + 1
            self.least[d, :n] = np.maximum(np.append(low[d], starts), low[d])
            self.greatest[d, :n] = np.minimum(np.append(starts - 1, high[d]), high[d])

    def of(self, values: np.ndarray) -> np.ndarray:
        """The cell of each component, as a byte."""
        return np.stack([np.searchsorted(starts, values[:, d], side="right")
                         for d, starts in enumerate(self.starts)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared difference by dimension, cell and centroid."""
        below = self.least[:, :, None] - centroids.T[:, None, :]
        above = self.greatest[:, :, None] - centroids.T[:, None, :]
        far = np.maximum(below * below, above * above)
        near = np.where((below <= 0) & (above >= 0), 0, np.minimum(below * below, above * above))
        return near, far


def bounds(codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the distance of each vector to each centroid."""
    near, far = tables
    low = np.zeros((len(codes), near.shape[2]), np.int64)
    high = np.zeros_like(low)
    for d in range(codes.shape[1]):
        low += near[d, codes[:, d]]
        high += far[d, codes[:, d]]
    return low, high


def settled(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest centroid where the bounds leave one only, else -1; equal distances go to the smaller number."""
    best = high.argmin(axis=1)
    reach = high[np.arange(len(high)), best][:, None]
    numbers = np.arange(low.shape[1])
    rival = (low < reach) | ((low == reach) & (numbers < best[:, None]))
    rival[np.arange(len(high)), best] = False
    return np.where(rival.any(axis=1), -1, best)


def exact_nearest(values: np.ndarray, centroids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest centroid by full vectors, compared with the centroids that the bounds leave."""
    left = low <= high.min(axis=1)[:, None]
    best = np.full(len(values), -1)
    least = np.full(len(values), np.iinfo(np.int64).max)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero(left[:, number])
        distance = ((values[rows] - centroid) ** 2).sum(axis=1)
        nearer = distance < least[rows]
        least[rows[nearer]], best[rows[nearer]] = distance[nearer], number
    return best


def assigned(values: np.ndarray, codes: np.ndarray, centroids: np.ndarray,
             tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The nearest centroid of vectors at hand; full components are used for unsettled ones alone."""
    low, high = bounds(codes, tables)
    nearest = settled(low, high)
    unsure = np.flatnonzero(nearest < 0)
    if len(unsure):
        nearest[unsure] = exact_nearest(values[unsure], centroids, low[unsure], high[unsure])
    return nearest


class Sums:
    """Vectors added up by centroid, as rows of SUMS beside rows of another kind."""

    def __init__(self, count: int, width: int):
        self.n = np.zeros(count, np.int64)
        self.total = np.zeros((count, width), np.int64)

    def add(self, clusters: np.ndarray, values: np.ndarray, sign: int = 1) -> None:
        for c in np.unique(clusters[clusters >= 0]):
            rows = clusters == c
            self.n[c] += sign * int(rows.sum())
            self.total[c] += sign * values[rows].sum(axis=0)

    def columns(self) -> list[pa.Array]:
        return [pa.array(np.arange(len(self.n)), pa.int32()), pa.array(self.n),
                pa.array(list(self.total), pa.list_(pa.int64()))]


def collected(parts: DataFrame, count: int, width: int) -> tuple[list[int], list[list[int]]]:
    """Rows of SUMS added up, in whole numbers of any size."""
    n, total = [0] * count, [[0] * width for _ in range(count)]
    wide = parts.select("_cluster", "_n", F.posexplode("_sum").alias("_at", "_value")).groupBy("_cluster", "_at").agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_value").cast("decimal(38,0)")).alias("_value"))
    for row in wide.collect():  # one a centroid and dimension
        n[row["_cluster"]] = row["_n"]
        total[row["_cluster"]][row["_at"]] = int(row["_value"])
    return n, total


def moved(centroids: np.ndarray, n: list[int], total: list[list[int]]) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean."""
    return np.array([[x // count for x in sums] if count else old
                     for old, count, sums in zip(centroids.tolist(), n, total)], np.int64)


def empty_columns(rows: int, kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.nulls(rows, kind) for kind in kinds]


STATE_KINDS = [pa.int64(), pa.binary(), pa.int32()]
SUM_KINDS = [pa.int32(), pa.int64(), pa.list_(pa.int64())]
STATE = ["_row", "_codes", "_nearest"]
STATE_DDL = "_row long, _codes binary, _nearest int"


def batches_of(state: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*state, *empty_columns(len(state[0]), SUM_KINDS)],
                                      [*STATE, "_cluster", "_n", "_sum"])


def sums_batch(sums: Sums) -> pa.RecordBatch:
    columns = sums.columns()
    return pa.RecordBatch.from_arrays([*empty_columns(len(columns[0]), STATE_KINDS), *columns],
                                      [*STATE, "_cluster", "_n", "_sum"])


def blobs(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


def codes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


class Clustering:
    """The rounds of one run; ``file`` holds the vectors, ``cells`` where they are cut."""

    def __init__(self, spark: SparkSession, file: DataFrame, centroids: np.ndarray, cells: Cells):
        self.spark, self.file, self.centroids, self.cells = spark, file, centroids, cells
        self.width = centroids.shape[1]
        self.n, self.total = [0] * len(centroids), [[0] * self.width for _ in centroids]
        self.unsettled = 0

    def shared(self):
        """Centroids, cells and lookup tables for the tasks: bounded by centroids, dimensions and cells."""
        return self.spark.sparkContext.broadcast((self.centroids, self.cells, self.cells.tables(self.centroids)))

    def take_sums(self, out: DataFrame) -> None:
        n, total = collected(out.where("_cluster IS NOT NULL").select("_cluster", "_n", "_sum"),
                             len(self.centroids), self.width)
        self.n = [a + b for a, b in zip(self.n, n)]
        self.total = [[a + b for a, b in zip(x, y)] for x, y in zip(self.total, total)]
        self.centroids = moved(self.centroids, self.n, self.total)

    def first_round(self) -> DataFrame:
        """Makes the cells, assigns and adds up in one scan of the vectors: (_row, _codes, _nearest)."""
        shared, width = self.shared(), self.width

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, cells, tables = shared.value
            sums = Sums(len(centroids), width)
            for batch in slices(batches):
                values = matrix(batch.column(1), np.int64)
                codes = cells.of(values)
                nearest = assigned(values, codes, centroids, tables)
                sums.add(nearest, values)
                yield batches_of([batch.column(0), blobs(codes), pa.array(nearest, pa.int32())])
            yield sums_batch(sums)

        out = durable(self.file.select("_row", "_v").mapInArrow(scan, f"{STATE_DDL}, {SUMS}"))
        self.take_sums(out)
        return out.where("_cluster IS NULL").select(*STATE)

    def next_round(self, state: DataFrame) -> DataFrame:
        """Scans cells alone, then fetches the vectors that are unsettled or have moved."""
        shared, width = self.shared(), self.width

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shared.value[2]
            for batch in slices(batches):
                nearest = settled(*bounds(codes_of(batch.column(1), width), tables))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], [*STATE, "_new"])

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, _, tables = shared.value
            sums = Sums(len(centroids), width)
            for batch in slices(batches):
                values, codes = matrix(batch.column(4), np.int64), codes_of(batch.column(1), width)
                nearest = batch.column(3).to_numpy().copy()
                unsure = np.flatnonzero(nearest < 0)
                if len(unsure):
                    nearest[unsure] = exact_nearest(values[unsure], centroids, *bounds(codes[unsure], tables))
                before = batch.column(2).to_numpy()
                changed = nearest != before
                sums.add(before[changed], values[changed], -1)
                sums.add(nearest[changed], values[changed])
                yield batches_of([batch.column(0), batch.column(1), pa.array(nearest, pa.int32())])
            yield sums_batch(sums)

        scanned = durable(state.mapInArrow(scan, f"{STATE_DDL}, _new int"))
        wanted = scanned.where("_new <> _nearest")
        fetched_rows = wanted.count()
        self.unsettled += fetched_rows
        fetched = maybe_broadcast(wanted, fetched_rows, ROW_BYTES).join(self.file.select("_row", "_v"), "_row")
        out = durable(fetched.select(*STATE, "_new", "_v").mapInArrow(settle, f"{STATE_DDL}, {SUMS}"))
        self.take_sums(out)
        kept = scanned.where("_new = _nearest").select(*STATE)
        return kept.unionByName(out.where("_cluster IS NULL").select(*STATE))

    def last_scan(self) -> DataFrame:
        """(_id, _nearest, _distance) of every vector, by the final centroids."""
        shared = self.shared()
        kind = self.file.schema["_id"].dataType.simpleString()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, cells, tables = shared.value
            for batch in slices(batches):
                values = matrix(batch.column(1), np.int64)
                nearest = assigned(values, cells.of(values), centroids, tables)
                distance = ((values - centroids[nearest]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())],
                    ["_id", "_nearest", "_distance"])

        return durable(self.file.select("_id", "_v").mapInArrow(scan, f"_id {kind}, _nearest int, _distance long"))


def cluster(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", count: int = CENTROIDS,
            rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    file = whole_vectors(vectors, vector, row_id, width, scale)
    centroids = first_centroids(file, count, seed)
    kind = file.schema["_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    sample = file.orderBy(F.xxhash64("_row")).limit(SAMPLE_ROWS).select("_v").toArrow()
    cells = Cells(*extremes(file), matrix(sample.column(0).combine_chunks(), np.int64), bits)
    run = Clustering(spark, file, centroids, cells)
    state = run.first_round() if rounds else None
    for _ in range(1, rounds):
        state = run.next_round(state)
    placed = run.last_scan()
    by_cluster = placed.groupBy("_nearest").agg(F.sum("_distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in by_cluster)
    names = spark.createDataFrame(  # a row a centroid
        [(r["_nearest"], r["cluster_inertia"], inertia, ",".join(map(str, run.centroids[r["_nearest"]].tolist())))
         for r in by_cluster], "_nearest int, cluster_inertia long, inertia long, _centroid string")
    return placed.join(F.broadcast(names), "_nearest").select(
        F.col("_id").alias("vec_id"), F.col("_nearest").alias("cluster"), F.col("_distance").alias("distance"),
        "cluster_inertia", "inertia", F.sha2("_centroid", 256).alias("centroid_sha256"))


def cluster_sql(count: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE,
                seed: int = SEED) -> str:
    """The same in SQL, each round its own tables."""
    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {width}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {count}))"""]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (
  SELECT r, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM v, c{n}),
a{n} AS MATERIALIZED (
  SELECT r, c, distance FROM d{n}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)""")
        if n < rounds:
            steps.append(f"""s{n} AS (
  SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, unnest(range({width})) AS i FROM a{n} JOIN v USING (r)) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT c0.c, coalesce(g.m, old.m) AS m FROM c0 JOIN c{n} old USING (c)
  LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{n} GROUP BY c) g USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""
