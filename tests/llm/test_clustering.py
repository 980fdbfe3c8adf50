import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__
from agentmetrics.llm import clustering, common


def brute_force(rows, count, rounds, width=64, scale=64):
    """Every vector against every centroid, in whole numbers of any size."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    by_cluster = [sum(d for _, c, d in placed if c == n) for n in range(len(centroids))]
    return sorted((str(i), c, d, by_cluster[c], sum(by_cluster),
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in placed)


def got(frame):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in frame.collect())


def test_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(__spark_entry__.queries()["op12_clustering"](spark, folder)) == brute_force(rows, 16, 3)


ODD = [(None, [0.5] * 64), (1, None), (2, []), (3, [0.1] * 63), (4, [0.1] * 63 + [None]), (5, [0.1] * 63 + [math.nan]),
       (6, [0.1] * 63 + [math.inf]), (7, [0.25] * 64), (7, [0.25] * 64), (7, [-0.25] * 64), (-8, [1000.0] * 64),
       (9, [0.0] * 64), (10, [-1000.5] * 64)]


@pytest.mark.parametrize("count", [3, 16])
def test_odd_rows(spark, count):
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in ODD], "vec_id long, embedding array<double>, _v string, cluster int")
    assert got(clustering.cluster(frame, count=count)) == brute_force(ODD, count, 3)


def test_empty_tables(spark):
    frame = spark.createDataFrame(ODD[1:6], "vec_id long, embedding array<double>")
    for rows in (frame, frame.limit(0)):
        out = clustering.cluster(rows)
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("limit", [0, common.BROADCAST_BYTES])
def test_few_bits_wide_values_and_shuffled_fetches(spark, monkeypatch, limit):
    """Coarse cells leave most vectors open; whatever is fetched, the result is exact."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = random.Random(2)
    rows = [(i, [rng.choice((-9.0, 0.0, 7.5)) + rng.gauss(0, 2) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(5000, [2.0 ** 20] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    out = clustering.cluster(frame, count=5, rounds=4, width=8, bits=2)
    assert got(out) == brute_force(rows, 5, 4, width=8)


def test_bounds_hold_every_distance():
    rng = np.random.default_rng(1)
    values, centroids = rng.integers(-300, 300, (500, 12)), rng.integers(-300, 300, (7, 12))
    cells = clustering.Cells(values.min(axis=0), values.max(axis=0), values[:40], 3)
    low, high = clustering.bounds(cells.of(values), cells.tables(centroids))
    exact = ((values[:, None] - centroids) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    found = clustering.settled(low, high)
    assert (found[found >= 0] == exact.argmin(axis=1)[found >= 0]).all()
    assert (clustering.exact_nearest(values, centroids, low, high) == exact.argmin(axis=1)).all()


def test_most_vectors_are_settled_by_cells(spark):
    rows = clustering.whole_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "embedding", "vec_id", 64, 64)
    values = np.array([r["_v"] for r in rows.collect()])
    cells = clustering.Cells(values.min(axis=0), values.max(axis=0), values, clustering.BITS)
    centroids = clustering.first_centroids(rows, 16, 1)
    found = clustering.settled(*clustering.bounds(cells.of(values), cells.tables(centroids)))
    assert (found >= 0).mean() > 0.8
