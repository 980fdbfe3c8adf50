import random

import pytest
from pyspark.sql import types as T

from agentmetrics.operators import scan
from agentmetrics.operators.segment import (
    _summary, _through, _walk, assign_segments, gap_sessions, segments)
from tests.conftest import rows
from pyspark.sql import functions as F

GAP = 1_800_000
UNITS = ("session_id string, turn_index int, gap_ms_before long, git_branch string,"
         " interrupted boolean, started_at int, window_ended_at int")
FILES = "session_id string, turn_index int, file_ref string, top_dir_ref string"


def fold(units):
    """Straight fold over one session: the definition, row by row."""
    out, prev, files, dirs = [], None, set(), set()
    for u in units:
        uf, ud = {f for f, _ in u["files"]}, {d for _, d in u["files"]}
        if prev is None:
            label = "session_start"
        else:
            fired = []
            if (u["gap"] or 0) > GAP:
                fired.append("turn_gap")
            if u["branch"] and prev["branch"] and u["branch"] != prev["branch"]:
                fired.append("branch_change")
            if uf and files and not (uf & files) and not (ud & dirs):
                fired.append("file_set_jump")
            if prev["cut"]:
                fired.append("interrupt")
            label = fired[0] if fired else None
        if label:
            files, dirs = set(), set()
        files |= uf
        dirs |= ud
        out.append(label)
        prev = u
    return out


def unit(gap=0, branch="main", cut=False, files=()):
    return {"gap": gap, "branch": branch, "cut": cut, "files": list(files)}


def run(spark, sessions, limit=scan.ROWS_PER_BLOCK):
    units = [(s, i, u["gap"], u["branch"], u["cut"], i, i)
             for s, us in sessions.items() for i, u in enumerate(us)]
    files = [(s, i, f, d) for s, us in sessions.items()
             for i, u in enumerate(us) for f, d in u["files"]]
    assigned = assign_segments(spark.createDataFrame(units, UNITS),
                               spark.createDataFrame(files, FILES), ["session_id"], limit=limit)
    got = {}
    for r in rows(assigned, "session_id"):
        got.setdefault(r["session_id"], {})[r["turn_index"]] = r["opened_by"]
    return {s: [got[s][i] for i in sorted(got[s])] for s in got}, assigned


CASES = {
    "plain": ([unit(), unit(), unit()], ["session_start", None, None]),
    "gap": ([unit(), unit(gap=GAP + 1)], ["session_start", "turn_gap"]),
    "exact_gap": ([unit(), unit(gap=GAP)], ["session_start", None]),
    "branch": ([unit(), unit(branch="dev")], ["session_start", "branch_change"]),
    "no_branch": ([unit(branch=None), unit()], ["session_start", None]),
    "same_dir": ([unit(files=[("a1", "a")]), unit(files=[("a2", "a")])], ["session_start", None]),
    "jump": ([unit(files=[("a1", "a")]), unit(files=[("z9", "z")])],
             ["session_start", "file_set_jump"]),
    "none_then_files": ([unit(), unit(files=[("z9", "z")])], ["session_start", None]),
    "interrupt": ([unit(cut=True), unit()], ["session_start", "interrupt"]),
    "interrupt_gap": ([unit(cut=True), unit(gap=GAP + 1)], ["session_start", "turn_gap"]),
    "interrupt_jump": ([unit(cut=True, files=[("a1", "a")]), unit(files=[("z9", "z")])],
                       ["session_start", "file_set_jump"]),
    "jump_after_jump": ([unit(files=[("a1", "a")]), unit(files=[("z9", "z")]),
                         unit(files=[("a1", "a")])],
                        ["session_start", "file_set_jump", "file_set_jump"]),
}


def test_each_rule(spark):
    got, assigned = run(spark, {k: v[0] for k, v in CASES.items()})
    assert got == {k: v[1] for k, v in CASES.items()}
    plain = [r for r in rows(segments(assigned, ["session_id"])) if r["session_id"] == "plain"]
    assert [(s["start_turn"], s["end_turn"], s["segment_no"]) for s in plain] == [(0, 2, 0)]


def random_sessions(seed, n, length):
    rng = random.Random(seed)
    return {f"s{k}": [unit(gap=rng.choice([0, 0, 0, GAP + 5]) if rng.random() < .2 else 0,
                           branch=rng.choice(["main", "main", "main", None, "dev"])
                           if k % 3 == 0 else "main",
                           cut=rng.random() < .05,
                           files=[(f"f{x}", f"d{x // 3}") for x in
                                  rng.sample(range(12 if k % 2 else 40), rng.choice([0, 1, 1, 2]))])
                      for _ in range(length)] for k in range(n)}


@pytest.mark.parametrize("limit", [scan.ROWS_PER_BLOCK, 7])
def test_matches_fold(spark, limit):
    sessions = random_sessions(5, 12, 60)
    got, _ = run(spark, sessions, limit)
    assert got == {s: fold(us) for s, us in sessions.items()}


def test_block_summary_equals_walk():
    rng = random.Random(3)
    for _ in range(300):
        turns = list(range(10, 10 + rng.randint(1, 25)))
        shared = [rng.randint(-1, t - 1) for t in turns]
        lows, exits = _summary(turns, shared)
        for start in range(0, 11):
            jumps = _walk(turns, shared, start)
            assert _through(lows, exits, start) == (jumps[-1] if jumps else start)


def test_running_in_blocks(spark):
    rng = random.Random(1)
    data = [(f"k{rng.choice([0, 0, 0, 1, 2])}", i, rng.choice([None, rng.randint(0, 9)]))
            for i in range(400)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    items = {"total": scan.running_sum(F.col("v")), "seen": scan.latest(F.col("v")),
             "before": scan.latest_before(F.col("v"))}
    want = rows(scan.running(df, ["k"], ["pos"], items), "pos")
    for extra in ({"limit": 20}, {"limit": 20, "ordinal": "pos"}):
        assert rows(scan.running(df, ["k"], ["pos"], items, **extra), "pos") == want


def test_asof(spark):
    facts = spark.createDataFrame([("r", 10, "a"), ("r", 20, "b"), ("r", 20, "c"), ("q", 5, "z")],
                                  "repo string, at int, sha string")
    probes = spark.createDataFrame([("r", 9, 1), ("r", 10, 2), ("r", 20, 3), ("r", 99, 4),
                                    ("x", 50, 5)], "repo string, at int, id int")
    for limit in (scan.ROWS_PER_BLOCK, 2):
        got = {r["id"]: r["snap"] for r in rows(scan.asof(
            probes, facts, ["repo"], "at", "at", {"snap": "sha"}, tie="sha", limit=limit))}
        assert got == {1: None, 2: "a", 3: "c", 4: "c", 5: None}


def test_gap_sessions_in_blocks(spark):
    rng = random.Random(2)
    data = [(f"k{rng.choice([0, 0, 0, 1])}", i * rng.choice([1, 1, 9]), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, s long, id long").select(
        "k", F.timestamp_seconds("s").alias("at"), "id")
    want = rows(gap_sessions(df, "k", "at", "id", 5_000), "k", "first_at")
    assert rows(gap_sessions(df, "k", "at", "id", 5_000, limit=15), "k", "first_at") == want
    assert sum(r["n"] for r in want) == 200 and len(want) > 4


def test_small_blocks_are_cut_inside_few_partitions(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), "id")
    cut, blocked = scan.with_blocks(df, ["k"], ["id"], limit=10)
    assert blocked and len(cut.inputFiles()) <= 8  # not one partition a block
    of_block = cut.groupBy("k", scan.BLOCK).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    blocks = rows(of_block)
    assert sum(b["n"] for b in blocks) == 20_000 and max(b["n"] for b in blocks) <= 10
    for k in (0, 1):  # blocks ascend with the order
        mine = sorted((b for b in blocks if b["k"] == k), key=lambda b: b[scan.BLOCK])
        assert all(a["high"] < b["low"] for a, b in zip(mine, mine[1:]))
    got = scan.running(df, ["k"], ["id"], {"n": scan.running_sum(F.lit(1))}, limit=10)
    assert got.where(F.col("n") != F.floor(F.col("id") / 2) + 1).count() == 0
