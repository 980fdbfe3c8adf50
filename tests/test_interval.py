import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from agentmetrics.operators import interval
from agentmetrics.operators.interval import stabs
from agentmetrics.plans import trace
from tests.conftest import rows

T0 = datetime(1969, 12, 30)
POINT, SPAN = "repo string, n int, at timestamp", "repo string, id int, a timestamp, z timestamp"


def test_every_pair_once(spark):
    """Against all pairs: long, short, empty and turned spans, times before 1970, nulls, repeats."""
    draw = random.Random(7)
    some = lambda: T0 + timedelta(seconds=draw.choice([draw.randrange(400_000), draw.randrange(50)]))
    repo = lambda: draw.choice(["hot", "hot", "hot", "b", None])
    points = [(repo(), n // 2, None if n % 17 == 0 else some()) for n in range(300)]
    spans = []
    for n in range(120):
        a = some()
        length = timedelta(microseconds=draw.choice([0, 1, 5, 10**6, 3 * 10**10, -4]))
        spans.append((repo(), n, None if n % 19 == 0 else a, None if n % 23 == 0 else a + length))
    spans += [("hot", 500, points[1][2], points[1][2])] + spans[:3]
    want = sorted((p[1], s[1]) for p in points for s in spans
                  if p[0] and p[0] == s[0] and p[2] and s[2] and s[3] and s[2] <= p[2] <= s[3])
    p, s = spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN)
    for limit in (1_000_000, 3):
        got = stabs(p, s, ["repo"], "at", "a", "z", ["id"], limit)
        assert got.columns == ["repo", "n", "at", "id"]
        assert sorted((r["n"], r["id"]) for r in rows(got)) == want


def test_keys_with_few_spans_are_listed_once(spark, monkeypatch):
    """The same pairs whether keys go by cells or not; without busy keys no row of either side is repeated."""
    draw = random.Random(3)
    some = lambda: T0 + timedelta(seconds=draw.randrange(9_000))
    points = [(draw.choice("abc"), n, some()) for n in range(200)]
    spans = [(draw.choice("aab"), n, a, a + timedelta(seconds=4 ** (n % 7))) for n in range(90) for a in [some()]]
    p, s = spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN)
    want = sorted((x[1], y[1]) for x in points for y in spans if x[0] == y[0] and y[2] <= x[2] <= y[3])
    for limit, at_once in ((1_000_000, 40), (1_000_000, 0), (3, 0)):
        got = stabs(p, s, ["repo"], "at", "a", "z", ["id"], limit, at_once)
        assert sorted((r["n"], r["id"]) for r in rows(got)) == want
    monkeypatch.setattr(interval, "by_cells", None)  # never called where keys are small
    got = stabs(p, s, ["repo"], "at", "a", "z", ["id"])
    assert sorted((r["n"], r["id"]) for r in rows(got)) == want


def test_no_spans_and_no_points(spark):
    p, s = spark.createDataFrame([("r", 1, T0)], POINT), spark.createDataFrame([("r", 1, T0, T0)], SPAN)
    assert rows(stabs(p, s.limit(0), ["repo"], "at", "a", "z", ["id"])) == []
    assert rows(stabs(p.limit(0), s, ["repo"], "at", "a", "z", ["id"])) == []


def at(day):
    return datetime(2026, 5, 1) + timedelta(days=day)


def worked(spark):
    sessions = spark.createDataFrame([
        ("s1", "r", "feature/PROJ-1", at(0), at(2)), ("s2", "r", "main", at(0), at(2)),
        ("s3", "r", None, at(5), None), ("s4", "q", "feature/PROJ-1", at(0), at(9))],
        "session_id string, repo string, branch string, started_at timestamp, ended_at timestamp")
    commits = spark.createDataFrame([
        ("r", "c1", "feature/PROJ-1", at(1), None, "Close OPS-7 and OPS-7"),
        ("r", "c2", "feature/PROJ-1", at(12), None, None),
        ("r", "c3", "feature/PROJ-1", at(17), "s4", "Use UTF-8"), ("r", "c4", "main", at(1), "gone", ""),
        ("r", "c5", None, at(5), None, None), ("r", "c6", None, None, None, None)],
        "repo string, sha string, branch string, at timestamp, session_id string, body string")
    return sessions, commits


def test_links_are_found(spark):
    sessions, commits = worked(spark)
    edges = trace.strongest_edges(trace.commit_links(sessions, commits))
    assert {(r["from_id"], r["to_id"], r["method"]) for r in rows(edges)} == {
        ("s1", "c1", "branch_name_match"), ("s1", "c2", "branch_name_match"), ("s1", "c4", "timestamp_correlation"),
        ("s2", "c1", "timestamp_correlation"), ("s2", "c4", "timestamp_correlation"),
        ("s3", "c5", "timestamp_correlation"), ("s4", "c3", "vendor_tracking")}


def test_tickets_are_found(spark):
    _, commits = worked(spark)
    links = trace.ticket_links(commits, "commit", "sha", "body", "branch", ["OPS", "PROJ"])
    assert sorted((r["from_id"], r["to_id"], r["method"]) for r in rows(links)) == [
        ("c1", "OPS-7", "explicit_id_reference"), ("c1", "PROJ-1", "branch_name_match"),
        ("c2", "PROJ-1", "branch_name_match"), ("c3", "PROJ-1", "branch_name_match")]
    every = trace.ticket_links(commits, "commit", "sha", "body", "branch")
    assert "UTF-8" in {r["to_id"] for r in rows(every)}


def test_outcomes_stand_beside_savings(spark):
    sessions, commits = worked(spark)
    edges = trace.without_speculative(trace.strongest_edges(trace.commit_links(sessions, commits)))
    measures = spark.createDataFrame([("c1", 10, 5, None), ("c2", 30, None, 3), ("c5", 9, 9, 9)],
                                     "sha string, lines_original int, lines_kept int, lines_reworked int")
    savings = sessions.select("session_id", F.lit(2.5).alias("saving"))
    got = {r["session_id"]: r for r in rows(trace.savings_with_outcomes(savings, edges, measures))}
    assert len(got) == 4
    assert got["s1"] == {"session_id": "s1", "saving": 2.5, "survival_n": 1, "survival_rate": 0.5,
                         "rework_n": 1, "rework_rate": 0.1}
    assert got["s3"]["survival_n"] == 0 and got["s3"]["survival_rate"] is None
