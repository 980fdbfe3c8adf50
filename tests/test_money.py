import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from agentmetrics.functions import columns as C
from agentmetrics.plans import agreement, evals, pricing, spend, trace
from tests.conftest import rows

SHEET = [  # version, ordinal, key, input, output, cache_read, write 5m, write 1h
    ("v1", 0, "big-5", 10.0, 50.0, 1.0, 12.5, 20.0),
    ("v1", 1, "small-4", 1.0, 5.0, 0.1, 1.25, 2.0),
    ("v1", 2, "g-5.5", 5.0, 30.0, 0.5, None, None),
    ("v1", 3, "small", 9.0, 9.0, 9.0, 9.0, 9.0),
]
SHEET_DDL = ("pricing_version string, ordinal int, model_key string, input double, output double,"
             " cache_read double, cache_write_5m double, cache_write_1h double")
M = 1_000_000


def sheet(spark, data=SHEET):
    return spark.createDataFrame(data, SHEET_DDL)


def test_session_price(spark):
    cases = [
        ("a", ["small-4-20251001"], M, 0, 0, 0, 1.0), ("b", ["nobody"], M, 0, 0, 0, None),
        ("c", ["g-5.5"], 0, 0, 0, M, None), ("d", ["<synthetic>", "big-5"], M, 0, 0, 0, 10.0),
        ("e", ["big-5"], M, M, M, M, 81.0), ("f", ["big-5"], None, None, None, None, None),
        ("g", [], M, 0, 0, 0, None), ("h", ["small-3"], M, 0, 0, 0, 9.0),
    ]
    df = spark.createDataFrame([c[:6] for c in cases],
                               "id string, model_list array<string>, input long, output long,"
                               " cache_read long, cache_creation long")
    got = {r["id"]: r["cost"] for r in rows(pricing.with_rates(df, sheet(spark)).select(
        "id", pricing.session_price().alias("cost")))}
    assert got == {c[0]: c[6] for c in cases}


def test_usage_price(spark):
    usage = spark.createDataFrame([
        ("a", "small-4", M, M, M, None, M, M), ("b", "big-5", M, M, M, None, M, M),
        ("c", "small-4", 0, 0, 0, M, None, None), ("d", "small-4-2025", M, 0, 0, 0, None, None)],
        "id string, model_id string, input long, output long, cache_read long,"
        " cache_creation long, cache_5m long, cache_1h long")
    got = {r["id"]: r["cost"] for r in rows(pricing.usage_price(usage, sheet(spark)))}
    assert got == {"a": 9.35, "b": 93.5, "c": 2.0, "d": None}


def test_cross_check_and_snapshots(spark):
    old = sheet(spark)
    new = sheet(spark, [("v2", 0, "big-5", 10.0, 40.0, 1.0, None, 20.0),
                        ("v2", 1, "small-4", 1.0, 5.0, 0.1, 1.25, 2.0)])
    got = {(r["model_key"], r["bucket"], r["finding"]) for r in rows(pricing.cross_check(new, old))}
    assert got == {("big-5", "output", "differs"), ("big-5", "cache_write_5m", "absent")}
    assert rows(pricing.add_snapshot(old, old)) == []
    assert len(rows(pricing.add_snapshot(old, new))) == 2


def test_sheet_files_and_pick(spark, tmp_path):
    for name, rate in (("2026-08-09-hand", 3.0), ("2026-08-10-list", 2.0)):
        (tmp_path / f"{name}.json").write_text(
            '{"pricing_version":"%s","models":{"mid-5":{"input":%s,"output":null},'
            '"a-1":{"input":1}}}' % (name, rate))
    sheets = pricing.read_sheets(spark, str(tmp_path))
    latest = rows(pricing.pick_sheet(sheets), "ordinal")
    assert [(r["model_key"], r["input"], r["output"]) for r in latest] == [
        ("mid-5", 2.0, None), ("a-1", 1.0, None)]
    assert rows(pricing.pick_sheet(sheets, "hand"), "ordinal")[0]["input"] == 3.0


def test_build_sheet(spark):
    listed = spark.createDataFrame([
        (0, "azure/grok", 9e-6), (1, "big-5-latest", 1e-5), (2, "xai/grok-4", 2e-6),
        (3, "openai/grok-4-x", 3e-6), (4, "mid", 2.5e-6)],
        "ordinal int, price_key string, input_cost_per_token double")
    for c in ("output_cost_per_token", "cache_read_input_token_cost",
              "cache_creation_input_token_cost", "cache_creation_input_token_cost_above_1hr"):
        listed = listed.withColumn(c, F.lit(None).cast("double"))
    models = spark.createDataFrame([(0, "big-5"), (1, "grok"), (2, "mid"), (3, "none")],
                                   "ordinal int, model_id string")
    got = {r["model_key"]: (r["price_key"], r["input"]) for r in
           rows(pricing.build_sheet(listed, models))}
    assert got == {"big-5": ("big-5-latest", 10.0), "grok": ("openai/grok-4-x", 3.0),
                   "mid": ("mid", 2.5), "none": (None, None)}


def priced(spark):
    t = datetime(2026, 3, 1, 10)
    data = [("s1", "codex", t, M, 0, 0, 0, ["big-5"], "p1", "organic", False),
            ("s2", "codex", t, 1234, 0, 0, 0, ["small-4", "big-5"], "p2", "organic", True),
            ("s3", "codex", t, 1234, 0, 0, 0, ["small-4"], None, "eval_harness", None),
            ("s4", "cursor", t, None, None, None, None, ["big-5"], "p1", "eval_harness", None),
            ("s5", "codex", t, 500, 0, 0, 0, ["codex-auto-review"], "p1", "organic", None)]
    df = spark.createDataFrame(data, (
        "session_id string, source_tool string, started_at timestamp, input long, output long,"
        " cache_read long, cache_creation long, model_list array<string>, project_ref string,"
        " cohort string, automated boolean"))
    names = spark.createDataFrame([("p1", "alpha")], "project_ref string, display_name string")
    return spend.priced(df, sheet(spark), names)


def test_rollup_and_headline(spark):
    got = {(r["dimension"], r["key"]): r for r in rows(spend.rollup(priced(spark)))}
    # 1.234 thousandths is cut per session: 1 + 1, not 2.468
    assert got["model", "small-4"]["cost_x1000"] == 2
    assert got["tool", "codex"]["cost_x1000"] == 10002
    assert got["tool", "cursor"]["sessions"] == 0 and got["tool", "cursor"]["sessions_no_tokens"] == 1
    assert got["day", "2026-03-01"]["eval_sessions"] == 2
    assert got["project", "(unmapped)"]["sessions"] == 2
    assert got["model", "codex-auto-review"]["cost_x1000"] is None
    assert ("model", None) not in got and ("project", None) not in got
    h = rows(spend.headline(priced(spark)))[0]
    assert (h["priced_sessions"], h["unpriced_sessions"], h["no_token_sessions"]) == (3, 1, 1)
    assert (h["unpriced_tokens"], h["autoreview_sessions"], h["autoreview_tokens"]) == (500, 1, 500)
    assert h["total_cost"] == 10.002 and h["cursor_share_all"] == 0.2
    top = rows(spend.top_and_rest(spend.rollup(priced(spark)).where("dimension = 'model'"),
                                  "key", "cost_x1000", 1), "key")
    assert [(r["key"], r["cost_x1000"], r["groups"], r["unpriced_groups"]) for r in top] == [
        ("big-5", 10000, 1, 0), ("rest", 2, 2, 1)]


def test_tiers(spark):
    tiers = spark.createDataFrame([(0, "big", "frontier"), (1, "mid", "mid"), (2, "small", "small"),
                                   (3, "small-x", "open")], "ordinal int, prefix string, tier string")
    ids = spark.createDataFrame([("big-5",), ("small-x",), ("mid",), ("zzz",)], "m string")
    got = {r["id"]: r["tier"] for r in rows(pricing.tier_of(ids, "m", tiers))}
    assert got == {"big-5": "frontier", "small-x": "small", "mid": "mid"}
    over = rows(evals.overspend(evals.lead_tier(priced(spark), tiers), sheet(spark), "small-4"))[0]
    assert (over["sessions"], over["actual"], over["at_mid"], over["below_floor"]) == (1, 10.0, 1.0, 2)


GRID = {1: (3, 3, 3), 2: (3, 3, 3), 3: (2, 0, 0), 4: (1, 3, 0), 5: (3, 1, 0), 6: (0, 0, 0),
        7: (3, 3, 2), 8: (0, 0, 0), 9: (0, 0, 0), 10: (0, 0, 0)}


def test_repeated_runs(spark):
    runs = [(str(t), tier, i < k) for t, ks in GRID.items()
            for tier, k in zip(("frontier", "mid", "small"), ks) for i in range(3)]
    cell = evals.cells(spark.createDataFrame(runs, "task_id string, tier string, solved boolean"))
    assert evals.flaky(cell).count() == 4
    pairs = evals.paired(cell, "frontier", "mid")
    assert tuple(rows(evals.sign_counts(pairs))[0].values()) == (2, 1, 7)
    p = rows(evals.permutation_test(pairs))[0]
    assert p["difference"] == 2 and p["p_value"] == pytest.approx(0.64, abs=0.005)
    q = rows(evals.permutation_test(evals.paired(cell, "mid", "small")))[0]
    assert q["p_value"] == pytest.approx(0.025, abs=0.0015)
    assert {r["task_id"] for r in rows(evals.solved_only_by(cell, "frontier", "mid"))} == {"3"}


def test_permutation_equals_enumeration(spark):
    from itertools import product
    from math import comb
    cells = [(3, 2, 2, 1), (2, 2, 3, 0), (4, 1, 4, 3)]  # n_a, k_a, n_b, k_b
    df = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cells)],
                               "task_id string, n_a long, k_a long, n_b long, k_b long")
    lead = abs(sum(c[1] - c[3] for c in cells))
    total = hit = 0
    for xs in product(*[range(0, c[1] + c[3] + 1) for c in cells]):
        ways = math.prod(comb(c[0], x) * comb(c[2], c[1] + c[3] - x) for c, x in zip(cells, xs))
        diff = abs(sum(2 * x - c[1] - c[3] for c, x in zip(cells, xs)))
        total += ways
        hit += ways if diff >= lead else 0
    assert rows(evals.permutation_test(df))[0]["p_value"] == pytest.approx(hit / total, abs=1e-9)


def test_wilson(spark):
    df = spark.createDataFrame([(20, 30), (8, 30), (15, 30)], "k int, n int")
    got = [(round(r["ci_lower"], 3), round(r["ci_upper"], 3)) for r in
           rows(evals.with_wilson(df, "k", "n"))]
    assert sorted(got) == [(0.142, 0.444), (0.332, 0.668), (0.488, 0.808)]


def test_agreement(spark):
    pairs = [("x", "x")] * 4 + [("x", "y")] * 2 + [("y", "y")] * 3 + [("z", "x")]
    counts = agreement.contingency(spark.createDataFrame(pairs, "human string, ours string"), [])
    k = rows(agreement.kappa(counts, []))[0]
    po, pe = 0.7, (6 * 5 + 3 * 5) / 100
    assert k["accuracy"] == 0.7 and k["cohens_kappa"] == pytest.approx((po - pe) / (1 - pe))
    per = {r["label"]: r for r in rows(agreement.per_class(counts, []))}
    assert per["z"]["precision"] is None and per["z"]["f1"] == 0.0 and per["z"]["support"] == 1
    assert per["x"]["precision"] == 0.8 and per["x"]["recall"] == pytest.approx(4 / 6)
    assert [(r["human"], r["n"]) for r in agreement.confusions(counts, [], 1).collect()] == [("x", 2), ("rest", 1)]


def test_verified_savings_and_verdicts(spark):
    sheets = sheet(spark, SHEET + [("v2", 0, "big-5", 20.0, 50.0, 1.0, 1.0, 1.0),
                                   ("v2", 1, "small-4", 2.0, 5.0, .1, 1.0, 1.0)]).withColumn(
        "effective_date", F.when(F.col("pricing_version") == "v1", "2026-01-01").otherwise("2026-03-01"))
    s = spark.createDataFrame([
        ("a", datetime(2026, 2, 1), ["small-4-x"], ["big-5"], M),
        ("b", datetime(2026, 3, 1, 5), ["small-4"], ["big-5"], M),
        ("c", datetime(2025, 3, 1), ["small-4"], ["big-5"], M)],
        "id string, at timestamp, model_list array<string>, baseline_list array<string>, input long")
    for b in ("output", "cache_read", "cache_creation"):
        s = s.withColumn(b, F.lit(0).cast("long"))
    got = {r["id"]: (r["pricing_version"], r["saving"]) for r in
           rows(trace.verified_savings(s, sheets, "at"))}
    assert got == {"a": ("v1", 9.0), "b": ("v2", 18.0), "c": (None, None)}
    track = "task_type string, supports boolean, n int"
    v = {r["task_type"]: r["verdict"] for r in rows(trace.triangulate(
        spark.createDataFrame([("a", True, 30), ("b", True, 30), ("c", True, 30), ("d", True, 1)], track),
        spark.createDataFrame([("a", True, 30), ("b", False, 30)], track)))}
    assert v == {"a": "tracks_agree", "b": "tracks_disagree", "c": "single_track_only",
                 "d": "insufficient_data"}


def test_judge_gate(spark):
    comps = spark.createDataFrame([("k", 1, False, "win"), ("k", 1, True, "win"),
                                   ("k", 2, False, "win"), ("k", 2, True, "loss")],
                                  "task_type string, item int, swapped boolean, verdict string")
    verdicts = trace.judge_verdicts(comps, ["task_type", "item"])
    assert {r["item"]: r["verdict"] for r in rows(verdicts)} == {1: "win", 2: "inconsistent"}
    human = spark.createDataFrame([("k", 1, "win"), ("k", 2, "win")],
                                  "task_type string, item int, verdict string")
    gate = rows(trace.judge_gate(verdicts, human, ["task_type", "item"]))[0]
    assert gate["agreement_value"] == 0.5 and gate["cleared_agreement_gate"] is False


PATHS = {  # path: (test, docs, config, agent)
    "src/app.py": (0, 0, 0, 0), "tests/test_x.py": (1, 0, 0, 0), "a/foo_test.go": (1, 0, 0, 0),
    "src/ATest.java": (1, 0, 0, 0), "README.md": (0, 1, 0, 0), "docs/conf.json": (0, 1, 0, 0),
    "package.json": (0, 0, 1, 0), ".github/x.sh": (0, 0, 1, 0), "Dockerfile": (0, 0, 1, 0),
    ".claude/settings.json": (0, 0, 0, 1), "AGENTS.md": (0, 1, 0, 1), "x\\.cursor\\r": (0, 0, 0, 1),
}


def test_paths_and_instants(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = {r["p"]: tuple(int(r[c]) for c in ("is_test_path", "is_docs_path", "is_config_path",
                                             "is_agent_config_path"))
           for r in rows(df.select("p", *C.path_flag_columns(F.col("p"))))}
    assert got == PATHS
    t = spark.createDataFrame([("2026-01-05T10:00:00.1239+02:00",), ("2026-01-05T10:00:00",), ("x",)],
                              "s string").select("s", C.iso_text(C.instant(F.col("s"))).alias("i"))
    assert [r["i"] for r in t.collect()] == [
        "2026-01-05T08:00:00.123Z", "2026-01-05T10:00:00.000Z", None]
    e = spark.range(1).select(C.iso_text(C.epoch_instant(F.lit(1767600000000))).alias("m"),
                              C.iso_text(C.epoch_instant(F.lit(1767600000))).alias("s")).first()
    assert e["m"] == e["s"] == "2026-01-05T08:00:00.000Z"


def test_numeric_instants(spark):
    texts = ["1767600000", "1767600000.5", "1.7676e9", "1767600000123", "1767600001.001", "-1", "0", "12:30", "", "1e400", None]
    got = [r.i for r in spark.createDataFrame([(t,) for t in texts], "s string").select(
        C.iso_text(C.instant(F.col("s"))).alias("i")).collect()]
    assert got == ["2026-01-05T08:00:00.000Z", "2026-01-05T08:00:00.500Z", "2026-01-05T08:00:00.000Z",
                   "2026-01-05T08:00:00.123Z", "2026-01-05T08:00:01.001Z", "1969-12-31T23:59:59.000Z",
                   "1970-01-01T00:00:00.000Z", None, None, None, None]


def test_frequencies_of_many_runs_follow_the_spread():
    assert evals.highest_frequency(11, 2.0) == 5 and evals.highest_frequency(1, 0.0) == 0
    size, spread = 1_000_001, 150_000.0
    last = evals.highest_frequency(size, spread)
    assert last < size / 50 and math.exp(-2 * spread * math.sin(math.pi * last / size) ** 2) * size ** 2 < 1e-25
