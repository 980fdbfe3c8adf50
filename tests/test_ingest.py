import json
import shutil
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from agentmetrics.operators import upsert
from agentmetrics.plans import classify, ingest
from agentmetrics.session import scratch_folder
from agentmetrics.sources.registry import SOURCES, normalise
from tests.conftest import rows
from tests.test_logs import HEADERS, HIDDEN, MARKS, NOON, clock, note, orchard_log, prompt


@pytest.fixture
def sources(spark, write_log):
    root_a = write_log("logs/grove/first.jsonl", orchard_log("first"))
    root_b = write_log("rolls/rollout-m-north.jsonl", [
        note(1, "session_meta", id="north", cwd="/srv/kelp"), note(2, "turn_context", model="reef"),
        note(3, "event_msg", type="user_message", message=HIDDEN), note(4, "event_msg", type="agent_message")])
    return {"claude-code": {"path": root_a}, "codex": {"path": root_b},
            "cursor": {"headers": spark.createDataFrame([("pond", NOON, NOON + 1000, 0, "{}")], HEADERS),
                       "attributions": spark.createDataFrame([], MARKS)}}


def test_extract_twice_changes_nothing(spark, sources, write_log, tmp_path):
    assert normalise(" Claude-Code ") in SOURCES
    out = str(tmp_path / "out")
    first = {r["source_tool"]: r for r in rows(ingest.extract(spark, sources, out, "pepper"))}
    assert {k: (r["new"], r["invalid"], r["skipped"]) for k, r in first.items()} == {
        "claude_code": (1, 0, 0), "codex": (1, 0, 0), "cursor": (1, 0, 0)}
    before = rows(spark.read.parquet(f"{out}/sessions"), "session_id")
    units = rows(spark.read.parquet(f"{out}/units"), "session_id")
    second = {r["source_tool"]: r for r in rows(ingest.extract(spark, sources, out, "pepper"))}
    assert all((r["unchanged"], r["new"], r["updated"]) == (1, 0, 0) for r in second.values())
    assert rows(spark.read.parquet(f"{out}/sessions"), "session_id") == before
    assert rows(spark.read.parquet(f"{out}/units"), "session_id") == units and len(units) == 2
    # a grown file is updated
    write_log("logs/grove/first.jsonl", orchard_log("first") + [prompt("more", clock(30), f"{HIDDEN} too"), "{torn"])
    third = {r["source_tool"]: r for r in rows(ingest.extract(spark, sources, out, "pepper", True))}
    assert third["claude_code"]["updated"] == 1 and third["codex"]["unchanged"] == 1
    assert third["claude_code"]["skipped"] == 1
    errors = rows(spark.read.parquet(f"{out}/errors"))
    assert [(e["line_no"], e["reason"]) for e in errors] == [(11, "malformed JSON line")]
    sessions = spark.read.parquet(f"{out}/sessions")
    assert HIDDEN not in str(rows(sessions))
    assert spark.read.parquet(f"{out}/content").count() == 3
    tables = {n: spark.read.parquet(f"{out}/{n}") for n in (
        "models", "tools", "prompt_sources", "units", "unit_tools", "unit_files")}
    nested = [json.loads(r[0]) for r in ingest.session_records(
        sessions, tables["models"], tables["tools"], tables["prompt_sources"]).select(
        F.to_json(F.struct("*"))).collect()]
    a = next(n for n in nested if n["session_id"] == "first")
    assert a["tokens"]["input"] == 40 and a["tool_call_pattern"][0] == {"tool_name": "Bash", "count": 1}
    assert a["prompt_source_counts"] == {"pasted": 1, "origin_script": 1}
    c = next(n for n in nested if n["session_id"] == "pond")
    assert "tokens" not in c and "turns" not in c and "diff_stats" not in c
    labels = rows(classify.classify_all(sessions, tables["tools"], tables["units"],
                                        tables["unit_tools"], tables["unit_files"]), "unit", "session_id")
    got = {(r["unit"], r["session_id"]): r["rule_id"] for r in labels if r["session_id"] != "first"}
    assert got == {("prompt", "north"): "R06-no-activity", ("segment", "north"): "R06-no-activity",
                   ("session", "north"): "R06-no-activity", ("session", "pond"): "R06-no-activity"}


@pytest.mark.parametrize("name", ["claude-code", "codex", "cursor"])
def test_one_source_alone_gives_the_same_columns(spark, sources, tmp_path, name):
    out = str(tmp_path / "alone")
    scratch = Path(scratch_folder(spark).removeprefix("file:"))
    before = set(scratch.glob("*")) if scratch.exists() else set()
    assert [r["new"] for r in rows(ingest.extract(spark, {name: sources[name]}, out, "pepper"))] == [1]
    assert not scratch.exists() or set(scratch.glob("*")) <= before  # landed text goes with the job
    sessions = spark.read.parquet(f"{out}/sessions")
    assert set(ingest.SESSION_TYPES) <= set(sessions.columns)
    if name != "cursor":
        labels = classify.classify_all(sessions, *[spark.read.parquet(f"{out}/{n}") for n in (
            "tools", "units", "unit_tools", "unit_files")])
        assert {r["unit"] for r in rows(labels)} == {"prompt", "segment", "session"}


def test_a_batch_of_one_source_keeps_what_others_stored(spark, sources, write_log, tmp_path):
    out = str(tmp_path / "both")
    ingest.extract(spark, {n: sources[n] for n in ("claude-code", "codex")}, out, "pepper")
    before = {r["session_id"]: r for r in rows(spark.read.parquet(f"{out}/sessions"))}
    assert spark.read.parquet(f"{out}/unit_files").count() == 2
    # the session comes back without its edits: its child rows go, those of others stay
    write_log("logs/grove/first.jsonl", orchard_log("first")[:2])
    ingest.extract(spark, {"claude-code": sources["claude-code"]}, out, "pepper")
    after = {r["session_id"]: r for r in rows(spark.read.parquet(f"{out}/sessions"))}
    assert after["north"] == before["north"] and after["first"] != before["first"]
    assert spark.read.parquet(f"{out}/unit_files").count() == 0
    assert {r["session_id"] for r in rows(spark.read.parquet(f"{out}/units"))} == {"first", "north"}


def test_a_cut_short_swap_is_finished(spark, tmp_path):
    path = tmp_path / "table"
    for written in (1, 2):
        upsert.replace_table(spark.range(written), str(path))
    assert spark.read.parquet(str(path)).count() == 2
    spark.range(3).write.parquet(f"{path}{upsert.NEXT}")
    path.rename(f"{path}{upsert.LAST}")  # both renames were due; the first has happened
    assert upsert.read_or_empty(spark, str(path), "id long").count() == 3
    shutil.rmtree(f"{path}{upsert.LAST}")
    path.rename(f"{path}{upsert.LAST}")  # and without a whole new table, the old one comes back
    assert upsert.read_or_empty(spark, str(path), "id long").count() == 3
    upsert.replace_table(spark.range(4), str(path))
    assert spark.read.parquet(str(path)).count() == 4 and not (tmp_path / f"table{upsert.LAST}").exists()


def test_missing_columns_meet_as_nulls(spark):
    old = spark.createDataFrame([(1, "x", 5)], "id int, content_hash string, only_old int")
    new = spark.createDataFrame([(2, "y", "z")], "id int, content_hash string, only_new string")
    got = rows(upsert.merge(old, new, ["id"], ["content_hash"]), "id")
    assert [(r["id"], r["only_old"], r["only_new"], r["outcome"]) for r in got] == [
        (1, 5, None, "kept"), (2, None, "z", "new")]


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default: None)
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            scratch_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


RULES = {  # features that reach each rule, others zero
    "R01-browser-loop": {"calls_browser": 3, "tool_calls": 10},
    "R01b-browser-present-edits": {"calls_browser": 1, "tool_calls": 9, "files_edited": 1},
    "R02-agent-config-paths": {"files_edited": 2, "frac_agent": 0.5, "tool_calls": 1},
    "R03-docs-paths-only": {"files_edited": 2, "frac_docs": 1.0},
    "R04-test-paths-majority": {"files_edited": 5, "frac_test": 0.6},
    "R05-config-paths-only": {"files_edited": 1, "frac_config": 0.99},
    "R06-no-activity": {},
    "R07-read-search-no-edits": {"calls_read": 1, "calls_shell": 1, "tool_calls": 2},
    "R08-shell-only-unclassified": {"calls_shell": 2, "calls_read": 1, "tool_calls": 3},
    "R09-new-file-burst": {"files_edited": 4, "new_files": 3, "lines_added": None, "lines_removed": None},
    "R10-single-small-balanced": {"files_edited": 1, "lines_added": 39, "lines_removed": 1},
    "R11-balanced-multifile": {"files_edited": 3, "lines_added": 15, "lines_removed": 10},
    "R12-edit-default": {"files_edited": 1, "lines_added": 40, "lines_removed": 1},
}


def test_each_label_rule(spark):
    counts = ["tool_calls", *[f"calls_{f}" for f in classify.FAMILIES], "files_edited", "new_files",
              "top_dirs", "lines_added", "lines_removed"]
    shares = list(classify.FLAGS)
    data = [(name, *[f.get(c, 0) for c in counts], *[float(f.get(c, 0)) for c in shares])
            for name, f in RULES.items()]
    ddl = "want string, " + ", ".join(f"{c} long" for c in counts) + ", " + ", ".join(
        f"{c} double" for c in shares)
    for r in rows(classify.label(spark.createDataFrame(data, ddl))):
        assert r["rule_id"] == r["want"]
        if r["want"].startswith("R10"):
            assert (r["status"], r["alternative"], r["alternative_confidence"]) == (
                "ambiguous", "feature_implementation", 0.4)
