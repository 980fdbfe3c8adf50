"""Logs written for these tests; expected values are worked out by hand from them."""
from pyspark.sql import functions as F

from agentmetrics.plans import sessions_a, sessions_b, sessions_c
from agentmetrics.sources import lines, logs_a, logs_b
from tests.conftest import rows

HIDDEN = "HIDDEN-WORDS"


def clock(minute, second=0):
    return f"2025-11-17T08:{minute:02d}:{second:02d}.000Z"


def prompt(uuid, when, words, **more):
    return {"type": "user", "uuid": uuid, "timestamp": when, "message": {"role": "user", "content": words}, **more}


def reply(uuid, when, message, model="oak", usage=None, tool=None):
    block = {"type": "tool_use", "name": tool, "id": f"call-{uuid}"} if tool else {"type": "text", "text": "fine"}
    body = {"id": message, "model": model, "content": [block]}
    return {"type": "assistant", "uuid": uuid, "timestamp": when, "message": body | ({"usage": usage} if usage else {})}


def outcome(uuid, when, **result):
    return {"type": "user", "uuid": uuid, "timestamp": when, "toolUseResult": result,
            "message": {"role": "user", "content": [{"type": "tool_result", "content": "done"}]}}


def spent(fresh, out, read=0, written=0):
    return {"input_tokens": fresh, "output_tokens": out, "cache_read_input_tokens": read,
            "cache_creation_input_tokens": written, "speed": "brisk", "service_tier": "batch"}


def orchard_log(sid, opening="seed", minute=2):
    """One prompt, two messages (the first logged twice), two edits, a stopped shell call."""
    common = {"sessionId": sid, "version": "7.3.1", "gitBranch": "pears", "cwd": "/srv/orchard"}
    log = [
        prompt(opening, clock(minute), f"{HIDDEN}: graft the tree", promptSource="pasted", origin={"kind": "script"}),
        reply("b1", clock(minute, 4), "msg-1", usage=spent(31, 7, 400, 60)),
        reply("b2", clock(minute, 9), "msg-1", usage=spent(31, 7, 400, 60), tool="Write"),
        outcome("o1", clock(minute, 12), filePath="/srv/orchard/web/graft.ts", type="create", userModified=True,
                structuredPatch=[{"lines": ["+x", "+y", "+z"]}, {"lines": ["+q", "-r", "-s", " t"]}]),
        outcome("o2", clock(minute, 15), filePath="/srv/orchard/notes.md", type="update", userModified=False,
                structuredPatch=[{"lines": ["-old"]}]),
        reply("b3", clock(minute, 20), "msg-2", model="elm", usage=spent(9, 3), tool="Bash"),
        outcome("o3", clock(minute, 31), interrupted=True),
        {"type": "user", "uuid": "stop", "timestamp": clock(minute, 32), "message": {
            "role": "user", "content": [{"type": "text", "text": "[Request interrupted by user]"}]}},
        {"type": "system", "subtype": "turn_duration", "durationMs": 6500, "timestamp": clock(minute, 33)},
    ]
    return [common | line for line in log]


def test_sessions_of_format_a(spark, write_log):
    write_log("logs/grove/first.jsonl", orchard_log("first"))
    write_log("logs/grove/later.jsonl", orchard_log("later", minute=9))
    root = write_log("logs/grove/torn.jsonl", ["not json at all", *orchard_log("torn", "own-seed")[:1], '{"half":', ""])
    write_log("logs/grove/first/subagents/agent-k.jsonl", orchard_log("first", "helper-seed", minute=4))
    raw = lines.read_lines(spark, root)
    records = logs_a.records(raw)
    got = {r["session_id"]: r for r in rows(sessions_a.mark_forks(sessions_a.sessions(records, "pepper")))}
    assert set(got) == {"first", "later", "torn", "first/agent-k"}
    first = got["first"]
    assert {k: first[k] for k in ("input", "output", "cache_read", "cache_creation")} == {
        "input": 40, "output": 10, "cache_read": 400, "cache_creation": 60}  # msg-1 counts once
    assert {k: first[k] for k in ("user_messages", "assistant_messages", "tool_calls", "interrupted_tool_calls")} == {
        "user_messages": 1, "assistant_messages": 2, "tool_calls": 2, "interrupted_tool_calls": 1}
    assert {k: first[k] for k in ("files_touched", "lines_added", "lines_removed", "hunks", "user_modified_edits")} == {
        "files_touched": 2, "lines_added": 4, "lines_removed": 3, "hunks": 3, "user_modified_edits": 1}
    assert first["languages"] == ["markdown", "typescript"] and first["git_branch"] == "pears"
    assert first["active_duration_ms"] == 6500 and first["wall_clock_ms"] == 33_000
    assert first["subagent_count"] == 1 and first["fork_of"] is None and first["automated"] is None
    assert got["later"]["fork_of"] == "first" and got["later"]["subagent_count"] == 0
    assert got["torn"]["fork_of"] is None and got["torn"]["lines_added"] is None
    helper = got["first/agent-k"]
    assert helper["automated"] is True and helper["parent_session_id"] == "first" and helper["subagent_count"] is None
    assert sorted((b["path"].rsplit("/", 1)[-1], b["line_no"]) for b in rows(lines.rejects(raw))) == [
        ("torn.jsonl", 1), ("torn.jsonl", 3)]
    here = F.col("path").endswith("/first.jsonl")
    assert {(r["source_name"], r["prompts"]) for r in rows(sessions_a.prompt_sources(records).where(here))} == {
        ("pasted", 1), ("origin_script", 1)}
    assert {r["model_id"]: (r["assistant_messages"], r["speed"]) for r in
            rows(sessions_a.models(records).where(here))} == {"oak": (1, "brisk"), "elm": (1, "brisk")}


def test_no_prompt_text_outside_the_sidecar(spark, write_log):
    root = write_log("logs/grove/first.jsonl", orchard_log("first"))
    records = logs_a.records(lines.read_lines(spark, root))
    found = sessions_a.sessions(records, "pepper")
    turned = sessions_a.turns(records)
    for table in (found.drop("path", "cwd"), sessions_a.units(turned), sessions_a.unit_files(turned, "pepper"),
                  sessions_a.models(records)):
        assert HIDDEN not in str(rows(table))
    assert [r["text"] for r in rows(logs_a.content_rows(records, found))] == [f"{HIDDEN}: graft the tree"]


def test_units_of_format_a(spark, write_log):
    root = write_log("logs/grove/first.jsonl", orchard_log("first") + [
        prompt("again", clock(3, 13), [{"type": "text", "text": "once more"}]),
        prompt("bell", clock(3, 20), "ready", origin={"kind": "task-notification"})])
    records = logs_a.records(lines.read_lines(spark, root))
    turned = sessions_a.turns(records)
    units = rows(sessions_a.units(turned), "turn_index")
    opened, closed = units
    assert opened["gap_ms_before"] is None and opened["interrupted"] and opened["interrupt_marker"]
    assert (opened["assistant_messages"], opened["tool_calls"], opened["input"], opened["active_ms"]) == (2, 2, 40, 6500)
    assert (opened["lines_added"], opened["lines_removed"], sorted(opened["models"])) == (4, 3, ["elm", "oak"])
    assert closed["gap_ms_before"] == 40_000 and closed["input"] is None and closed["models"] == []
    assert (closed["window_ended_at"].minute, closed["window_ended_at"].second) == (3, 20)
    files = {r["extension"]: (r["is_new_file"], r["is_docs_path"]) for r in rows(sessions_a.unit_files(turned, "pepper"))}
    assert files == {"ts": (True, False), "md": (False, True)}
    # a file cut into small blocks gives the same units
    assert rows(sessions_a.units(sessions_a.turns(records, limit=2)), "turn_index") == units


def note(second, kind, **payload):
    return {"timestamp": clock(40, second), "type": kind, "payload": payload}


def counted(fresh, cached, out, written, thought):
    return {"input_tokens": fresh, "cached_input_tokens": cached, "output_tokens": out,
            "cache_write_input_tokens": written, "reasoning_output_tokens": thought}


def test_sessions_and_units_of_format_b(spark, write_log):
    early, late = counted(700, 100, 41, 5, 9), counted(1900, 650, 88, 12, 30)
    write_log("rolls/2025/11/17/rollout-m-north.jsonl", [
        note(1, "session_meta", id="north", cwd="/srv/kelp", cli_version="3.0", git={"branch": "tide"}),
        note(2, "turn_context", model="reef", effort="low"),
        note(3, "event_msg", type="user_message", message=HIDDEN),
        note(5, "response_item", type="function_call", name="shell"),
        note(6, "response_item", type="function_call", name="shell"),
        note(8, "event_msg", type="token_count", info={"total_token_usage": early, "last_token_usage": early}),
        note(9, "event_msg", type="agent_message"),
        note(10, "event_msg", type="agent_message"),
        note(11, "event_msg", type="task_complete", duration_ms=2300),
        note(12, "session_meta", id="north", cli_version="3.1"),
        note(14, "turn_context", model="shoal", effort="high"),
        note(25, "event_msg", type="user_message", message="go on"),
        note(26, "response_item", type="custom_tool_call", name="apply_patch"),
        note(27, "event_msg", type="patch_apply_end", stdout="Success\nM lib/wave.py\nA tests/test_wave.py\nA lib/foam.ts\n"),
        note(28, "event_msg", type="agent_message"),
        note(29, "event_msg", type="token_count", info={"total_token_usage": late}),
        note(30, "event_msg", type="task_complete", duration_ms=1200)])
    root = write_log("rolls/2025/11/18/rollout-m-south.jsonl", [
        note(2, "session_meta", id="south", parent_thread_id="north", thread_source="subagent"),
        note(4, "event_msg", type="agent_message")])
    records = logs_b.records(lines.read_lines(spark, root))
    got = {r["session_id"]: r for r in rows(sessions_b.sessions(records, "pepper"))}
    north, south = got["north"], got["south"]
    # the last total counts, cached input apart
    assert [north[k] for k in ("input", "cache_read", "output", "cache_creation", "reasoning_output")] == [
        1250, 650, 88, 12, 30]
    assert [north[k] for k in ("user_messages", "assistant_messages", "tool_calls", "files_touched")] == [2, 3, 3, 3]
    assert (north["active_duration_ms"], north["git_branch"], north["source_format_version"]) == (3500, "tide", "3.1")
    assert north["languages"] == ["python", "typescript"] and north["automated"] is None
    assert south["parent_session_id"] == "north" and south["automated"] is True
    assert south["user_messages"] == 0 and south["output"] is None
    models = sessions_b.models(sessions_b.with_model(records)).where(F.col("path").contains("north"))
    assert {r["model_id"]: (r["assistant_messages"], r["effort"]) for r in rows(models)} == {
        "reef": (2, "low"), "shoal": (1, "high")}
    turned = sessions_b.turns(records)
    units = rows(sessions_b.units(turned), "turn_index")
    assert [(u["input"], u["cache_read"], u["models"], u["tool_calls"]) for u in units] == [
        (600, 100, ["reef"], 2), (None, None, ["shoal"], 1)]
    assert units[1]["gap_ms_before"] == 11_000
    assert rows(sessions_b.units(sessions_b.turns(records, limit=5)), "turn_index") == units
    files = rows(sessions_b.unit_files(turned, "pepper"))
    assert sorted((f["extension"], f["is_new_file"], f["is_test_path"]) for f in files) == [
        ("py", False, False), ("py", True, True), ("ts", True, False)]


def test_an_empty_context_ends_a_units_first_model(spark, write_log):
    root = write_log("rolls/rollout-m-east.jsonl", [
        note(1, "session_meta", id="east"), note(2, "turn_context", model="reef"), note(3, "turn_context"),
        note(4, "event_msg", type="user_message"), note(5, "event_msg", type="agent_message"),
        note(6, "turn_context", model="atoll"), note(7, "event_msg", type="agent_message"),
        note(8, "event_msg", type="agent_message")])
    records = logs_b.records(lines.read_lines(spark, root))
    assert rows(sessions_b.units(sessions_b.turns(records)))[0]["models"] == ["atoll"]
    assert {r["model_id"]: r["assistant_messages"] for r in
            rows(sessions_b.models(sessions_b.with_model(records)))} == {"reef": 1, "atoll": 2}


HEADERS = "composer_id string, created_at long, updated_at long, is_subagent int, value string"
MARKS = "hash string, source string, file_extension string, conversation_id string, model string, created_at long"
NOON = 1763380800000


def test_sessions_of_format_c(spark):
    marks = spark.createDataFrame([
        ("m1", "tab", "rs", "pond", "", NOON + 50), ("m2", "composer", "rs", "pond", "pike", NOON + 10),
        ("m3", "human", "sql", "lake", "", NOON + 7000), ("m4", "composer", "sql", "lake", "carp", NOON + 9500),
        ("m5", "composer", "sql", "lake", "carp", NOON + 8000), ("m6", "tab", "sql", "", "carp", NOON)], MARKS)
    value = ('{"filesChangedCount":8,"totalLinesAdded":17,"totalLinesRemoved":4,"numSubComposers":2,"name":"%s",'
             '"workspaceIdentifier":{"uri":{"path":"/srv/pond"}},"trackedGitRepos":[{"branches":[{"branchName":"reed"}]}]}')
    headers = spark.createDataFrame([("pond", NOON, NOON + 90_000, 1, value % HIDDEN)], HEADERS)
    lake, pond = rows(sessions_c.sessions(headers, marks, "pepper"), "session_id")
    assert [pond[k] for k in ("files_touched", "lines_added", "lines_removed", "subagent_count")] == [8, 17, 4, 2]
    assert (pond["models"], pond["git_branch"], pond["wall_clock_ms"], pond["automated"]) == (["pike"], "reed", 90_000, True)
    assert (lake["models"], lake["wall_clock_ms"], lake["lines_added"], lake["project_ref"]) == (["carp"], 2500, None, None)
    assert lake["log_format"] == "cursor_tracking_db" and pond["log_format"] == "cursor_state_db"
    assert HIDDEN not in str((lake, pond))


def test_content_hashes(spark, write_log):
    """A digest follows the lines and their order, not how a file was cut or what stands beside it."""
    import random

    log = [prompt(f"u{i}", clock(i % 50), "w" * random.Random(i).randint(1, 400)) for i in range(60)]
    root = write_log("one/file.jsonl", log)
    write_log("two/file.jsonl", log[1::-1] + log[2:])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    digests = set()
    try:
        for size in ("2k", "7k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = lines.read_lines(spark, root)
            digests.add(rows(lines.file_digests(raw))[0]["content_hash"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(digests) == 1
    assert rows(lines.file_digests(lines.read_lines(spark, root.replace("/one", "/two"))))[0]["content_hash"] not in digests
    none = spark.createDataFrame([], MARKS)
    hashes = {r["content_hash"] for value in ('{"filesChangedCount":3}', '{"totalLinesAdded":3}', '{"mode":"x"}', "{}")
              for r in rows(sessions_c.sessions(spark.createDataFrame([("s", NOON, NOON, 0, value)], HEADERS), none, "p"))}
    assert len(hashes) == 4


def test_numeric_times_in_format_a(spark, write_log):
    """A file whose times are all numbers is a session like any other."""
    root = write_log("logs/grove/first.jsonl", [
        {"type": "user", "timestamp": 1767600000, "sessionId": "first", "uuid": "u1", "message": {"content": "go"}},
        {"type": "assistant", "timestamp": 1767600060500, "sessionId": "first", "uuid": "u2",
         "message": {"id": "m", "model": "big-5", "usage": {"input_tokens": 3}}}])
    found = rows(logs_a.records(lines.read_lines(spark, root)), "uuid")
    assert [str(r["at"]) for r in found] == ["2026-01-05 08:00:00", "2026-01-05 08:01:00.500000"]
