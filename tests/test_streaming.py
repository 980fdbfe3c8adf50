import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from agentmetrics.operators.buckets import Parts
from agentmetrics.plans import sessions_a
from agentmetrics.sources import appended, lines, logs_a
from agentmetrics.streaming import jobs
from tests.conftest import rows
from tests.test_logs import orchard_log
from tests.test_money import SHEET, SHEET_DDL
from tests.test_segments import fold, random_sessions

T0 = datetime(2026, 1, 5, 10)


def drain(stream, tmp_path, spark, name="out", clocked=False):
    target = str(tmp_path / name)
    assert jobs.run(stream, str(tmp_path / f"{name}-ck"), target, drain=True, clocked=clocked).awaitTermination(240)
    return rows(spark.read.parquet(target))


def usage(spark, table):
    return sorted((r["message_id"], r["input"]) for r in rows(jobs.earliest(spark.read.parquet(table))))


def test_usage_stream_equals_batch(spark, write_log, tmp_path):
    root = write_log("logs/grove/first.jsonl", orchard_log("first"))
    table = str(tmp_path / "usage")
    changes = jobs.first_usage(logs_a.records(jobs.log_lines(spark, root)))
    jobs.run(changes, str(tmp_path / "ck"), jobs.changes_into(table), mode="update", drain=True).awaitTermination(240)
    assert usage(spark, table) == [("msg-1", 31), ("msg-2", 9)]


def test_usage_that_arrives_late_or_without_a_time_is_corrected(spark, tmp_path):
    folder, table = tmp_path / "records", str(tmp_path / "usage")
    ddl = "path string, split long, pos long, rtype string, message_id string, at timestamp, input long"
    for n, batch in enumerate([[("f", 0, 9, "assistant", "m", T0, 900), ("f", 0, 5, "assistant", "n", None, 5)],
                               [("f", 0, 3, "assistant", "m", None, 3), ("f", 0, 7, "assistant", "n", T0, 7)],
                               [("f", 0, 1, "user", "m", T0, 1), ("f", 0, 4, "assistant", "m", T0, 4)]]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(ddl).parquet(str(folder))
        jobs.run(jobs.first_usage(stream), str(tmp_path / "ck"), jobs.changes_into(table), mode="update",
                 drain=True).awaitTermination(240)
        want = [("m", 900), ("n", 5)] if n == 0 else [("m", 3), ("n", 5)]
        assert usage(spark, table) == want


def test_appended_lines_are_read_on_from_where_files_ended(spark, tmp_path):
    root, table = tmp_path / "logs", str(tmp_path / "bronze")
    (root / "a b").mkdir(parents=True)
    steps = [{"a b/x.jsonl": '{"n":1}\n{"n":2}\n{"torn', "y.jsonl": "", "skip.txt": "no\n"},
             {"a b/x.jsonl": '":3}\n', "z.jsonl": "é1\r\n\n  \nlast\n"},
             {"y.jsonl": "".join(f'{{"line":{i}}}\n' for i in range(500))}]
    for step in steps:
        for name, text in step.items():
            with open(root / name, "a", newline="") as fh:
                fh.write(text)
        stream = jobs.log_lines(spark, str(root), rangeBytes="64")
        jobs.run(stream, str(tmp_path / "ck"), jobs.changes_into(table), drain=True).awaitTermination(240)

    def ordered(frame):
        files = {}
        for r in sorted(rows(frame.drop("batch")), key=lambda r: (r["split"], r["pos"])):
            files.setdefault(r["path"], []).append(r["value"])
        return files

    landed = ordered(spark.read.parquet(table))
    assert landed == ordered(lines.read_lines(spark, str(root))) and len(landed) == 3
    assert sum(map(len, landed.values())) == 507


def test_ranges_hold_every_line_once(tmp_path):
    path = str(tmp_path / "f.jsonl")
    text = "".join("x" * (i % 7) + "\n" for i in range(200))
    with open(path, "w") as fh:
        fh.write(text)
    files, _ = appended.opened_at(path)
    for size in (1, 2, 5, 64, 10_000):
        found = [line for part in appended.ranges(path, 3, len(text), size) for line in appended.lines_in(files, path, part)]
        assert [at for at, _ in found] == sorted({at for at, _ in found})
        assert "".join(value + "\n" for _, value in found) == text[3:]


def test_small_files_share_a_task(tmp_path):
    for n in range(300):
        (tmp_path / f"f{n}.jsonl").write_text(f'{{"n":{n}}}\n')
    (tmp_path / "long.jsonl").write_text("x\n" * 5_000)
    reader = appended.AppendedReader({"path": str(tmp_path), "rangebytes": str(4 << 20)})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) < 30
    lines_of = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert len(lines_of) == 5_300 and len(set(lines_of)) == 301


def test_lines_are_written_to_one_file_a_name(spark, tmp_path):
    folder = str(tmp_path / "logs")
    rows_of = spark.range(1000).select((F.col("id") % 3).cast("string").alias("sid"), F.col("id").alias("pos"),
                                       F.concat(F.lit("é"), F.col("id").cast("string")).alias("value"))
    assert appended.write_files(rows_of, folder, "sid", ["pos"]) == 3
    for n in range(3):
        text = (tmp_path / "logs" / f"{n}.jsonl").read_text(encoding="utf-8")
        assert text == "".join(f"é{i}\n" for i in range(n, 1000, 3))
    assert appended.write_files(rows_of.where("false"), str(tmp_path / "none"), "sid", ["pos"]) == 0


def test_landed_stream_gives_the_same_units(spark, write_log, tmp_path):
    root = write_log("logs/grove/first.jsonl", orchard_log("first"))
    table = str(tmp_path / "bronze")
    jobs.run(jobs.log_lines(spark, root), str(tmp_path / "ck"), jobs.land(logs_a.records, table),
             drain=True).awaitTermination(240)
    landed = rows(sessions_a.units(sessions_a.turns(spark.read.parquet(table).drop("batch"))))
    batch = rows(sessions_a.units(sessions_a.turns(logs_a.records(lines.read_lines(spark, root)))))
    assert landed == batch and len(batch) == 1


def units_in_files(tmp_path, sessions):
    """Two files per session, so that state crosses micro-batches."""
    folder = tmp_path / "units"
    folder.mkdir()
    for part in (0, 1):
        with open(folder / f"part{part}.json", "w") as fh:
            for sid, units in sessions.items():
                half = len(units) // 2
                for i, u in enumerate(units):
                    if (i >= half) == bool(part):
                        fh.write(json.dumps({
                            "session_id": sid, "turn_index": i, "gap_ms_before": u["gap"],
                            "at": (T0 + timedelta(minutes=i)).isoformat(), "git_branch": u["branch"],
                            "interrupted": u["cut"], "file_refs": [f for f, _ in u["files"]],
                            "dir_refs": [d for _, d in u["files"]]}) + "\n")
    return str(folder)


UNITS = ("session_id string, turn_index long, gap_ms_before long, at timestamp, git_branch string,"
         " interrupted boolean, file_refs array<string>, dir_refs array<string>")


def labels_of(drained):
    got = {}
    for r in drained:
        got.setdefault(r["session_id"], {})[r["turn_index"]] = r["opened_by"]
    return {s: [v[i] for i in sorted(v)] for s, v in got.items()}


def test_segment_stream_equals_fold(spark, tmp_path):
    sessions = random_sessions(9, 4, 30)
    stream = spark.readStream.schema(UNITS).option("maxFilesPerTrigger", 1).json(units_in_files(tmp_path, sessions))
    assert labels_of(drain(jobs.segments(stream), tmp_path, spark, clocked=True)) == {s: fold(us) for s, us in sessions.items()}


def test_units_in_any_order_and_after_a_long_pause(spark, tmp_path):
    """Turns are dealt to files at random and come twice; numbers go on."""
    sessions = random_sessions(11, 3, 24)
    for units in sessions.values():
        units[12]["gap"] = 2 * 86_400_000
    rng, folder = random.Random(5), tmp_path / "units"
    folder.mkdir()
    for half in (0, 1):
        lines_of = [[] for _ in range(3)]
        for sid, units in sessions.items():
            for i, u in enumerate(units[12 * half:12 * half + 12], 12 * half):
                line = json.dumps({"session_id": sid, "turn_index": i, "gap_ms_before": u["gap"], "git_branch": u["branch"],
                                   "interrupted": u["cut"], "file_refs": [f for f, _ in u["files"]],
                                   "dir_refs": [d for _, d in u["files"]]}) + "\n"
                for to in rng.sample(range(3), 2):
                    lines_of[to].append(line)
        for n, text in enumerate(lines_of):
            rng.shuffle(text)
            (folder / f"{half}-{n}.json").write_text("".join(text))
        stream = spark.readStream.schema(UNITS).option("maxFilesPerTrigger", 1).json(str(folder))
        out = drain(jobs.segments(stream), tmp_path, spark, clocked=True)
    assert len(out) == 3 * 24
    assert labels_of(out) == {s: fold(us) for s, us in sessions.items()}
    numbers = sorted((r["session_id"], r["turn_index"], r["segment_no"], r["opened_by"]) for r in out)
    for (s1, _, n1, _), (s2, _, n2, o2) in zip(numbers, numbers[1:]):
        assert s1 != s2 or n2 == n1 + (o2 is not None)


def sessions_stream(spark, tmp_path):
    folder = tmp_path / "sessions"
    late = T0 + timedelta(days=9)
    data = [("s1", "codex", T0, "big-5", 1_000_000), ("s2", "codex", T0, "small-4-x", 1_234_000),
            ("s3", "cursor", T0, "nobody", 5), ("s9", "codex", late, "big-5", 1)]
    (spark.createDataFrame(data, "session_id string, source_tool string, started_at timestamp,"
                                 " model_id string, input long").coalesce(1).write.parquet(str(folder)))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))
    for c in ("output", "cache_read", "cache_creation"):
        stream = stream.withColumn(c, F.lit(0).cast("long"))
    return stream


def test_daily_spend_and_gap_segments(spark, tmp_path):
    sheet = spark.createDataFrame(SHEET, SHEET_DDL)
    models = spark.createDataFrame([("big-5",), ("small-4-x",), ("nobody",)], "model_id string")
    stream = sessions_stream(spark, tmp_path)
    got = drain(jobs.daily_spend(stream, jobs.resolved_rates(models, sheet)), tmp_path, spark)
    by_tool = {r["source_tool"]: (r["sessions"], r["cost_x1000"]) for r in got if r["day"].day == 5}
    assert by_tool == {"codex": (2, 11234), "cursor": (1, None)}
    gaps = drain(jobs.gap_segments(stream, "source_tool", "started_at"), tmp_path, spark, "gaps")
    assert ("codex", 2) in {(r["source_tool"], r["n"]) for r in gaps}


def test_upsert_sink_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "table")
    ddl = "k string, content_hash string, schema_version string, connector_version string, at int"
    write = jobs.upsert_into(table, Parts(["k"], 4), "at")
    first = spark.createDataFrame([("a", "h1", "1", "1", 1), ("a", "h2", "1", "1", 2),
                                   ("b", "h1", "1", "1", 1)], ddl)
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([("b", "h1", "1", "1", 9), ("c", "h", "1", "1", 1)], ddl), 1)
    got = {r["k"]: (r["content_hash"], r["at"]) for r in rows(spark.read.parquet(table))}
    assert got == {"a": ("h2", 2), "b": ("h1", 1), "c": ("h", 1)}
