from pyspark.sql import functions as F

from agentmetrics.functions import fixed
from agentmetrics.plans import ingest, reporting, spend
from tests.conftest import rows
from tests.test_ingest import sources  # noqa: F401

SHEET = ("pricing_version string, ordinal int, model_key string, input double, output double,"
         " cache_read double, cache_write_5m double, cache_write_1h double")


def test_from_logs_to_stored_reports(spark, sources, tmp_path):  # noqa: F811
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    ingest.extract(spark, sources, data, "pepper")
    sheet = spark.createDataFrame([("v", 0, "reef", 1e6, 1e6, 1e6, 1e6, 1e6)], SHEET)
    paths = reporting.report(spark, data, out, sheet, eval_marker="/rolls/")
    first = {n: sorted(map(str, rows(spark.read.parquet(p)))) for n, p in paths.items()}
    tools = {r["key"]: r for r in rows(spark.read.parquet(paths["rollup"])) if r["dimension"] == "tool"}
    assert set(tools) == {"claude_code", "codex", "cursor"} and tools["cursor"]["sessions_no_tokens"] == 1
    assert tools["claude_code"]["input"] == 40
    labelled = rows(reporting.read_labels(spark, paths["labels"]))
    assert {r["unit"] for r in labelled} == {"prompt", "segment", "session"}
    assert {r["session_id"] for r in labelled} == {"first", "north", "pond"}
    mix = rows(spark.read.parquet(paths["task_mix"]))
    assert {(r["source_tool"], r["cohort"]) for r in mix} == {
        ("claude_code", "organic"), ("codex", "eval_harness"), ("cursor", "organic")}
    assert rows(spark.read.parquet(paths["headline"]))[0]["n_sessions"] == 3
    # again: the same tables; labels of another version stay beside
    old = reporting.read_labels(spark, paths["labels"]).withColumn("classifier_version", F.lit("old"))
    reporting.save_labels(spark, old, paths["labels"], "old")
    reporting.report(spark, data, out, sheet, eval_marker="/rolls/")
    again = reporting.read_labels(spark, paths["labels"])
    assert again.count() == 2 * len(labelled)
    for n, p in paths.items():
        now = spark.read.parquet(p)
        now = now.where(F.col("classifier_version") == fixed.CLASSIFIER_VERSION) if n == "labels" else now
        assert sorted(map(str, rows(now))) == first[n]
    reporting.save_labels(spark, old.where("false"), paths["labels"], "old")
    assert reporting.read_labels(spark, paths["labels"]).count() == len(labelled)


def test_the_last_tool_owns_a_session_id(spark, tmp_path):
    data = str(tmp_path)
    spark.createDataFrame(
        [("codex", "a", 1), ("claude_code", "a", 2), ("cursor", "a", 3), ("claude_code", "b", 4), ("other", "b", 5),
         ("cursor", None, 6), ("other", "c", 7)], "source_tool string, session_id string, n int").write.parquet(f"{data}/sessions")
    spark.createDataFrame([("codex", "a", "m"), ("cursor", "a", "n"), ("claude_code", "b", "o")],
                          "source_tool string, session_id string, model_id string").write.parquet(f"{data}/models")
    spark.createDataFrame([("codex", "a", 0), ("cursor", "a", 1)],
                          "source_tool string, session_id string, turn_index int").write.parquet(f"{data}/units")
    tables = reporting.load(spark, data)
    assert sorted(r["n"] for r in rows(tables["sessions"])) == [1, 4, 7]
    assert sorted(r["model_id"] for r in rows(tables["models"])) == ["m", "o"]
    assert tables["units"].count() == 2 and tables["tools"].count() == 0


def test_a_repeated_cell_leaves_one_row(spark, tmp_path):
    path, ddl = str(tmp_path / "cells"), "run_id string, task_id string, model_id string, solved boolean, at int"
    batch = spark.createDataFrame([("r1", "t", "m", False, 1), ("r1", "t", "m", True, 2), ("r2", "t", "m", True, 1)], ddl)
    assert reporting.save_cells(spark, batch, path, ["at"]) == ["r1", "r2"]
    before = rows(reporting.read_cells(spark, path), "run_id")
    assert [(r["run_id"], r["at"]) for r in before] == [("r1", 2), ("r2", 1)]
    reporting.save_cells(spark, batch, path, ["at"])
    assert rows(reporting.read_cells(spark, path), "run_id") == before
    more = spark.createDataFrame([("r2", "t", "m", False, 9), ("r2", "u", "m", True, 9)], ddl)
    assert reporting.save_cells(spark, more, path, ["at"]) == ["r2"]
    assert reporting.read_cells(spark, path).count() == 3
    assert reporting.save_cells(spark, more.where("false"), path, ["at"]) == []


def test_no_session_is_broadcast_in_a_report(spark):
    wide = spark.range(2_000).selectExpr("cast(id as string) session_id", "'codex' source_tool", "'organic' cohort", "true automated")
    classes = wide.selectExpr("'session' unit", "session_id", "'t' task_type")
    for joined in (spend.task_mix(classes, wide), spend.origin_mix(classes, wide), reporting.one_per_id(wide)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows(spend.origin_mix(classes, wide))[0]["n"] == 2_000
