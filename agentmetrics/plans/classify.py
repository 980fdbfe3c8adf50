"""Features of a unit of work and the ordered label rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators.keyed import by_shuffle, count_if, last_per_key
from ..operators.segment import assign_segments, segment_id, segments
from ..session import durable

FAMILIES = ["browser", "web", "read", "edit", "shell", "other"]
FLAGS = {"frac_test": "is_test_path", "frac_docs": "is_docs_path",
         "frac_config": "is_config_path", "frac_agent": "is_agent_config_path"}


def tool_totals(tools: DataFrame, keys: list[str]) -> DataFrame:
    """Calls in all and per tool family."""
    family = C.tool_family(F.col("tool_name"))
    return tools.groupBy(*keys).agg(
        F.sum("calls").alias("tool_calls"),
        *[F.sum(F.when(family == f, F.col("calls")).otherwise(0)).alias(f"calls_{f}")
          for f in FAMILIES])


def file_totals(files: DataFrame, keys: list[str]) -> DataFrame:
    """Edited files; the entry of the latest unit speaks for a file."""
    one = last_per_key(files, [*keys, "file_ref"], ["turn_index"],
                       ["top_dir_ref", "is_new_file", *FLAGS.values()])
    return one.groupBy(*keys).agg(
        F.count("*").alias("files_edited"),
        count_if(F.col("is_new_file")).alias("new_files"),
        F.count_distinct("top_dir_ref").alias("top_dirs"),
        *[F.avg(F.when(F.col(flag), 1.0).otherwise(0.0)).alias(name)
          for name, flag in FLAGS.items()])


def unit_features(units: DataFrame, tools: DataFrame, files: DataFrame,
                  keys: list[str]) -> DataFrame:
    """Features of each group of units. Line counts stay null unless a unit of
    the group knows them; tools and files that are missing count as zero."""
    known = F.col("lines_added").isNotNull()
    base = units.groupBy(*keys).agg(
        F.count("*").alias("n_units"),
        F.sum("lines_added").alias("lines_added"),
        F.sum(F.when(known, F.coalesce("lines_removed", F.lit(0)))).alias("lines_removed"),
        F.bool_or(F.coalesce("interrupted", F.lit(False))).alias("interrupted"))
    joined = (base.join(tool_totals(tools, keys), keys, "left")
              .join(file_totals(files, keys), keys, "left"))
    zeros = ["tool_calls", *[f"calls_{f}" for f in FAMILIES],
             "files_edited", "new_files", "top_dirs", *FLAGS]
    return joined.fillna(0, subset=zeros)


def session_features(sessions: DataFrame, tools: DataFrame, keys: list[str]) -> DataFrame:
    """Features from session aggregates, for sessions that have no units."""
    langs = F.coalesce("languages", F.array().cast("array<string>"))

    def only(allowed: list[str]) -> Column:
        inside = F.size(F.array_except(langs, F.array(*[F.lit(a) for a in allowed]))) == 0
        return F.when((F.coalesce("files_touched", F.lit(0)) > 0) & (F.size(langs) > 0) & inside,
                      1.0).otherwise(0.0)

    base = sessions.select(
        *keys, F.lit(None).cast("long").alias("n_units"), "lines_added", "lines_removed",
        (F.coalesce("interrupted_tool_calls", F.lit(0)) > 0).alias("interrupted"),
        F.coalesce("files_touched", F.lit(0)).cast("long").alias("files_edited"),
        F.lit(0).cast("long").alias("new_files"), F.lit(0).cast("long").alias("top_dirs"),
        F.lit(0.0).alias("frac_test"), only(fixed.DOCS_LANGUAGES).alias("frac_docs"),
        only(fixed.CONFIG_LANGUAGES).alias("frac_config"), F.lit(0.0).alias("frac_agent"))
    return (base.join(tool_totals(tools, keys), keys, "left")
            .fillna(0, subset=["tool_calls", *[f"calls_{f}" for f in FAMILIES]]))


def label(features: DataFrame) -> DataFrame:
    """Add the first matching rule's verdict.

    The chain is one CASE, so the order of its arms is the order of the rules.
    """
    f = {c: F.col(c) for c in features.columns}
    edits = f["files_edited"] > 0
    browser, web, reads = f["calls_browser"], f["calls_web"], f["calls_read"]
    looked = reads + web
    added, removed = f["lines_added"], f["lines_removed"]
    rules: list[tuple[Column, str, str | None, str, Column | float]] = [
        ((browser >= 3) & (browser >= f["tool_calls"] * 0.3),
         "R01-browser-loop", "ui_verification_loop", "classified", 0.7),
        (edits & (browser >= 1),
         "R01b-browser-present-edits", "ui_verification_loop", "classified", 0.55),
        (edits & (f["frac_agent"] >= 0.5),
         "R02-agent-config-paths", "agent_meta_work", "classified", 0.7),
        (edits & (f["frac_docs"] >= 0.99),
         "R03-docs-paths-only", "documentation", "classified", 0.75),
        (edits & (f["frac_test"] >= 0.6),
         "R04-test-paths-majority", "test_authoring", "classified", 0.65),
        (edits & (f["frac_config"] >= 0.99),
         "R05-config-paths-only", "config_infra", "classified", 0.7),
        (~edits & (f["tool_calls"] == 0),
         "R06-no-activity", "exploratory_qa", "classified", 0.7),
        (~edits & (looked > 0) & (f["calls_shell"] <= looked),
         "R07-read-search-no-edits", "exploratory_qa", "classified",
         F.when(web > 0, 0.75).otherwise(0.6)),
        (~edits, "R08-shell-only-unclassified", None, "unclassified", 0.5),
        ((f["new_files"] >= 3) & (added.isNull() | removed.isNull()
                                  | (removed <= F.greatest(added, F.lit(1)) * 0.15)),
         "R09-new-file-burst", "boilerplate_scaffolding", "classified", 0.6),
        ((f["files_edited"] == 1) & (added + removed > 0) & (added + removed <= 40)
         & (removed > 0),
         "R10-single-small-balanced", "single_file_bug_fix", "ambiguous", 0.45),
        ((f["files_edited"] >= 3) & (f["new_files"] == 0) & (removed > 0)
         & (added <= removed * 1.5),
         "R11-balanced-multifile", "multi_file_refactor", "classified", 0.5),
        (F.lit(True), "R12-edit-default", "feature_implementation", "classified", 0.55),
    ]
    verdict = None
    for condition, rule, task, status, confidence in rules:
        row = F.struct(
            F.lit(task).cast("string").alias("task_type"), F.lit(status).alias("status"),
            (confidence if isinstance(confidence, Column) else F.lit(confidence))
            .alias("confidence"),
            F.lit(rule).alias("rule_id"),
            F.lit("feature_implementation" if status == "ambiguous" else None).cast("string")
            .alias("alternative"),
            F.lit(0.4 if status == "ambiguous" else None).cast("double")
            .alias("alternative_confidence"))
        verdict = F.when(condition, row) if verdict is None else verdict.when(condition, row)
    breadth = (F.when(~edits, "unknown").when(f["top_dirs"] >= 2, "cross_module")
               .when(f["top_dirs"] == 1, "localized").otherwise("unknown"))
    return (features.withColumn("__v", verdict)
            .select(*features.columns, "__v.*", breadth.alias("context_breadth")))


VERDICT = ["task_type", "status", "confidence", "rule_id", "alternative",
           "alternative_confidence", "context_breadth"]


def classify_all(sessions: DataFrame, session_tools: DataFrame, units: DataFrame,
                 unit_tools: DataFrame, unit_files: DataFrame) -> DataFrame:
    """Labels at all three grains: prompt, segment and session.

    All inputs carry session_id. A session without units is labelled from its
    own aggregates.
    """
    sid, turn = "session_id", "turn_index"
    by_prompt = label(unit_features(units, unit_tools, unit_files, [sid, turn])).select(
        F.lit("prompt").alias("unit"), sid, F.col(turn).cast("long").alias("start_turn"),
        F.col(turn).cast("long").alias("end_turn"),
        F.lit(None).cast("string").alias("segment_id"), *VERDICT)

    assigned = durable(assign_segments(units, unit_files, [sid]))  # used four times
    member = assigned.select(sid, turn, "segment_no")
    grouped = [sid, "segment_no"]
    seg = segments(assigned, [sid])
    seg_features = unit_features(assigned, unit_tools.join(member, [sid, turn]),
                                 unit_files.join(member, [sid, turn]), grouped)
    by_segment = label(seg_features).join(
        seg.select(*grouped, "start_turn", "end_turn"), grouped).select(
        F.lit("segment").alias("unit"), sid, "start_turn", "end_turn",
        segment_id(F.col(sid), F.col("segment_no")).alias("segment_id"), *VERDICT)

    # a label needs a session: units of a session that was turned away have none
    known = by_shuffle(sessions.select(sid).distinct())
    with_units = unit_features(*[df.join(known, sid, "left_semi")
                                 for df in (units, unit_tools, unit_files)], [sid])
    without = sessions.join(by_shuffle(units.select(sid).distinct()), sid, "left_anti")
    fallback = session_features(without, session_tools, [sid])
    by_session = label(with_units.unionByName(fallback)).select(
        F.lit("session").alias("unit"), sid, F.lit(None).cast("long").alias("start_turn"),
        F.lit(None).cast("long").alias("end_turn"),
        F.lit(None).cast("string").alias("segment_id"), *VERDICT)
    return by_prompt.unionByName(by_segment).unionByName(by_session).select(
        "*", F.lit(fixed.CLASSIFIER_VERSION).alias("classifier_version"),
        F.lit(fixed.TAXONOMY_VERSION).alias("taxonomy_version"))


def summary(classes: DataFrame) -> DataFrame:
    """Records and unclassified share per grain."""
    return classes.groupBy("unit").agg(
        F.count("*").alias("records"),
        count_if(F.col("task_type").isNull()).alias("unclassified")).withColumn(
        "unclassified_share", C.ratio(F.col("unclassified"), F.col("records")))


def dominant_label(prompt_classes: DataFrame, keys: list[str], volume: str) -> DataFrame:
    """The most frequent prompt label per group, ties by edit volume; a tie in
    both is marked ambiguous."""
    counted = prompt_classes.groupBy(*keys, "task_type").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(volume, F.lit(0))).alias("volume"))
    rank = F.struct("n", "volume")
    best = counted.groupBy(*keys).agg(F.max(rank).alias("best"))
    return (counted.join(best, keys).where(rank == F.col("best")).groupBy(*keys).agg(
        F.min("task_type").alias("task_type"), F.count("*").alias("tied"),
        F.first("best.n").alias("n")).withColumn(
        "status", F.when(F.col("tied") > 1, "ambiguous").otherwise("classified")))
