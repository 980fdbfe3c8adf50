"""Replay tasks from fix commits, and test reports that accept them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.keyed import count_if, last_per_key


def normalised_subject(subject: Column) -> Column:
    return F.regexp_replace(F.lower(subject), "[^a-z0-9]", "")


def fix_subjects(commits: DataFrame, since: str | None = None) -> DataFrame:
    """Commits whose subject reads like a fix, one (the newest) per subject.

    A subject is marked seen only once it has passed the patterns, so the filter
    comes before the pick.
    """
    pool = commits.where(~F.coalesce("is_merge", F.lit(False)))
    if since:
        pool = pool.where(F.col("at") >= F.lit(since).cast("timestamp"))
    fixes = pool.where(F.col("subject").rlike(fixed.FIX_PATTERN)
                       & ~F.col("subject").rlike(fixed.NOISE_PATTERN))
    return last_per_key(fixes.withColumn("subject_key", normalised_subject(F.col("subject"))),
                        ["repo", "subject_key"], ["at", "sha"], ["sha", "at", "subject"])


def test_class(path: Column) -> Column:
    """Class name of a test source path."""
    inner = F.regexp_extract(path, r"^src/test/java/(.+)\.java$", 1)
    return F.when(inner != "", F.replace(inner, F.lit("/"), F.lit(".")))


def candidates(subjects: DataFrame, numstat: DataFrame,
               max_main_files: int = fixed.MAX_MAIN_FILES,
               max_churn: int = fixed.MAX_MAIN_CHURN) -> DataFrame:
    """Fix commits of modest size that also change a test."""
    path = F.col("path")
    main = path.startswith(fixed.MAIN_PREFIX)
    test = path.startswith(fixed.TEST_PREFIX)
    hidden = test & path.endswith(fixed.TEST_SUFFIX)
    churn = F.col("ins").cast("long") + F.col("del").cast("long")
    shapes = (numstat.where(F.col("ins") != "-")
              .join(subjects.select("repo", "sha"), ["repo", "sha"], "left_semi")
              .groupBy("repo", "sha").agg(
                  count_if(main).alias("main_files"), count_if(hidden).alias("test_files"),
                  count_if(~main & ~test).alias("other_files"),
                  F.coalesce(F.sum(F.when(main, churn)), F.lit(0)).alias("main_churn"),
                  F.array_sort(F.collect_set(F.when(hidden, test_class(path))))
                  .alias("test_classes")))
    fits = ((F.col("main_files").between(1, max_main_files)) & (F.col("test_files") > 0)
            & (F.col("main_churn") <= max_churn)
            & (F.col("other_files") <= fixed.MAX_OTHER_FILES))
    return subjects.join(shapes.where(fits), ["repo", "sha"])


def task_kind(main_files: Column) -> Column:
    return F.when(main_files == 1, "single_file_bug_fix").otherwise("multi_file_bug_fix")


def read_test_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file: task, side and counts, from a
    ``<task>/<side>/TEST-*.xml`` tree."""
    raw = (spark.read.format("xml").option("rowTag", "testsuite")
           .option("recursiveFileLookup", "true").option("attributePrefix", "_")
           .schema("_tests long, _failures long, _errors long").load(path))
    place = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/TEST-[^/]+\.xml$", 1)
    side = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/TEST-[^/]+\.xml$", 2)
    return raw.select(place.alias("task_id"), side.alias("side"),
                      F.coalesce("_tests", F.lit(0)).alias("tests"),
                      F.coalesce("_failures", F.lit(0)).alias("failures"),
                      F.coalesce("_errors", F.lit(0)).alias("errors"))


def test_totals(reports: DataFrame) -> DataFrame:
    """Passed and total per task and side; a side without a report has no row."""
    return reports.groupBy("task_id", "side").agg(
        F.sum(F.col("tests") - F.col("failures") - F.col("errors")).alias("passed"),
        F.sum("tests").alias("total"))


def accepted(totals: DataFrame) -> DataFrame:
    """Tasks whose bug shows before the fix and whose tests all pass after it.

    One aggregate holds both sides, so no self-join is needed.
    """
    def of(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{side}_{name}")

    both = totals.groupBy("task_id").agg(
        of("pre", "passed"), of("pre", "total"), of("fix", "passed"), of("fix", "total"))
    return both.where((F.col("pre_total") > 0) & (F.col("pre_passed") < F.col("pre_total"))
                      & (F.col("fix_total") > 0) & (F.col("fix_passed") == F.col("fix_total")))


def first_tasks(tasks: DataFrame, n: int) -> DataFrame:
    """The newest n valid tasks."""
    return tasks.orderBy(F.desc("at"), "sha").limit(n)
