"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "agentmetrics", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster ``master`` and ``shuffle_partitions`` stay unset: spark-submit
    names the first, and adaptive execution coalesces the second.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC instants; zone-less input is read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder inside the shared checkpoint folder.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Where that is
    unset, a private folder serves a session of one machine and goes with it; on a
    cluster, whose nodes could not read it, this raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        shared = tempfile.mkdtemp(prefix="agentmetrics-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession, part: str = "") -> None:
    """Delete what this application has landed; call it when its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/{part}".rstrip("/"))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_JOBS: list[str] = []


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Tables landed inside go when the block ends, whether it succeeds or not."""
    _JOBS.append(f"job-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        clear_scratch(spark, "/".join(_JOBS))
        _JOBS.pop()


def durable(df: DataFrame, outlive: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    ``outlive`` is the number of open ``job_scratch`` blocks that the table stays beyond.

    Cuts lineage so that a lost executor costs a re-read and not a re-run, fixes
    values that could differ between two evaluations, and leaves a columnar
    table with known size, so later reads prune columns and small tables are
    broadcast by their real size.
    """
    spark = df.sparkSession
    target = "/".join([scratch_folder(spark), *_JOBS[:len(_JOBS) - outlive], uuid.uuid4().hex])
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
