"""Line-oriented log files as rows with a usable order.

A row is (path, split, pos, value): ``split`` is the byte offset of the file
block the line was read in and ``pos`` grows with the line within it, so
(split, pos) orders the lines of a file without numbering them. A block is
bounded by ``spark.sql.files.maxPartitionBytes``, which also bounds any task
that later orders one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["split", "pos"]


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
            .text(list(paths))
            .select(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("pos"),
                    "value"))


def parsed(lines: DataFrame, shape: str) -> DataFrame:
    """Non-blank lines with ``rec``, read by a schema; all null when malformed.

    The value passes through a one-element explode, which keeps the optimizer
    from moving later filters below it and so parsing a line once per filter.
    """
    read = F.from_json("value", shape)
    return (lines.where(F.trim("value") != "")
            .select("path", "split", "pos", F.explode(F.array(read)).alias("rec")))


def block_offsets(lines: DataFrame) -> DataFrame:
    """Per file and block what to add to ``pos`` for a one-based line number.

    ``pos`` is consecutive within a block, so its least value and the counts of
    earlier blocks number every line; nothing is ranked.
    """
    per_block = lines.groupBy("path", "split").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"))
    before = (Window.partitionBy("path").orderBy("split")
              .rowsBetween(Window.unboundedPreceding, -1))
    return per_block.select("path", "split", (
        F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("to_line"))


def rejects(lines: DataFrame) -> DataFrame:
    """Malformed lines with their one-based line number; only those are joined."""
    bad = lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select(
        "path", "split", "pos")
    return (bad.join(block_offsets(lines), ["path", "split"])
            .select("path", (F.col("pos") + F.col("to_line")).alias("line_no"),
                    F.lit("malformed JSON line").alias("reason")))


def file_digests(lines: DataFrame) -> DataFrame:
    """Content digest per file, for change detection.

    Built from hashes of (line number, text) by mergeable aggregates, so no file
    is ever held whole, and where a file was cut into blocks does not matter.
    """
    line = F.xxhash64(F.col("pos") + F.col("to_line"), "value")
    hashed = lines.join(block_offsets(lines), ["path", "split"]).select("path", line.alias("line"))
    return hashed.groupBy("path").agg(F.sha2(F.concat_ws(
        "|", F.count("*").cast("string"), F.bit_xor("line").cast("string"),
        F.sum(F.col("line") % 2_147_483_647).cast("string")), 256).alias("content_hash"))


def position():
    """Place of a record in its file, as one comparable value."""
    return F.struct(*ORDER)
