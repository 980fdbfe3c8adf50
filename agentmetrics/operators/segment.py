"""Segments: contiguous runs of prompt units, opened by observable boundaries.

Four boundaries depend only on neighbouring units. The fifth, a jump to files
unrelated to those of the segment so far, depends on where the segment started,
which looks like a sequential fold. It is not one over file sets: unit ``u``
jumps out of a segment starting at ``s`` exactly when it edits files, the
segment already has files, and the last earlier unit sharing a file or top
directory with ``u`` lies before ``s``. That last unit, ``shared_at``, is a
plain keyed scan. What stays sequential is one comparison of two integers per
candidate, and that chain is composed over bounded blocks when it is long.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .scan import (BLOCK, ROWS_PER_BLOCK, latest, latest_before, rows_per_key, running,
                   running_sum, with_blocks)

TURN = "turn_index"
NEVER = -1


def shared_at(unit_files: DataFrame, keys: list[str], limit: int = ROWS_PER_BLOCK,
              top: int | None = None) -> DataFrame:
    """Per unit with files: the last earlier turn sharing a file or directory."""
    tokens = (unit_files.select(*keys, TURN, F.explode(F.array("file_ref", F.concat(
        F.lit("dir:"), F.col("top_dir_ref")))).alias("token")).distinct())
    seen = running(tokens, [*keys, "token"], [TURN], {"before": latest_before(F.col(TURN))},
                   limit=limit, ordinal=TURN, top=top)
    return seen.groupBy(*keys, TURN).agg(
        F.coalesce(F.max("before"), F.lit(NEVER)).alias("shared_at"))


def _walk(turns, shared, start):
    """Jump turns of one chain."""
    jumps = []
    for turn, last in zip(turns, shared):
        if last < start:
            jumps.append(turn)
            start = turn
    return jumps


def _summary(turns, shared):
    """A block as a step function from segment start on entry to start on exit.

    Returns ascending thresholds and, for each, the exit start of an entry that
    is above it but not above the next. Entries above none pass unchanged.
    """
    lows, exits = [], []
    for turn, last in zip(reversed(turns), reversed(shared)):
        after = bisect_left(lows, turn) - 1
        leave = exits[after] if after >= 0 else turn
        while lows and lows[-1] >= last:
            lows.pop()
            exits.pop()
        lows.append(last)
        exits.append(leave)
    return lows, exits


def _through(lows, exits, start):
    at = bisect_left(lows, start) - 1
    return exits[at] if at >= 0 else start


def file_jumps(candidates: DataFrame, keys: list[str], limit: int = ROWS_PER_BLOCK,
               top: int | None = None) -> DataFrame:
    """Turns at which a file jump opens a segment.

    ``candidates`` holds keys, run_start (turn of the last boundary known
    without file sets), turn_index and shared_at.
    """
    run = [*keys, "run_start"]
    slim = candidates.select(*run, TURN, "shared_at")
    blocks, blocked = with_blocks(slim, run, [TURN], limit, ordinal=TURN, top=top)
    key_fields = [candidates.schema[c] for c in run]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    out_ddl = f"{key_ddl}, {TURN} long"

    def emit(pdf: pd.DataFrame, start: int) -> pd.DataFrame:
        pdf = pdf.sort_values(TURN)
        jumps = set(_walk(pdf[TURN].tolist(), pdf["shared_at"].tolist(), start))
        return pdf.loc[pdf[TURN].isin(jumps), [*run, TURN]]

    if not blocked:
        return blocks.groupBy(*run).applyInPandas(
            lambda pdf: emit(pdf, int(pdf["run_start"].iloc[0])), out_ddl)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TURN)
        lows, exits = _summary(pdf[TURN].tolist(), pdf["shared_at"].tolist())
        head = pdf[[*run, BLOCK]].iloc[:1].copy()
        head["lows"], head["exits"] = [lows], [exits]
        return head

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        start, entries = int(pdf["run_start"].iloc[0]), []
        for lows, exits in zip(pdf["lows"], pdf["exits"]):
            entries.append(start)
            start = int(_through(list(lows), list(exits), start))
        return pdf[[*run, BLOCK]].assign(entry=entries)

    summaries = blocks.groupBy(*run, BLOCK).applyInPandas(
        summarise, f"{key_ddl}, {BLOCK} long, lows array<long>, exits array<long>")
    entries = summaries.groupBy(*run).applyInPandas(
        compose, f"{key_ddl}, {BLOCK} long, entry long")
    return (blocks.join(entries, [*run, BLOCK]).groupBy(*run, BLOCK)
            .applyInPandas(lambda pdf: emit(pdf, int(pdf["entry"].iloc[0])), out_ddl))


def assign_segments(units: DataFrame, unit_files: DataFrame | None, keys: list[str],
                    gap_ms: int = fixed.TURN_GAP_MS, limit: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``opened_by`` (null inside a segment) and ``segment_no`` to each unit."""
    units = units.withColumn(TURN, F.col(TURN).cast("long"))
    top, _ = rows_per_key(units, keys)  # bounds the units of any run and of any file, too
    if unit_files is not None:
        shared = shared_at(unit_files.withColumn(TURN, F.col(TURN).cast("long")), keys, limit, top)
        units = units.join(shared, [*keys, TURN], "left")
    else:
        units = units.withColumn("shared_at", F.lit(None).cast("long"))
    has_files = F.col("shared_at").isNotNull()
    branch = C.blank_to_null(F.col("git_branch"))
    step = running(units, keys, [TURN], {
        "prev": latest_before(F.struct(branch.alias("branch"),
                                       F.coalesce("interrupted", F.lit(False)).alias("cut"))),
        "files_at": latest_before(F.when(has_files, F.col(TURN))),
    }, limit=limit, ordinal=TURN, top=top)
    plain = (F.when(F.col("prev").isNull(), "session_start")
             .when(F.coalesce("gap_ms_before", F.lit(0)) > gap_ms, "turn_gap")
             .when(F.coalesce(branch != F.col("prev.branch"), F.lit(False)), "branch_change"))
    step = (step.withColumn("plain", plain).withColumn("cut_before", F.col("prev.cut"))
            .withColumn("hard", F.col("plain").isNotNull() | F.col("cut_before")))
    if unit_files is not None:
        step = running(step, keys, [TURN], {"run_start": latest(F.when(F.col("hard"), F.col(TURN)))},
                       limit=limit, ordinal=TURN, top=top)
        candidates = step.where(
            ~F.col("hard") & has_files & (F.col("files_at") >= F.col("run_start"))
            & (F.col("shared_at") < F.col("files_at")))
        jumps = file_jumps(candidates, keys, limit, top).select(
            *keys, TURN, F.lit(True).alias("jumped"))
        step = step.join(jumps, [*keys, TURN], "left")
    else:
        step = step.withColumn("jumped", F.lit(None).cast("boolean"))
    step = step.withColumn("opens", F.col("hard") | F.coalesce("jumped", F.lit(False)))
    step = running(step, keys, [TURN], {
        "segment_no": running_sum(F.col("opens").cast("int")),
        "left_start": latest_before(F.when(F.col("opens"), F.col(TURN))),
    }, limit=limit, ordinal=TURN, top=top)
    # at an interrupt the label still names a file jump if one fires as well
    jump_at_cut = (has_files & (F.col("files_at") >= F.col("left_start"))
                   & (F.col("shared_at") < F.col("left_start")))
    label = (F.when(F.col("plain").isNotNull(), F.col("plain"))
             .when(F.coalesce("jumped", F.lit(False)) | (F.col("hard") & jump_at_cut),
                   "file_set_jump")
             .when(F.col("hard"), "interrupt"))
    return (step.withColumn("opened_by", label)
            .withColumn("segment_no", (F.col("segment_no") - 1).cast("long"))
            .drop("shared_at", "prev", "files_at", "plain", "cut_before", "hard", "run_start",
                  "jumped", "opens", "left_start"))


def segments(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """One row per segment."""
    return assigned.groupBy(*keys, "segment_no").agg(
        F.min(TURN).alias("start_turn"), F.max(TURN).alias("end_turn"),
        F.min_by("started_at", TURN).alias("started_at"),
        F.max_by(F.coalesce("window_ended_at", "started_at"), F.col(TURN)).alias("ended_at"),
        F.min_by("opened_by", TURN).alias("opened_by"), F.count("*").alias("n_units"))


def gap_sessions(events: DataFrame, key: str, at: str, tie: str, gap_ms: int,
                 limit: int = ROWS_PER_BLOCK) -> DataFrame:
    """Runs of one key's events without an idle gap above the limit.

    The batch form of a session window. Being two ordered scans, it also holds
    for a key with more events than a task should sort.
    """
    top, _ = rows_per_key(events, [key])
    slim = events.select(key, at, tie)
    step = running(slim, [key], [at, tie], {"before": latest_before(F.col(at))}, limit=limit, top=top)
    idle = F.unix_micros(at) - F.unix_micros("before")
    opens = F.col("before").isNull() | (idle > gap_ms * 1000)
    runs = running(step.withColumn("opens", opens), [key], [at, tie],
                   {"run": running_sum(F.col("opens").cast("int"))}, limit=limit, top=top)
    return runs.groupBy(key, "run").agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).drop("run")


def segment_id(session_id, segment_no):
    return F.concat(F.substring(session_id, 1, 8), F.lit("-seg"), segment_no.cast("string"))
