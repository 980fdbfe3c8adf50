"""All five boundary rules of segments over units as they arrive, in any order.

The turns of a session are numbered without gaps, so a unit is placed once its
predecessor is, and waits in state until then; no watermark is needed, and a
session may pause for as long as it likes. State of a session:

- its place: next turn, branch and interrupt of the last unit, segment number, the turn
  that opened the segment and the last turn with files;
- per file and directory the last turn that touched it. A unit jumps out of its
  segment if none of its own was touched since the segment began, so one number a
  file is all that is kept. These go after ``KEEP`` without use; a pause of that
  length opens a segment by itself, so none of them would have counted;
- units that wait. Should a predecessor never come, a timer places what waits in order.

The place has no time limit: numbering goes on where it stopped, after any pause.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

#: State keyed by files needs this store; it is set for the session when such a stream is built.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = "next_turn long, branch string, cut boolean, segment_no long, opened_at long, files_at long"
UNIT = "gap_ms_before long, git_branch string, interrupted boolean, file_refs array<string>, dir_refs array<string>"
FIELDS = ["gap_ms_before", "git_branch", "interrupted", "file_refs", "dir_refs"]
LABELLED = "session_id string, turn_index long, segment_no long, opened_by string"
DAY_MS = 86_400_000
KEEP = DAY_MS
PATIENCE = 7 * DAY_MS


def opened_by(gap: int, branch: str | None, tokens: list[str], place: tuple, touched: dict[str, int], gap_ms: int) -> str | None:
    """The boundary before a unit, by precedence; None inside a segment."""
    turn, before, cut, _, opened_at, files_at = place
    if turn == 0:
        return "session_start"
    if gap > gap_ms:
        return "turn_gap"
    if branch and before and branch != before:
        return "branch_change"
    if tokens and files_at >= opened_at and max(touched.get(t, -1) for t in tokens) < opened_at:
        return "file_set_jump"
    return "interrupt" if cut else None


def tokens_of(unit: tuple) -> list[str]:
    """Names of a unit's files and directories, apart from each other."""
    return [f"f:{f}" for f in unit[3]] + [f"d:{d}" for d in unit[4]]


class Segmenter(StatefulProcessor):
    def __init__(self, gap_ms: int, keep_ms: int, patience_ms: int):
        self.gap_ms, self.keep_ms, self.patience_ms = gap_ms, keep_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.touched = handle.getMapState("touched", "token string", "turn long", self.keep_ms)
        self.waiting = handle.getMapState("waiting", "turn long", UNIT)

    def placed(self, key: tuple, units: dict[int, tuple], skip: bool) -> tuple[pd.DataFrame, set[int]]:
        """Labels of the units that are next, and their turns; with ``skip`` those beyond a gap are next, too."""
        place = tuple(self.place.get()) if self.place.exists() else (0, None, False, -1, 0, -1)
        ready, at = [], place[0]
        for turn in sorted(units):
            if turn < at:
                continue
            if turn > at and not skip:
                break
            ready.append(turn)
            at = turn + 1
        asked = {t for turn in ready for t in tokens_of(units[turn])}
        touched = {t: self.touched.getValue((t,))[0] for t in asked if self.touched.containsKey((t,))}
        out = []
        for turn in ready:
            gap, branch, cut, *_ = unit = units[turn]
            tokens = tokens_of(unit)
            place = (turn, *place[1:]) if place[3] >= 0 else place
            label = opened_by(gap or 0, branch, tokens, place, touched, self.gap_ms)
            number, opened_at, files_at = place[3:]
            if label:
                number, opened_at = number + 1, turn
            touched.update((t, turn) for t in tokens)
            place = (turn + 1, branch, bool(cut), number, opened_at, turn if tokens else files_at)
            out.append((key[0], turn, number, label))
        if ready:
            self.place.update(place)
            for token in asked:
                self.touched.updateValue((token,), (touched[token],))
        return pd.DataFrame(out, columns=["session_id", "turn_index", "segment_no", "opened_by"]), set(ready)

    def take(self, key: tuple, units: dict[int, tuple], skip: bool, now: int) -> Iterator[pd.DataFrame]:
        held = {turn[0]: tuple(unit) for turn, unit in self.waiting.iterator()} if self.waiting.exists() else {}
        out, ready = self.placed(key, held | units, skip)
        for turn in ready & held.keys():
            self.waiting.removeKey((turn,))
        done = self.place.get()[0] if self.place.exists() else 0
        fresh = {turn: unit for turn, unit in units.items() if turn not in ready and turn >= done}
        for turn, unit in fresh.items():
            self.waiting.updateValue((turn,), unit)
        if fresh:
            self.handle.registerTimer(now + self.patience_ms)
        if len(out):
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        units = {}
        for frame in rows:
            columns = [frame["turn_index"].tolist(), *(frame[c].astype(object).where(frame[c].notna(), None).tolist()
                                                       for c in FIELDS[:3]),
                       *([list(v) if v is not None else [] for v in frame[c]] for c in FIELDS[3:])]
            for turn, gap, branch, cut, files, dirs in zip(*columns):
                units[int(turn)] = (int(gap) if gap is not None else None, branch or None, bool(cut), files, dirs)
        yield from self.take(key, units, False, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.take(key, {}, True, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def segments(units: DataFrame, gap_ms: int = fixed.TURN_GAP_MS, keep_ms: int = KEEP,
             patience_ms: int = PATIENCE) -> DataFrame:
    """session_id, turn_index, segment_no and opened_by of a stream of units.

    ``units``: session_id, turn_index, gap_ms_before, git_branch, interrupted, file_refs
    and dir_refs. A turn that was placed already is ignored when it comes again.
    """
    units.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return units.select("session_id", "turn_index", *FIELDS).groupBy("session_id").transformWithStateInPandas(
        Segmenter(gap_ms, keep_ms, patience_ms), LABELLED, "append", "ProcessingTime")
