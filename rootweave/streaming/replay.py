"""Structured Streaming forms of replay.

`live_depths` keeps one integer for each run and needs its events in order. `live_ordered_depths` takes them in any order: events that
are ahead wait in the state until those before them have come or the watermark says that they will not, and runs that are silent are forgotten.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rootweave.sources.recordings import _TYPES

EVENTS = "run_id string, seq long, type string, function string, filename string"
DEPTHS = "run_id string, seq long, type string, stack_depth long"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines event files as they appear in a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def live_depths(events: DataFrame) -> DataFrame:
    """stack_depth before each event takes effect, never below zero."""

    def advance(key, frames, state):
        depth = state.get[0] if state.exists else 0
        frame = pd.concat(list(frames)).sort_values("seq")
        depths = []
        for kind in frame["type"]:
            depths.append(depth)
            depth = max(0, depth + (kind == "call") - (kind == "return"))
        state.update((depth,))
        yield pd.DataFrame({"run_id": frame["run_id"], "seq": frame["seq"], "type": frame["type"], "stack_depth": depths})

    valid = events.filter(events["type"].isin(*_TYPES))
    return valid.groupBy("run_id").applyInPandasWithState(advance, DEPTHS, "depth long", "append", "NoTimeout")


def live_counts(events: DataFrame) -> DataFrame:
    """Running counts by run and type (complete or update mode)."""
    return events.groupBy("run_id", "type").count()


TIMED = f"{EVENTS}, at timestamp"


class Reorder(StatefulProcessor):
    """Events of a run in the order of `seq`, with the depth before each.

    State: the next place, the depth and the latest time of the run, and the events that wait for an earlier one. An event waits
    until all before it are out, or until the watermark has passed its own time: what is still missing then is lost, and what
    comes for a place that was passed is dropped. So the wait, and with it the state, is bounded by the watermark's delay. A timer brings out what
    waits in a run that gets no more events, and forgets the run `idle_ms` after its latest event.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, depth long, latest long")
        self.waiting = handle.getMapState("waiting", "seq long", "type string, at long")

    def handleInputRows(self, key, rows, timerValues):
        new = {}
        for frame in rows:
            at = frame["at"].astype("datetime64[ms]").astype("int64")
            new |= {int(s): (k, int(t)) for s, k, t in zip(frame["seq"], frame["type"], at, strict=True)}
        return self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._advance(key, {}, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, new: dict, watermark: int):
        place, depth, latest = self.place.get() if self.place.exists() else (0, 0, 0)
        latest = max([latest, *(at for _, at in new.values())])
        held = {k[0]: tuple(v) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        ahead = held | {s: v for s, v in new.items() if s >= place}
        given_up = max([place - 1, *(s for s, (_, at) in ahead.items() if at <= watermark)])
        rows = []
        for seq in sorted(ahead):
            if seq > max(place, given_up):
                break
            kind, _ = ahead.pop(seq)
            rows.append((key[0], seq, kind, depth))
            depth = max(0, depth + (kind == "call") - (kind == "return"))
            place = seq + 1
        for seq in held.keys() - ahead.keys():
            self.waiting.removeKey((seq,))
        for seq in ahead.keys() - held.keys():
            self.waiting.updateValue((seq,), ahead[seq])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not ahead and watermark >= latest + self.idle_ms:
            self.place.clear()
        else:
            self.place.update((place, depth, latest))
            due = max(at for _, at in ahead.values()) if ahead else latest + self.idle_ms
            self.handle.registerTimer(max(due, watermark) + 1)
        yield pd.DataFrame(rows, columns=["run_id", "seq", "type", "stack_depth"])

    def close(self) -> None:
        pass


def live_ordered_depths(events: DataFrame, delay: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """live_depths of events(run_id, seq, type, at) that arrive in any order, at most `delay` late.

    The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass), which keeps waiting events on disk.
    """
    valid = events.filter(F.col("type").isin(*_TYPES)).select("run_id", "seq", "type", "at").withWatermark("at", delay)
    return valid.groupBy("run_id").transformWithStateInPandas(Reorder(idle_ms), DEPTHS, "Append", "EventTime")
