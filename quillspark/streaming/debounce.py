"""Debouncing with timers: a burst comes out after a silence, without a later event.

State is kept by root: one row for each path with a pending event, and the burst's clock.
A burst ends when the root's next event is more than the gap later by its own time, when no
event has come for the gap by the clock of the machines, or when its first event has waited
for the longest wait. Events of one micro-batch are taken in the order of (ts, seq); one that
comes late joins the burst that is open. Bursts of events that come in order are those of
``watch.debounce``.

Defined results: events without a path or a time are left out, those without a root share
one; equal (ts, seq) of one path go by the event's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "root string, burst_start timestamp, path string, event_type string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debouncer(StatefulProcessor):
    def __init__(self, gap_ms: int, longest_ms: int):
        self.gap, self.longest = gap_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "event_type string, us long, seq long")
        #: First and last time of its events, when the first came, and when its timer is due.
        self.burst = handle.getValueState("burst", "start long, last long, came long, due long")

    def _flush(self, root):
        start = self.burst.get()[0]
        rows = [Row(root=root, us=start, path=k[0], event_type=v[0]) for k, v in self.paths.iterator()]
        self.paths.clear()
        self.burst.clear()
        return rows

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.burst.get() if self.burst.exists() else None
        due_before = held[3] if held else None
        for r in sorted(rows, key=lambda r: (r.us, r.seq, r.event_type)):
            held = self.burst.get() if self.burst.exists() else None
            if held and r.us > held[1] + self.gap * 1000:
                yield from self._flush(key[0])
                held = None
            old = self.paths.getValue((r.path,)) if held and self.paths.containsKey((r.path,)) else None
            if old is None or (old[1], old[2]) <= (r.us, r.seq):
                self.paths.updateValue((r.path,), (r.event_type, r.us, r.seq))
            start, last, came, _ = held or (r.us, r.us, now, 0)
            self.burst.update((min(start, r.us), max(last, r.us), came, min(now + self.gap, came + self.longest)))
        due = self.burst.get()[3] if self.burst.exists() else None
        if due_before is not None and due_before != due:
            self.handle.deleteTimer(due_before)
        if due is not None and due != due_before:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.burst.exists() and self.burst.get()[3] <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._flush(key[0])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, gap_ms: int, longest_ms: int) -> DataFrame:
    """(root, burst_start, path, event_type) of a stream of events (root, path, event_type, ts, seq).

    The session must keep state in ``PROVIDER`` when the stream starts.
    """
    rows = events.where("path is not null and ts is not null").select("root", "path", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    out = rows.groupBy("root").transformWithState(Debouncer(gap_ms, longest_ms), "root string, us long, path string, event_type string", "Append", "ProcessingTime")
    return out.select("root", F.timestamp_micros("us").alias("burst_start"), "path", "event_type")
