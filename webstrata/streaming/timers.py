"""Retry timers of captures: event-time timers with state, and a budget of attempts and time without progress.

Events of a capture may come in any order within the watermark's delay. They wait in the state until the watermark has passed
them, then they are taken in order of time. A failure sets a timer; when it fires before another event has come, the next attempt
is given out. An event at the timer's own time still comes first. A success clears everything. When ``limit`` failures have
come one after the other, or ``seconds`` have gone by since the first of them, the budget is spent: one end is given out, and nothing
more until a success. A waiting timer beyond the budget's time becomes that end.

State is kept by group of captures, as each call between Python and the state costs more than an event: events that wait, in columns
(bounded by the delay), a row for each capture with failures, and one timer at the earliest moment that concerns one of the group.
Rows later than the watermark are dropped by Spark. Null ids form one capture; events with a null time or kind are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EVENTS = ("capture", "at", "number", "failed")
_OUT = "capture_id long, kind string, attempts int, at long"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which timers need; the session's own choice comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def delay_micros(capture: int, attempts: int, base: float, most: float) -> int:
    """Microseconds to wait after so many failures; captures are spread by their id."""
    return int(min(most, base * 2.0 ** min(12, attempts - 1)) * (0.9 + (capture % 17) / 85) * 1_000_000)


class RetryTimers(StatefulProcessor):
    def __init__(self, base: float, most: float, limit: int, seconds: float):
        self.base, self.most, self.limit, self.span = base, most, limit, int(seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "capture array<long>, at array<long>, number array<long>, failed array<boolean>")
        self.now = handle.getValueState("now", "capture array<long>, attempts array<int>, first array<long>, due array<long>, ended array<boolean>")
        self.timer = handle.getValueState("timer", "held long")

    def _have_timer(self, held: int | None, at: int | None, fired: int | None = None) -> None:
        """Have one timer at ``at`` (microseconds), rounded up to milliseconds, in place of the one held; one that has fired is gone."""
        wanted = None if at is None else -(-at // 1000)
        if held == wanted:
            return
        if held is not None and held != fired:
            self.handle.deleteTimer(held)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def _held(self) -> int | None:
        state = self.timer.get()
        return state[0] if state else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[part["kept"].astype(bool)]
            if len(part):
                self.waiting.appendValue(tuple(part[c].tolist() for c in _EVENTS))
                earliest = int(part["at"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            held = self._held()
            if held is None or first < held * 1000:
                self._have_timer(held, first)
        yield from ()

    def _taken(self, capture: int, state: tuple, events, passed: int) -> tuple[tuple, list]:
        """A capture's state (attempts, first, due, ended) after its events (time, failed) in order, and what is given out by ``passed``."""
        attempts, begun, due, ended = state
        out = []

        def until(limit: int, also: bool) -> None:
            """What the waiting timer gives out before ``limit`` (also: or at it)."""
            nonlocal due, ended
            if due is None:
                return
            stop = begun + self.span
            at = min(due, stop)
            if at < limit or also and at == limit:
                ended = ended or due >= stop
                out.append((capture, "end" if due >= stop else "attempt", attempts, at))
                due = None

        for at, failed in events:
            until(at, False)
            if not failed:
                attempts, begun, due, ended = 0, None, None, False
            elif not ended:
                attempts, begun = attempts + 1, at if begun is None else begun
                if attempts >= self.limit or at - begun >= self.span:
                    ended, due = True, None
                    out.append((capture, "end", attempts, at))
                else:
                    due = at + delay_micros(capture, attempts, self.base, self.most)
        until(passed, True)
        return (attempts, begun, due, ended), out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.now.get()
        states = {c: tuple(s) for c, *s in zip(*kept, strict=True)} if kept else {}
        parts = list(self.waiting.get()) if self.waiting.exists() else []
        capture, at, number, failed = (np.concatenate([np.asarray(p[k]) for p in parts]) if parts else np.array([], int) for k in range(len(_EVENTS)))
        order = np.lexsort((failed, number, at, capture))
        order, later = order[at[order] <= passed], order[at[order] > passed]
        own, starts, sizes = (a.tolist() for a in np.unique(capture[order], return_index=True, return_counts=True))
        events = list(zip(at[order].tolist(), failed[order].tolist(), strict=True))
        out = []
        for c, low, size in zip(own, starts, sizes, strict=True):
            states[c], made = self._taken(c, states.get(c, (0, None, None, False)), events[low : low + size], passed)
            out += made
        for c, state in states.items():  # those without new events whose timers fire
            if state[2] is not None and min(state[2], state[1] + self.span) <= passed:
                states[c], made = self._taken(c, state, (), passed)
                out += made
        states = {c: s for c, s in states.items() if s[0]}
        if len(later):
            self.waiting.put([tuple(column[later].tolist() for column in (capture, at, number, failed))])
        elif parts:
            self.waiting.clear()
        if states:
            self.now.update(([*states], *([s[k] for s in states.values()] for k in range(4))))
        elif kept:
            self.now.clear()
        due = [min(s[2], s[1] + self.span) for s in states.values() if s[2] is not None]
        self._have_timer(self._held(), min(due + ([int(at[later].min())] if len(later) else []), default=None), expiredTimerInfo.getExpiryTimeInMs())
        if out:
            ids = [None if key[0] < 0 else o[0] for o in out]
            yield pd.DataFrame({"capture_id": pd.array(ids, "Int64"), "kind": [o[1] for o in out], "attempts": pd.array([o[2] for o in out], "int32"), "at": [o[3] for o in out]})

    def close(self) -> None:
        pass


def retry_timers(
    events: DataFrame, *, id_col="user_id", time_col="ts", order_col="event_id", failed=None, late: str = "1 day", base: float = 30, most: float = 3600, limit: int = 5, seconds: float = 300, groups: int = 4096
) -> DataFrame:
    """(capture_id, kind, attempts, at): ``attempt`` when a capture's timer fires, ``end`` when its budget is spent. ``failed``: a column.

    ``groups``: captures are dealt to so many groups by hash (null ids to one of their own), whose state is read and written as one; a
    stream keeps the number that it was started with.
    """
    failed = F.col("event_type") == "error" if failed is None else failed
    capture, at = F.col(id_col).cast("long"), F.unix_micros(time_col)
    rows = events.withWatermark(time_col, late).select(  # rows without a kind still move the watermark, so they are left out later
        F.when(capture.isNull(), -1).otherwise(F.pmod(F.xxhash64(capture), F.lit(groups))).alias("group"),
        F.coalesce(capture, F.lit(0)).alias("capture"), F.coalesce(at, F.lit(0)).alias("at"), F.coalesce(order_col, F.lit(0)).alias("number"), F.coalesce(failed, F.lit(False)).alias("failed"),
        (at.isNotNull() & failed.isNotNull()).alias("kept"), F.col(time_col).alias("ts"),
    )
    out = rows.groupBy("group").transformWithStateInPandas(RetryTimers(base, most, limit, seconds), _OUT, "append", "eventTime")
    return out.withColumn("at", F.timestamp_micros("at"))
