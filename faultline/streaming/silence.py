"""Silence of a service, told while it still lasts: keyed state with event-time timers.

Spans are reduced to panes first (first and last span of each), so the state step sees a
few rows per service and batch whatever the traffic. It follows the aggregation in the
same query; nothing is stored between. A service's state is the time of its last span. A
timer at that time plus the allowed gap tells a silence as soon as the watermark passes
it; the next pane, if one comes, tells when it ended. State of services that stay away is
given up after a longer time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.streaming.jobs import DELAY

SILENCE = "incident_id string, service string, silent_since long, resumed_at long"


class _Watch(StatefulProcessor):
    """State: last span seen (microseconds), and whether its silence has been told."""

    def __init__(self, gap_ms: int, forget_ms: int) -> None:
        self.gap_ms, self.forget_ms = gap_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        panes = pd.concat(list(rows)).sort_values("first")
        last = self.seen.get()[0] if self.seen.exists() else None
        ended = []
        for pane in panes.itertuples(index=False):
            if last is not None and pane.first - last > self.gap_ms * 1000:
                ended.append((key[0], key[1], last, int(pane.first)))
            last = int(pane.last) if last is None else max(last, int(pane.last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((last, False))
        self.handle.registerTimer(last // 1000 + self.gap_ms)
        yield pd.DataFrame(ended, columns=["incident_id", "service", "silent_since", "resumed_at"]).astype({"silent_since": "Int64", "resumed_at": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        last, told = self.seen.get()
        if told:  # silent for so long that nobody waits for it
            self.seen.clear()
            return
        self.seen.update((last, True))
        self.handle.registerTimer(last // 1000 + self.forget_ms)
        yield pd.DataFrame({"incident_id": [key[0]], "service": [key[1]], "silent_since": pd.array([last], "Int64"), "resumed_at": pd.array([None], "Int64")})

    def close(self) -> None:
        pass


def silences(spans: DataFrame, gap_seconds: int = 60, pane: str = "15 seconds", delay: str = DELAY, forget_seconds: int = 30 * 86400) -> DataFrame:
    """Stretches of more than ``gap_seconds`` without a span of a service, in microseconds of event time.

    A row with a null ``resumed_at`` comes while the silence lasts, one with a time when
    it has ended; a silence that ends within one batch has the second row only. Needs the
    RocksDB state store (``drain(..., timers=True)`` sets it for the query). A gap must
    not be shorter than a pane. State goes ``forget_seconds`` after the last span.
    """
    timed = spans.withWatermark("event_ts", delay)
    panes = timed.groupBy("incident_id", "service", F.window("event_ts", pane).alias("w")).agg(
        F.unix_micros(F.min("event_ts")).alias("first"), F.unix_micros(F.max("event_ts")).alias("last"))
    rows = panes.select("incident_id", "service", F.window_time("w").alias("event_ts"), "first", "last")
    return rows.groupBy("incident_id", "service").transformWithStateInPandas(
        statefulProcessor=_Watch(gap_seconds * 1000, max(forget_seconds, 2 * gap_seconds) * 1000), outputStructType=SILENCE, outputMode="append", timeMode="eventtime")
