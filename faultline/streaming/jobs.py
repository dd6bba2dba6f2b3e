"""Continuous forms: windowed metrics, dedup, stateful alerting, silence, journal folds, enrichment.

Inputs are streaming frames with ``event_ts`` (timestamp). Every function returns
a streaming frame; :func:`run_available` drains one to files and reads it back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline.functions.expr import is_error
from faultline.session import scratch_path

DELAY = "60 seconds"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, label: str, timers: bool = False) -> DataFrame:
    """Process everything available now into a parquet folder on shared storage."""
    spark = stream.sparkSession
    out = drain(stream, label, timers)
    return spark.read.schema(stream.schema).parquet(out)


def drain(stream: DataFrame, label: str, timers: bool = False) -> str:
    """The folder that :func:`run_available` writes; another stream may read it.

    ``timers``: the query keeps state with timers, which needs the RocksDB state store.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-state")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    if timers:
        spark.conf.set(setting, ROCKS)
    try:  # a query takes the setting when it starts
        job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
    job.awaitTermination()
    return out


def windowed_red(spans: DataFrame, window: str = "3 minutes", slide: str = "15 seconds", delay: str = DELAY, k: int = 400) -> DataFrame:
    """Requests, error rate, p95 estimate and peak duration per service and sliding window.

    Every span is counted once, in the pane of one slide that holds it; a window merges
    its panes. p95 comes from mergeable KLL sketches: exact up to ``k`` spans a window,
    beyond that within about 1.7 / k**0.9 of the rank (0.8 % at 400).
    """
    panes = spans.withWatermark("event_ts", delay).groupBy("incident_id", "service", F.window("event_ts", slide).alias("pane")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("failed"), F.max("duration_ms").alias("top"),
        F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), k).alias("sketch"))
    grouped = panes.groupBy("incident_id", "service", F.window(F.window_time("pane"), window, slide).alias("w"))
    return grouped.agg(
        F.sum("n").alias("requests"), (F.sum("failed") / F.sum("n")).alias("error_rate"),
        F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("sketch", k), F.lit(0.95)).alias("p95_ms"), F.max("top").alias("max_ms"),
    ).select("incident_id", "service", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "error_rate", "p95_ms", "max_ms")


def level_counts(logs: DataFrame, bucket: str = "60 seconds", delay: str = DELAY) -> DataFrame:
    grouped = logs.withWatermark("event_ts", delay).groupBy("incident_id", F.window("event_ts", bucket).alias("w"), F.lower("severity").alias("level"))
    return grouped.agg(F.count(F.lit(1)).alias("count")).select("incident_id", F.col("w.start").alias("window_start"), "level", "count")


def dedup_spans(spans: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row per span id among copies that arrive within the watermark."""
    return spans.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["incident_id", "span_id"])


# ---- alerting with a hold time ------------------------------------------------------------

_COMPARE = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t}


def _watch(idle_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Advance one rule over new samples; state is the open run and whether it fired."""
        start, value, fired = state.get if state.exists else (None, None, False)
        out = []
        if state.hasTimedOut:
            start, fired = None, False
        else:
            # One sample per step after the windowed maximum, so a batch is small.
            samples = pd.concat(list(batches)).sort_values("ts")
            for row in samples.itertuples(index=False):
                finite = row.value is not None and abs(row.value) != float("inf") and row.value == row.value
                if finite and _COMPARE[row.comparison](row.value, row.threshold):
                    if start is None:
                        start, value = row.ts, row.value
                    if not fired and row.ts - start >= row.for_seconds:
                        fired = True
                        out.append((key[0], key[1], int(start), float(value)))
                else:
                    start = value = None
        if start is None and not fired:
            state.remove()
        else:
            state.update((start, value, fired))
            state.setTimeoutTimestamp(max(int(samples["ts"].max()) * 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["incident_id", "rule_id", "fired_epoch", "value"])

    return step


def step_maxima(points: DataFrame, step: str = "15 seconds", delay: str = DELAY) -> DataFrame:
    """Largest value per incident, metric and step: one sample per step whatever the traffic.

    ``points``: incident_id, metric, event_ts, value. Feeds :func:`sustained_alerts`
    through storage, since a stateful Python step cannot follow an aggregation in
    one query.
    """
    grouped = points.withWatermark("event_ts", delay).groupBy("incident_id", "metric", F.window("event_ts", step).alias("w"))
    return grouped.agg(F.max("value").alias("value")).select("incident_id", "metric", F.col("w.start").cast("long").alias("ts"), "value")


def sustained_alerts(samples: DataFrame, rules: DataFrame, delay: str = DELAY, idle_seconds: int = 30 * 86400) -> DataFrame:
    """First firing per incident and rule, as :func:`faultline.operators.alerts.sustained_breaches`.

    ``samples``: the stream of :func:`step_maxima`. ``rules`` is a static frame. State is
    held for open runs and fired rules only, and given up once an incident has sent
    nothing for ``idle_seconds``; one that resumes after that may fire again.
    """
    timed = samples.withColumn("event_ts", F.timestamp_seconds("ts")).withWatermark("event_ts", delay)
    joined = timed.join(rules.select("rule_id", "metric", "threshold", "comparison", "for_seconds"), "metric").select(
        "incident_id", "rule_id", "ts", "value", "threshold", "comparison", "for_seconds", "event_ts")
    return joined.groupBy("incident_id", "rule_id").applyInPandasWithState(
        _watch(idle_seconds * 1000), "incident_id string, rule_id int, fired_epoch long, value double", "start long, value double, fired boolean",
        "append", GroupStateTimeout.EventTimeTimeout)


def activity_sessions(spans: DataFrame, gap: str = "60 seconds", delay: str = DELAY) -> DataFrame:
    """Closed runs of emission per service; a run is emitted once the service has been silent for ``gap``."""
    grouped = spans.withWatermark("event_ts", delay).groupBy("incident_id", "service", F.session_window("event_ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("spans"), F.max("event_ts").alias("last_seen")).select(
        "incident_id", "service", F.col("w.start").alias("active_from"), "last_seen", "spans")


# ---- journal fold -------------------------------------------------------------------------

# fixed values: event kind to the states it is legal in and the state it leads to
TRANSITIONS = {
    "posted": (("proposed",), "posted"), "approved": (("proposed", "posted"), "approved"), "denied": (("proposed", "posted"), "denied"),
    "expired": (("proposed", "posted", "approved"), "expired"), "execute_started": (("approved",), "executing"),
}
_OPEN = ("proposed", "posted", "approved")
_CLOSED = ("denied", "expired", "done", "failed")


def _fold(ttl_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seq, due = state.get if state.exists else (None, -1, None)
        out = []
        if state.hasTimedOut and status in _OPEN:
            status = "expired"
            out.append((key[0], seq, status))
        for row in () if state.hasTimedOut else pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            at = int(row.event_ts.timestamp() * 1000)
            if due is not None and status in _OPEN and at > due:  # the event outran the timer
                status = "expired"
                out.append((key[0], seq, status))
            new = None
            if row.kind == "proposed":
                new, due = "proposed", None if ttl_ms is None else at + ttl_ms
            elif row.kind == "execute_result" and status == "executing":
                new = "done" if row.ok else "failed"
            elif row.kind in TRANSITIONS and status in TRANSITIONS[row.kind][0]:
                new = TRANSITIONS[row.kind][1]
            if new is not None:
                status, seq = new, int(row.seq)
                out.append((key[0], seq, status))
        if status in _CLOSED:  # nothing but a new proposal can follow, which starts afresh
            state.remove()
        elif status is not None:
            state.update((status, seq, due))
            if due is not None and status in _OPEN:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["action_id", "seq", "status"])

    return step


def journal_transitions(events: DataFrame, ttl_seconds: int | None = None, delay: str = DELAY) -> DataFrame:
    """Legal transitions of every action as they happen; open proposals expire after the TTL.

    ``events``: action_id, seq, kind, ok, event_ts. The current state of an action
    is its last transition. State is held until an action is denied, expired, done or
    failed.
    """
    ttl = None if ttl_seconds is None else ttl_seconds * 1000
    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    return events.withWatermark("event_ts", delay).groupBy("action_id").applyInPandasWithState(
        _fold(ttl), "action_id string, seq long, status string", "status string, seq long, due long", "append", timeout)


def enrich_logs(logs: DataFrame, spans: DataFrame, within: str = "5 minutes", delay: str = DELAY) -> DataFrame:
    """Log lines joined to the spans of their trace that started at most ``within`` earlier."""
    l = logs.withWatermark("event_ts", delay).select("incident_id", "trace_id", F.col("event_ts").alias("log_ts"), "severity", "message")
    s = spans.withWatermark("event_ts", delay).select(
        F.col("incident_id").alias("s_incident"), F.col("trace_id").alias("s_trace"), F.col("event_ts").alias("span_ts"), "span_id", "service")
    near = (F.col("log_ts") >= F.col("span_ts")) & (F.col("log_ts") <= F.col("span_ts") + F.expr(f"interval {within}"))
    joined = l.join(s, (F.col("incident_id") == F.col("s_incident")) & (F.col("trace_id") == F.col("s_trace")) & near)
    return joined.drop("s_incident", "s_trace")
