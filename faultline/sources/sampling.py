"""Caps on telemetry volume that keep what matters: errors, whole traces, even coverage.

These operators sample because a cap is asked for; nothing else in the package
drops rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.ordered import null_safe_join, ordered_index, top_per_group
from faultline.session import store


def priority_downsample(rows: DataFrame, priority: Column, cap: int, order: Sequence[str | Column], time: str = "time") -> DataFrame:
    """At most ``cap`` rows per incident: priority rows first, then evenly spaced others.

    ``order`` ranks rows within a second. Positions come from counts per range
    part, so a large incident, or a second of it, is never sorted in one task. Row j of the rest is
    taken when some i has floor(i * step) = j.
    """
    keys = ["incident_id", "_pri"]
    tagged = rows.withColumn("_pri", F.coalesce(priority, F.lit(False)))
    sizes = tagged.groupBy("incident_id").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_pri").alias("_top"))
    placed = null_safe_join(ordered_index(tagged, keys, [time, *order], "_i"), sizes, ["incident_id"])
    room = F.lit(cap) - F.col("_top")
    rest = F.col("_all") - F.col("_top")
    step = rest / F.nullif(room.cast("double"), F.lit(0.0))
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = F.ceil(F.col("_i") / step) + shift
        hit = hit | ((i >= 0) & (i < room) & (F.least(rest - 1, F.floor(i * step)) == F.col("_i")))
    kept = (F.col("_all") <= cap) | F.when(F.col("_top") >= cap, F.col("_pri") & (F.col("_i") < cap)).otherwise(F.col("_pri") | F.coalesce(hit, F.lit(False)))
    return placed.where(kept).select(*rows.columns)


def _fill(traces: Column, cap: int) -> Column:
    """Where a greedy fill over sorted (calm, trace_id, size) begins to refuse: cuts (i, size) in order.

    Room only shrinks, so once a size is refused at trace i every trace after it of that
    size or more is refused too. The cuts are as few as the distinct sizes, and the fold
    carries them instead of the traces taken.
    """
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).cast("long").alias("used"), F.lit(2**62).alias("limit"),
        F.array().cast("array<struct<i:int,size:bigint>>").alias("cuts"))

    def step(acc: Column, trace: Column) -> Column:
        size = trace["size"]
        taken = (acc["used"] == 0) | (acc["used"] + size <= cap)
        cut = ~taken & (size < acc["limit"])
        return F.struct(
            (acc["i"] + 1).alias("i"), (acc["used"] + F.when(taken, size).otherwise(0)).alias("used"), F.when(cut, size).otherwise(acc["limit"]).alias("limit"),
            F.when(cut, F.concat(acc["cuts"], F.array(F.struct(acc["i"].alias("i"), size.alias("size"))))).otherwise(acc["cuts"]).alias("cuts"))

    return F.aggregate(traces, start, step, lambda acc: acc["cuts"])


def whole_trace_sample(spans: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` spans per incident as whole traces, failing traces first.

    A trace that would overflow is skipped and later smaller ones may still fit;
    the first trace is always taken. Of the traces with n spans only the first
    cap / n in order can ever be taken, so at most about cap * ln(cap) traces per
    incident reach the sequential fill, however many there are. A span without a status
    does not make its trace failing; spans without a trace id are one trace, the first in
    order, and a null incident is an incident like any other.
    """
    failed = F.coalesce(~F.upper("status").isin("OK", "UNSET"), F.lit(False))
    keys = ["incident_id", "trace_id"]
    traces = store(spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), (~F.max(failed)).cast("int").alias("calm")), "traces")
    totals = traces.groupBy("incident_id").agg(F.sum("size").alias("_all"), F.min(F.struct("calm", "trace_id")).alias("_first"))
    crowded = null_safe_join(traces, totals, ["incident_id"])
    first = F.struct("calm", "trace_id").eqNullSafe(F.col("_first"))
    fits = crowded.where((F.col("_all") > cap) & ((F.col("size") <= cap) | first))
    quota = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("size")))
    bounded = top_per_group(fits, ["incident_id", "size"], [F.col("calm"), F.col("trace_id")], quota)
    listed = bounded.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("calm", "trace_id", "size"))).alias("_t"))
    judged = listed.withColumn("_cuts", _fill(F.col("_t"), cap)).select("incident_id", "_cuts", F.posexplode("_t").alias("_i", "_x"))
    refused = F.exists("_cuts", lambda c: (c["i"] <= F.col("_i")) & (c["size"] <= F.col("_x.size")))
    chosen = judged.where(~refused).select("incident_id", "_x.trace_id")
    quiet = crowded.where(F.col("_all") <= cap).select(*keys)
    return null_safe_join(spans, store(chosen.unionByName(quiet), "chosen"), keys)


def bucketed_pull(rows: DataFrame, incidents: DataFrame, limit: int, order: Sequence[str | Column], buckets: int = 12, doc_id: str = "doc_id") -> DataFrame:
    """The earliest ceil(limit / buckets) rows of each equal slice of the window, each document once.

    ``incidents``: incident_id, window_start, window_end.
    """
    width = (F.col("window_end") - F.col("window_start")) / F.lit(float(buckets))
    slot = F.least(F.lit(buckets - 1), F.floor((F.col("time") - F.col("window_start")) / width))
    inside = rows.join(incidents.select("incident_id", "window_start", "window_end"), "incident_id").where(
        F.col("time").between(F.col("window_start"), F.col("window_end"))).withColumn("slot", slot).drop("window_start", "window_end")
    share = max(1, -(-limit // buckets))
    ordering = [F.col("time"), *[F.col(o) if isinstance(o, str) else o for o in order]]
    pulled = top_per_group(inside, ["incident_id", "slot"], ordering, share)
    return top_per_group(pulled, ["incident_id", doc_id], [F.col("slot"), *ordering], 1)
