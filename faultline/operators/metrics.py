"""Metric series operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.expr import is_error
from faultline.functions.ordered import exact_p95, ordered_index, previous_value, running_sums, top_per_group
from faultline.functions.robust import Z_MIN, effect_sizes
from faultline.operators.spans import with_onset

RED_METRICS = ("request_error_rate", "latency_p95_ms")
# fixed values: absolute rise that counts as significant
SIGNIFICANT_RISE = {"request_error_rate": 0.02, "latency_p95_ms": 100.0, "cpu_cores": 1.0}
SERIES = ["incident_id", "service", "metric"]


def significant_rise(metric: str | Column, pre: Column, post: Column) -> Column:
    name = F.col(metric) if isinstance(metric, str) else metric
    known = F.create_map(*[x for m, t in SIGNIFICANT_RISE.items() for x in (F.lit(m), F.lit(t))])
    limit = F.try_element_at(known, name)
    return F.when(limit.isNotNull(), post - pre > limit).otherwise((post > pre * 1.5) & (post - pre > 1e-9))


def mean_or_zero(condition: Column, value: str = "value") -> Column:
    return F.coalesce(F.avg(F.when(condition, F.col(value))), F.lit(0.0))


def list_series(metrics: DataFrame) -> DataFrame:
    """Series keys with the unit of their first point."""
    unit = F.col("unit") if "unit" in metrics.columns else F.lit(None).cast("string")
    return metrics.groupBy(*SERIES).agg(F.min_by(unit, F.struct("time", "value")).alias("unit"),
                                        F.count(F.lit(1)).alias("points"))


def series_points(metrics: DataFrame, service: str, metric: str) -> DataFrame:
    return metrics.where((F.col("service") == service) & (F.col("metric") == metric))


def sampled_series(
    metrics: DataFrame, max_points: int = 60, start: int | None = None, end: int | None = None
) -> DataFrame:
    """At most ``max_points`` evenly spaced points per series, with a summary of all points."""
    if start is not None:
        metrics = metrics.where(F.col("time") >= start)
    if end is not None:
        metrics = metrics.where(F.col("time") <= end)
    summary = metrics.groupBy(*SERIES).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.max_by("value", F.struct("time", "value")).alias("last"), F.count(F.lit(1)).alias("count"),
    )
    indexed = ordered_index(metrics.select(*SERIES, "time", "value"), SERIES, ["time", "value"]).join(summary, SERIES)
    # Point j is sampled when some i has floor(i * n / max_points) = j.
    step = F.col("count") / F.lit(float(max_points))
    guess = F.ceil(F.col("idx") / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = guess + shift
        hit = hit | ((i >= 0) & (i < max_points) & (F.least(F.col("count") - 1, F.floor(i * step)) == F.col("idx")))
    truncated = F.col("count") > max_points
    return indexed.where(~truncated | hit).withColumn("truncated", truncated).drop("idx")


def compare_windows(metrics: DataFrame, windows: DataFrame) -> DataFrame:
    """Baseline window against a later window (both inclusive) per series.

    ``windows``: incident_id, baseline_start, baseline_end, compare_start, compare_end.
    """
    joined = metrics.join(windows, "incident_id")
    sides = F.array(
        F.when(F.col("time").between(F.col("baseline_start"), F.col("baseline_end")), F.lit("pre")),
        F.when(F.col("time").between(F.col("compare_start"), F.col("compare_end")), F.lit("post")),
    )
    points = joined.select(*SERIES, "time", "value", F.explode(sides).alias("side"))
    measured = effect_sizes(points, SERIES).withColumnsRenamed({"pre_mean": "baseline_mean", "post_mean": "compare_mean"})
    delta = F.col("compare_mean") - F.col("baseline_mean")
    z = F.col("effect_z")
    return measured.select(
        *SERIES, "baseline_mean", "compare_mean", delta.alias("delta"),
        F.when(F.col("baseline_mean") != 0, delta / F.col("baseline_mean")).alias("pct_change"), z.alias("effect_z"),
        ((F.abs(delta) > F.lit(0.1) * F.abs("baseline_mean") + 1e-6) | (z >= Z_MIN)).alias("shifted"),
    )


def level_shift(metrics: DataFrame) -> DataFrame:
    """Split point that separates the means most, from running sums in one pass over time."""
    points = metrics.select(*SERIES, "time", "value")
    totals = points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_sum"))
    runs = running_sums(points, SERIES, ["time", "value"], {"_k": F.lit(1), "_s": F.col("value")}).join(totals, SERIES)
    before_n = F.col("_k") - 1
    before = (F.col("_s") - F.col("value")) / F.nullif(before_n, F.lit(0))
    after = (F.col("_sum") - F.col("_s") + F.col("value")) / (F.col("_n") - before_n)
    splits = runs.where(F.col("_k") > 1).select(
        *SERIES, F.col("time").alias("shift_second"), before.alias("before_mean"), after.alias("after_mean"),
        F.round(F.abs(after - before), 9).alias("magnitude"), "_k")
    best = splits.groupBy(*SERIES).agg(
        F.max_by(F.struct("shift_second", "before_mean", "after_mean", "magnitude"), F.struct("magnitude", -F.col("_k"))).alias("b"))
    mean = F.col("_sum") / F.col("_n")
    return totals.join(best, SERIES, "left").select(
        *SERIES, F.col("b.shift_second").alias("shift_second"), F.coalesce("b.before_mean", mean).alias("before_mean"),
        F.coalesce("b.after_mean", mean).alias("after_mean"), F.coalesce("b.magnitude", F.lit(0.0)).alias("magnitude"))


def onset_shifts(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Means before and after onset and the robust effect size of every series."""
    timed = with_onset(metrics, incidents)
    after = F.col("time") >= F.col("onset_second")
    points = timed.select(*SERIES, "time", "value", F.when(after, "post").otherwise("pre").alias("side"))
    return effect_sizes(points, SERIES).withColumn("delta", F.col("post_mean") - F.col("pre_mean"))


def top_movers(metrics: DataFrame, incidents: DataFrame, metric: str, limit: int = 10) -> DataFrame:
    shifts = onset_shifts(metrics.where(F.col("metric") == metric), incidents)
    order = [F.round("effect_z", 9).desc(), F.round("delta", 9).desc(), F.col("service")]
    return top_per_group(shifts, ["incident_id"], order, limit, "position")


def resource_saturation(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Series beyond the error and latency pair that rose at onset."""
    shifts = onset_shifts(metrics.where(~F.col("metric").isin(*RED_METRICS)), incidents)
    rose = significant_rise("metric", F.col("pre_mean"), F.col("post_mean"))
    return shifts.where((F.col("effect_z") >= Z_MIN) | rose)


def error_budget(
    metrics: DataFrame, slo: float = 0.01, start: int | None = None, end: int | None = None
) -> DataFrame:
    rows = metrics.where(F.col("metric") == "request_error_rate")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("time") >= start)
    if end is not None:
        inside = inside & (F.col("time") <= end)
    observed = rows.groupBy("incident_id", "service").agg(mean_or_zero(inside).alias("observed_error_rate"))
    burn = F.col("observed_error_rate") / F.lit(slo) if slo > 0 else F.lit(float("inf"))
    return observed.select("*", F.lit(slo).alias("slo_error_rate"), burn.alias("budget_burn"),
                           (F.col("observed_error_rate") > slo).alias("breached"))


def fleet_snapshot(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Post-onset means per service: the RED pair, and a map over every resource metric.

    Resources missing for a service are present with 0.0; the grid is built from
    the metric names of the incident, which is as wide as the metric catalogue.
    """
    post = with_onset(metrics, incidents)
    means = post.groupBy(*SERIES).agg(mean_or_zero(F.col("time") >= F.col("onset_second")).alias("post_mean"))
    per_service = means.groupBy("incident_id", "service").agg(
        F.coalesce(F.max(F.when(F.col("metric") == RED_METRICS[0], F.col("post_mean"))), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.max(F.when(F.col("metric") == RED_METRICS[1], F.col("post_mean"))), F.lit(0.0)).alias("latency_p95_ms"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(~F.col("metric").isin(*RED_METRICS), F.struct("metric", "post_mean"))))).alias("_have"),
    )
    names = means.where(~F.col("metric").isin(*RED_METRICS)).groupBy("incident_id").agg(
        F.sort_array(F.collect_set("metric")).alias("_names"))
    grid = F.map_from_entries(F.transform(
        F.coalesce("_names", F.array().cast("array<string>")),
        lambda m: F.struct(m, F.coalesce(F.try_element_at("_have", m), F.lit(0.0)))))
    return per_service.join(names, "incident_id", "left").select(
        "incident_id", "service", "error_rate", "latency_p95_ms", grid.alias("resources"))


# ---- series built from raw telemetry ------------------------------------------------------

def red_from_spans(spans: DataFrame, bucket: int = 60) -> DataFrame:
    """Error rate and exact p95 per service and bucket, in long form."""
    bucketed = spans.withColumn("time_bucket", F.floor(F.col("time") / bucket) * bucket)
    keys = ["incident_id", "service", "time_bucket"]
    rates = bucketed.groupBy(*keys).agg((F.count_if(is_error()) / F.count(F.lit(1))).alias("value"))
    p95 = exact_p95(bucketed, keys, name="value").drop("n")

    def named(df: DataFrame, metric: str, unit: str) -> DataFrame:
        return df.select("incident_id", "service", F.lit(metric).alias("metric"), F.col("time_bucket").alias("time"),
                         "value", F.lit(unit).alias("unit"))

    return named(rates, "request_error_rate", "ratio").unionByName(named(p95, "latency_p95_ms", "ms"))


def counter_rate(points: DataFrame, bucket: int = 60, scale: float = 1e9) -> DataFrame:
    """Per-bucket rate of a cumulative counter per container, aware of resets.

    ``points``: incident_id, container, time, value. A drop is a reset: the new
    value is the increase since it.
    """
    keys = ["incident_id", "container"]
    steps = previous_value(points.select(*keys, "time", "value"), keys, ["time", "value"], ["time", "value"]).where(F.col("prev_value").isNotNull())
    increase = F.when(F.col("value") < F.col("prev_value"), F.col("value")).otherwise(F.col("value") - F.col("prev_value"))
    return steps.groupBy(*keys, (F.floor(F.col("time") / bucket) * bucket).alias("time")).agg(
        (F.sum(increase) / F.nullif(F.sum(steps["time"] - F.col("prev_time")), F.lit(0)) / scale).alias("cpu_cores"))


def container_gauges(points: DataFrame, bucket: int = 60) -> DataFrame:
    """Bucketed gauges per container: peak memory in MB, mean CPU, mean memory percent."""
    return points.groupBy(
        "incident_id", "container", (F.floor(F.col("time") / bucket) * bucket).alias("time")
    ).agg((F.max("memory_bytes") / 1e6).alias("memory_mb"), F.avg("cpu").alias("cpu_utilization"),
          F.avg("memory_percent").alias("memory_percent"))


def histogram_quantile(buckets: DataFrame, q: float = 0.95) -> DataFrame:
    """Quantile of cumulative ``le`` buckets per service and time, linear inside a bucket.

    ``buckets``: incident_id, service, time, le (double, may be infinite), count.
    """
    keys = ["incident_id", "service", "time"]
    summed = buckets.groupBy(*keys, "le").agg(F.sum("count").alias("c"))
    order = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    placed = summed.select(
        *keys, "le", "c", F.lag("le").over(order).alias("lo"), F.lag("c").over(order).alias("below"),
        F.max("c").over(whole).alias("total"),
        F.max(F.when(F.col("le") < float("inf"), F.col("le"))).over(whole).alias("top"))
    rank = F.lit(q) * F.col("total")
    first = placed.where(F.col("c") >= rank).groupBy(*keys).agg(
        F.min_by(F.struct("le", "c", "lo", "below", "total", "top"), "le").alias("b"))
    lo, below = F.coalesce("b.lo", F.lit(0.0)), F.coalesce("b.below", F.lit(0))
    inside = lo + (F.col("b.le") - lo) * (F.lit(q) * F.col("b.total") - below) / F.nullif(F.col("b.c") - below, F.lit(0))
    return first.where(F.col("b.total") > 0).select(
        *keys, F.when(F.col("b.le") == float("inf"), F.col("b.top")).otherwise(inside).alias("value"))


def chart_series(spans: DataFrame, points: DataFrame, bucket: int = 15) -> DataFrame:
    """Per-service chart series in long form: cpu and memory means, span error rate."""
    def bucketed(df: DataFrame, facet: str) -> DataFrame:
        return df.where(F.col(facet).isNotNull()).withColumn("t", F.floor(F.col("time") / bucket) * bucket)

    gauges = bucketed(points, "container").groupBy("incident_id", F.col("container").alias("service"), "t").agg(
        F.avg("cpu").alias("cpu"), F.avg("memory_percent").alias("mem"))
    long = gauges.unpivot(["incident_id", "service", "t"], ["cpu", "mem"], "series", "value").where("value IS NOT NULL")
    errors = bucketed(spans, "service").groupBy("incident_id", "service", "t").agg(
        (F.count_if(is_error()) / F.count(F.lit(1))).alias("value"))
    return long.unionByName(errors.withColumn("series", F.lit("err")))


def trailing_health(
    spans: DataFrame, points: DataFrame, now: DataFrame, cpu_window: int = 90, error_window: int = 120
) -> DataFrame:
    """Seconds since the newest point and trailing health per (incident, service).

    ``now``: incident_id, now_second.
    """
    seen = points.join(now, "incident_id")
    cpu = seen.groupBy("incident_id", F.col("container").alias("service")).agg(
        F.max(F.col("now_second") - F.col("time")).alias("_oldest"),
        (F.max("now_second") - F.max("time")).alias("ingest_age_s"),
        F.avg(F.when(F.col("time") > F.col("now_second") - cpu_window, F.col("cpu"))).alias("cpu_now")).drop("_oldest")
    recent = spans.join(now, "incident_id").where(F.col("time") > F.col("now_second") - error_window)
    errors = recent.groupBy("incident_id", "service").agg(
        (F.count_if(is_error()) / F.count(F.lit(1))).alias("error_rate_now"))
    return cpu.join(errors, ["incident_id", "service"], "full_outer")
