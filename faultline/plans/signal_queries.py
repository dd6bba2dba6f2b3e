"""Queries M1-M14, Z1-Z3, L1-L6, C1-C4 and K1-K5."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.expr import log_fingerprint, log_template, round6
from faultline.functions.robust import effect_sizes, family, floors
from faultline.operators import changes, correlate, logs, metrics, spans
from faultline.plans.registry import query
from faultline.plans.span_queries import error_traces
from faultline.plans.sqltext import ONSET_EFFECTS, ONSET_POINTS, RESOLVED, effect_ctes, p95
from faultline.plans.views import Telemetry, with_views

SERIES = ("incident_id", "service", "metric")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round6(n) for n in names})


@query("m1_series_catalogue", with_views("metrics", body="""
select incident_id, service, metric, count(*) as points from metrics group by all"""))
def _(t: Telemetry) -> DataFrame:
    return metrics.list_series(t.metrics).drop("unit")


@query("m2_series_sample", with_views("metrics", extra={
    "n": """select *, row_number() over (partition by incident_id, service, metric order by time, value) - 1 as idx,
      count(*) over (partition by incident_id, service, metric) as cnt from metrics""",
    "s": """select incident_id, service, metric, min(value) as mn, max(value) as mx, avg(value) as mean, arg_max(value, row(time, value)) as last
      from metrics group by all""",
    "pick": "select i, k.cnt, least(k.cnt - 1, cast(floor(i * (k.cnt / 40.0e0)) as bigint)) as idx from range(40) r(i), (select distinct cnt from n) k"},
    body="""select n.incident_id, n.service, n.metric, n.time, round(n.value, 6) as value, round(mn, 6) as min, round(mx, 6) as max,
  round(mean, 9) as mean, round(last, 6) as last, n.cnt as count, n.cnt > 40 as truncated
from n join s using (incident_id, service, metric) where n.cnt <= 40 or (n.cnt, n.idx) in (select cnt, idx from pick)"""))
def _(t: Telemetry) -> DataFrame:
    found = rounded(metrics.sampled_series(t.metrics, max_points=40), "value", "min", "max", "last")
    return found.withColumn("mean", F.round("mean", 9))


_WINDOWS = {
    "points": """select incident_id, service, metric, time, value, 'pre' as side from metrics where time between 0 and 200000
      union all select incident_id, service, metric, time, value, 'post' as side from metrics where time between 150000 and 400000""",
} | effect_ctes("points") | {
    "mean": """select incident_id, service, metric, coalesce(avg(value) filter (where side='pre'), 0.0) as b,
      coalesce(avg(value) filter (where side='post'), 0.0) as c from points group by all"""}


@query("m3_compare_baseline", with_views("metrics", extra=_WINDOWS, body="""
select incident_id, service, metric, round(b, 6) as baseline_mean, round(c, 6) as compare_mean, round(c - b, 6) as delta,
  round(case when b <> 0 then (c - b) / b end, 6) as pct_change, round(effect_z, 6) as effect_z,
  abs(c - b) > 0.1e0*abs(b) + 1e-6 or effect_z >= 3 as shifted
from mean join z using (incident_id, service, metric)"""))
def _(t: Telemetry) -> DataFrame:
    windows = t.incidents.select(
        "incident_id", F.lit(0).alias("baseline_start"), F.lit(200000).alias("baseline_end"),
        F.lit(150000).alias("compare_start"), F.lit(400000).alias("compare_end"))
    return rounded(metrics.compare_windows(t.metrics, windows), "baseline_mean", "compare_mean", "delta", "pct_change", "effect_z")


@query("m4_level_shift", with_views("metrics", extra={
    "r": """select *, row_number() over w as k, sum(value) over w as s from metrics
      window w as (partition by incident_id, service, metric order by time, value rows unbounded preceding)""",
    "tot": "select incident_id, service, metric, count(*) as n, sum(value) as total from metrics group by all",
    "sp": """select r.*, (s - value) / (k - 1) as b, (total - s + value) / (n - k + 1) as a from r join tot using (incident_id, service, metric) where k > 1""",
    "best": """select *, row_number() over (partition by incident_id, service, metric order by round(abs(a - b), 9) desc, k) as p from sp"""},
    body="""select incident_id, service, metric, b.time as shift_second, round(coalesce(b.b, total / n), 6) as before_mean,
  round(coalesce(b.a, total / n), 6) as after_mean, round(coalesce(round(abs(a - b.b), 9), 0.0), 6) as magnitude
from tot left join (select * from best where p=1) b using (incident_id, service, metric)"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(metrics.level_shift(t.metrics), "before_mean", "after_mean", "magnitude")


@query("m5_top_movers", with_views("metrics", "incidents", extra=ONSET_EFFECTS, body="""
select incident_id, service, round(pre_mean, 6) as pre_mean, round(post_mean, 6) as post_mean, round(post_mean - pre_mean, 6) as delta,
  round(effect_z, 6) as effect_z, row_number() over (partition by incident_id
  order by round(shifts.effect_z, 9) desc, round(shifts.post_mean - shifts.pre_mean, 9) desc, service) as position
from shifts where metric='latency_p95_ms' qualify position <= 10"""))
def _(t: Telemetry) -> DataFrame:
    found = metrics.top_movers(t.metrics, t.incidents, "latency_p95_ms")
    return rounded(found, "pre_mean", "post_mean", "delta", "effect_z").drop("metric", "n_pre", "n_post")


@query("m6_resource_saturation", with_views("metrics", "incidents", extra=ONSET_EFFECTS, body="""
select incident_id, service, metric, round(pre_mean, 6) as pre_mean, round(post_mean, 6) as post_mean, round(effect_z, 6) as effect_z
from shifts where metric='cpu_cores' and (effect_z >= 3 or post_mean - pre_mean > 1.0)"""))
def _(t: Telemetry) -> DataFrame:
    found = metrics.resource_saturation(t.metrics, t.incidents)
    return rounded(found.select(*SERIES, "pre_mean", "post_mean", "effect_z"), "pre_mean", "post_mean", "effect_z")


@query("m7_error_budget", with_views("metrics", body="""
select incident_id, service, round(o, 6) as observed_error_rate, 0.01e0 as slo_error_rate, round(o / 0.01e0, 6) as budget_burn, o > 0.01e0 as breached
from (select incident_id, service, coalesce(avg(value) filter (where time >= 216000), 0.0) as o from metrics where metric='request_error_rate' group by all)"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(metrics.error_budget(t.metrics, slo=0.01, start=216000), "observed_error_rate", "budget_burn")


@query("m8_fleet_snapshot", with_views("metrics", "incidents", body="""
select incident_id, service, round(coalesce(avg(value) filter (where metric='request_error_rate' and time >= onset_second), 0.0), 6) as error_rate,
  round(coalesce(avg(value) filter (where metric='latency_p95_ms' and time >= onset_second), 0.0), 6) as latency_p95_ms,
  round(coalesce(avg(value) filter (where metric='cpu_cores' and time >= onset_second), 0.0), 6) as cpu_cores
from metrics join incidents using (incident_id) group by all"""))
def _(t: Telemetry) -> DataFrame:
    found = metrics.fleet_snapshot(t.metrics, t.incidents).withColumn("cpu_cores", F.try_element_at("resources", F.lit("cpu_cores")))
    return rounded(found.drop("resources"), "error_rate", "latency_p95_ms", "cpu_cores")


@query("m9_significant_rise", with_views("metrics", "incidents", extra=ONSET_EFFECTS, body="""
select incident_id, service, metric, post_mean - pre_mean > case metric when 'request_error_rate' then 0.02 when 'latency_p95_ms' then 100.0 else 1.0 end as rose
from shifts"""))
def _(t: Telemetry) -> DataFrame:
    return correlate.align_signals(t.metrics, t.incidents).select(*SERIES, F.col("shifted").alias("rose"))


@query("m10_red_from_spans", with_views("spans", extra={"b": "select *, time // 3600 * 3600 as bt from spans"}, body=f"""
select incident_id, service, 'request_error_rate' as metric, bt as time, round(count(*) filter (where status='ERROR') / count(*), 6) as value, 'ratio' as unit from b group by all
union all select incident_id, service, 'latency_p95_ms' as metric, bt as time, round({p95()}, 6) as value, 'ms' as unit from b group by incident_id, service, bt"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(metrics.red_from_spans(t.spans, bucket=3600), "value")


def container_points(t: Telemetry) -> DataFrame:
    """Container samples from the event stream: a CPU counter that resets, memory and CPU gauges."""
    e = t.span_events
    return e.select(
        "incident_id", F.col("service").alias("container"), "time", "event_id",
        (F.pmod(F.col("event_id"), F.lit(500)) * 1000000000 + F.col("user_id")).cast("double").alias("value"),
        (F.col("duration_ms") * 1e6).alias("memory_bytes"), F.col("duration_ms").alias("cpu"), (F.col("duration_ms") / 10).alias("memory_percent"))


_POINTS = {"pts": """select incident_id, service as container, time, event_id, cast((event_id % 500) * 1000000000 + user_id as double) as value,
  duration_ms * 1e6 as memory_bytes, duration_ms as cpu, duration_ms / 10 as memory_percent from spanev"""}


@query("m11_counter_rate", with_views("spanev", extra=_POINTS | {
    "d": """select *, lag(value) over w as prev, time - lag(time) over w as dt from pts
      window w as (partition by incident_id, container order by time, value)"""}, body="""
select incident_id, container, time // 7200 * 7200 as time, round(sum(case when value < prev then value else value - prev end) / nullif(sum(dt), 0) / 1e9, 6) as cpu_cores
from d where prev is not null group by all"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(metrics.counter_rate(container_points(t), bucket=7200), "cpu_cores")


@query("m11_container_gauges", with_views("spanev", extra=_POINTS, body="""
select incident_id, container, time // 7200 * 7200 as time, round(max(memory_bytes) / 1e6, 6) as memory_mb, round(avg(cpu), 6) as cpu_utilization,
  round(avg(memory_percent), 6) as memory_percent from pts group by all"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(metrics.container_gauges(container_points(t), bucket=7200), "memory_mb", "cpu_utilization", "memory_percent")


_BOUNDS = [5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 320.0, float("inf")]


@query("m12_histogram_quantile", with_views("spans", extra={
    "les": "select unnest([5.0e0, 10.0e0, 20.0e0, 40.0e0, 80.0e0, 160.0e0, 320.0e0, 'inf'::double]) as le",
    "h": """select incident_id, service, time // 43200 * 43200 as time, le, count(*) filter (where duration_ms <= le) as c from spans, les group by all""",
    "w": """select *, coalesce(lag(le) over w, 0.0) as lo, coalesce(lag(c) over w, 0) as below, max(c) over (partition by incident_id, service, time) as total
      from h window w as (partition by incident_id, service, time order by le)""",
    "f": "select *, row_number() over (partition by incident_id, service, time order by le) as r from w where c >= 0.95e0 * total"}, body="""
select incident_id, service, time, round(case when le = 'inf'::double then 320.0 else lo + (le - lo) * (0.95e0 * total - below) / nullif(c - below, 0) end, 6) as value
from f where r = 1 and total > 0"""))
def _(t: Telemetry) -> DataFrame:
    below = F.array(*[F.struct(F.lit(b).alias("le"), (F.col("duration_ms") <= b).cast("long").alias("hit")) for b in _BOUNDS])
    keys = ["incident_id", "service", "time"]
    buckets = t.spans.select("incident_id", "service", (F.floor(F.col("time") / 43200) * 43200).alias("time"), F.explode(below).alias("b"))
    summed = buckets.groupBy(*keys, "b.le").agg(F.sum("b.hit").alias("count"))
    return rounded(metrics.histogram_quantile(summed), "value")


@query("m13_chart_series", with_views("spanev", extra=_POINTS, body="""
select incident_id, container as service, time // 3600 * 3600 as t, 'cpu' as series, round(avg(cpu), 6) as value from pts group by all
union all select incident_id, container, time // 3600 * 3600, 'mem', round(avg(memory_percent), 6) from pts group by all
union all select incident_id, service, time // 3600 * 3600, 'err', round(count(*) filter (where status='ERROR') / count(*), 6) from spanev group by all"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(metrics.chart_series(t.spans, container_points(t), bucket=3600), "value")


@query("m14_trailing_health", with_views("spanev", extra=_POINTS, body="""
select incident_id, p.service, p.ingest_age_s, round(p.cpu_now, 6) as cpu_now, round(e.error_rate_now, 6) as error_rate_now from
 (select incident_id, container as service, 432000 - max(time) as ingest_age_s, avg(cpu) filter (where time > 432000 - 9000) as cpu_now from pts group by all) p
 full join (select incident_id, service, count(*) filter (where status='ERROR') / count(*) as error_rate_now from spanev where time > 432000 - 12000 group by all) e
 using (incident_id, service)"""))
def _(t: Telemetry) -> DataFrame:
    now = t.incidents.select("incident_id", F.col("window_end").alias("now_second"))
    found = metrics.trailing_health(t.spans, container_points(t), now, cpu_window=9000, error_window=12000)
    return rounded(found, "cpu_now", "error_rate_now")


@query("z1_step_effect", with_views("metrics", "incidents", extra=ONSET_EFFECTS, body="""
select incident_id, service, metric, n_pre, n_post, round(effect_z, 6) as effect_z from z"""))
def _(t: Telemetry) -> DataFrame:
    shifts = metrics.onset_shifts(t.metrics, t.incidents)
    return rounded(shifts.select(*SERIES, "n_pre", "n_post", "effect_z"), "effect_z")


@query("z2_level_effect_at_scale", with_views("metrics", "incidents", extra=ONSET_POINTS | effect_ctes("points"), body="""
select incident_id, service, metric, n_pre, n_post, round(effect_z, 6) as effect_z from z"""))
def _(t: Telemetry) -> DataFrame:
    """The same effect size by joins and exact ranks, the way very long series take."""
    timed = spans.with_onset(t.metrics, t.incidents)
    side = F.when(F.col("time") >= F.col("onset_second"), "post").otherwise("pre")
    points = timed.select(*SERIES, "time", "value", side.alias("side"))
    return rounded(effect_sizes(points, SERIES, array_max=0).drop("pre_mean", "post_mean"), "effect_z")


@query("z3_metric_family", with_views("metrics", body="""
select distinct metric, case when contains(metric, 'latency') then 'latency' when contains(metric, 'error') then 'error' else 'resource' end as family,
  case metric when 'request_error_rate' then 0.002e0 when 'latency_p95_ms' then 2.0e0 else 1e-9 end as eps,
  case metric when 'request_error_rate' then 0.01e0 when 'latency_p95_ms' then 15.0e0 else 0.0e0 end as abs_floor,
  case metric when 'request_error_rate' then 0.5e0 else 0.15e0 end as rel_floor from metrics"""))
def _(t: Telemetry) -> DataFrame:
    return t.metrics.select("metric").distinct().withColumn("f", floors()).select(
        "metric", family().alias("family"), F.col("f.eps").alias("eps"), F.col("f.abs").alias("abs_floor"), F.col("f.rel").alias("rel_floor"))


# ---- logs -----------------------------------------------------------------------------------

@query("l1_log_search", with_views("logs", body="""
select incident_id, time, service, lower(severity) as severity, message, row_number() over (partition by incident_id
  order by time, service, logs.severity, message, trace_id) as position, count(*) over (partition by incident_id) as total_matched
from logs where lower(severity)='error' and contains(lower(message), 'op4') qualify position <= 30"""))
def _(t: Telemetry) -> DataFrame:
    found = logs.find_logs(t.logs, severity_min="error", contains="OP4")
    return found.select("incident_id", "time", "service", "severity", "message", "position", "total_matched")


@query("l1_long_lines", """
with one as (select doc_id, lang, replace(trim(text, E' \\t\\n\\r\\x0b\\x0c'), E'\\n', ' ') as m from documents)
select doc_id, case when length(m) > 300 then concat(left(m, 300), '...') else m end as message from one""")
def _(t: Telemetry) -> DataFrame:
    return t.table("documents").select("doc_id", logs.log_line("text").alias("message"))


@query("l2_trace_logs", with_views("spans", "logs", extra={
    "bad": "select distinct incident_id, trace_id from spans where status='ERROR'"}, body="""
select incident_id, trace_id, time, service, lower(severity) as severity, message from logs
where lower(severity) in ('warn', 'error') and (incident_id, trace_id) in (select incident_id, trace_id from bad)"""))
def _(t: Telemetry) -> DataFrame:
    found = logs.trace_log_lines(t.logs, error_traces(t), severity_min="warn")
    return found.select("incident_id", "trace_id", "time", "service", "severity", "message")


_TPL = r"left(regexp_replace(regexp_replace(trim(message, E' \t\n\r\x0b\x0c'), '\b[0-9a-f]{8,}\b', '#', 'g'), '\d+', '#', 'g'), 120)"


@query("l3_error_clusters", with_views("logs", extra={
    "g": f"""select incident_id, {_TPL} as template, count(*) as count, arg_min(left(message, 300), row(time, service, severity, message, trace_id)) as example,
      array_to_string(list_sort(list(distinct service)), ',') as services, min(row(time, service, severity, message, trace_id)) as seen
      from logs where lower(severity)='error' group by 1, 2"""}, body="""
select incident_id, template, count, example, services, row_number() over (partition by incident_id order by count desc, seen) as position from g qualify position <= 10"""))
def _(t: Telemetry) -> DataFrame:
    return logs.error_clusters(t.logs).withColumn("services", F.array_join("services", ","))


@query("l3_document_templates", rf"""
select {_TPL.replace('message', 'text')} as template, count(*) as count from documents group by 1""")
def _(t: Telemetry) -> DataFrame:
    return t.table("documents").groupBy(log_template("text").alias("template")).agg(F.count(F.lit(1)).alias("count"))


@query("l4_level_histogram", with_views("logs", body="""
select incident_id, time // 3600 * 3600 as start, lower(severity) as level, count(*) as count from logs group by all"""))
def _(t: Telemetry) -> DataFrame:
    folded = logs.level_histogram(t.logs, bucket=3600)
    return folded.select("incident_id", "start", F.explode("counts").alias("level", "count"))


@query("l5_first_errors", with_views("logs", body="""
select incident_id, service, min(time) as time, 'error' as severity, left(arg_min(message, row(time, service, severity, message, trace_id)), 200) as message
from logs where lower(severity)='error' group by 1, 2"""))
def _(t: Telemetry) -> DataFrame:
    return logs.first_errors(t.logs)


@query("l6_log_fingerprint", with_views("logs", body=r"""
select incident_id, left(trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '\b[0-9a-f]{8,}\b', '<id>', 'g'), '\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g')), 120) as template,
  count(*) as count from logs group by 1, 2"""))
def _(t: Telemetry) -> DataFrame:
    return t.logs.groupBy("incident_id", log_fingerprint("message").alias("template")).agg(F.count(F.lit(1)).alias("count"))


# ---- changes --------------------------------------------------------------------------------

@query("c1_change_search", with_views("changes", body="""
select incident_id, id, time, service, kind, summary from changes where service='payment' and time between 50000 and 216000"""))
def _(t: Telemetry) -> DataFrame:
    return changes.search_changes(t.changes, service="payment", start=50000, end=216000)


@query("c2_lookback", with_views("changes", "incidents", body="""
select incident_id, id, time, service, onset_second - time as gap_seconds from changes join incidents using (incident_id)
where time < onset_second and time >= onset_second - 86400"""))
def _(t: Telemetry) -> DataFrame:
    return changes.lookback(t.changes, t.incidents, lookback_seconds=86400).select("incident_id", "id", "time", "service", "gap_seconds")


@query("c3_rank_culprits", with_views("changes", "incidents", "truth", extra={
    "b": """select c.*, onset_second - c.time as gap, max(onset_second - c.time) over (partition by incident_id) as span, t.service as suspect
      from changes c join incidents i using (incident_id) join truth t using (incident_id) where c.time < onset_second"""}, body="""
select incident_id, id as change_id, service, time, round(case when service=suspect then 10.0e0 else 1.0e0 end + (1.0e0 - gap / span), 3) as score,
  concat(case when service=suspect then concat('on suspected service ', service, '; ') else '' end, gap, 's before onset') as reason from b"""))
def _(t: Telemetry) -> DataFrame:
    suspects = t.truth.select("incident_id", F.col("service").alias("suspected_service"))
    return changes.rank_culprits(t.changes, t.incidents, suspects)


@query("c4_nearest_change", with_views("spans", "changes", extra={
    "known": "select incident_id, service, max(time) as onset_second from spans where status='ERROR' group by 1, 2",
    "probe": """select * from known union all select incident_id, null, max(onset_second) from known group by 1
      union all select incident_id, min(service), null from known group by 1"""}, body="""
select p.incident_id, p.service, p.onset_second, arg_min(id, row(-c.time, id)) as change_id, max(c.time) as change_time
from probe p left join changes c on c.incident_id=p.incident_id and c.service=p.service and c.time < p.onset_second group by 1, 2, 3"""))
def _(t: Telemetry) -> DataFrame:
    known = t.spans.where("status = 'ERROR'").groupBy("incident_id", "service").agg(F.max("time").alias("onset_second"))
    unnamed = known.groupBy("incident_id").agg(F.lit(None).cast("string").alias("service"), F.max("onset_second").alias("onset_second"))
    untimed = known.groupBy("incident_id").agg(F.min("service").alias("service"), F.lit(None).cast("long").alias("onset_second"))
    return changes.nearest_before(t.changes, known.union(unnamed).union(untimed))


# ---- correlation ----------------------------------------------------------------------------

_OBS = RESOLVED | {
    "obs": """select incident_id, service, span_kind as role, case when span_kind='client' then callee end as callee, count(*) as n,
      min(row(time, trace_id, span_id)) as seen from resolved where status='ERROR' group by 1, 2, 3, 4""",
    "top": "select *, row_number() over (partition by incident_id order by case role when 'server' then 0 else 1 end, n desc, seen) as r from obs",
}


@query("k1_attribute_fault", with_views("spans", extra=_OBS, body="""
select incident_id, case role when 'server' then 'service' else 'edge' end as kind, case role when 'server' then service end as service,
  case role when 'client' then service end as caller, case role when 'client' then callee end as callee,
  case role when 'server' then 0.9e0 else 0.8e0 end as confidence from top where r = 1"""))
def _(t: Telemetry) -> DataFrame:
    return correlate.attribute_fault(spans.error_summary(t.spans)).drop("rationale")


@query("k2_timeline", with_views("changes", "incidents", body="""
select incident_id, time as second, 'change' as kind, concat(id, ' on ', service, ': ', summary) as detail, time < onset_second as before_onset
from changes join incidents using (incident_id)
union all select incident_id, onset_second, 'onset', 'first error span', false from incidents"""))
def _(t: Telemetry) -> DataFrame:
    return correlate.timeline(t.changes, t.incidents).select("incident_id", "second", "kind", "detail", "before_onset")


@query("k3_align_signals", with_views("metrics", "incidents", extra=ONSET_EFFECTS, body="""
select incident_id, service, metric, round(pre_mean, 6) as pre_mean, round(post_mean, 6) as post_mean,
  case metric when 'request_error_rate' then 0 when 'latency_p95_ms' then 1 else 2 end as signal_order,
  post_mean - pre_mean > case metric when 'request_error_rate' then 0.02 when 'latency_p95_ms' then 100.0 else 1.0 end as shifted from shifts"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(correlate.align_signals(t.metrics, t.incidents), "pre_mean", "post_mean")


@query("k4_exemplar_traces", with_views("spans", "incidents", extra={
    "f": """select incident_id, service, trace_id, min(row(time, trace_id, span_id)) as o, arg_min(span_id, row(time, trace_id, span_id)) as span_id,
      min(time) as time from spans join incidents using (incident_id) where status='ERROR' and time >= onset_second group by 1, 2, 3"""}, body="""
select incident_id, service, trace_id, span_id, time, row_number() over (partition by incident_id, service order by o) as position from f qualify position <= 5"""))
def _(t: Telemetry) -> DataFrame:
    return correlate.exemplar_traces(t.spans, t.incidents).drop("operation", "duration_ms")


@query("k5_onset_consensus", with_views("spans", "logs", body="""
select incident_id, a as trace_onset_second, b as first_error_log_second, case when abs(a - b) <= 60 then least(a, b) else coalesce(a, b) end as consensus_onset_second,
  coalesce(abs(a - b) <= 60, false) as agreement
from (select incident_id, min(time) as a from spans where status='ERROR' group by 1) full join
  (select incident_id, min(time) as b from logs where lower(severity)='error' group by 1) using (incident_id)"""))
def _(t: Telemetry) -> DataFrame:
    return correlate.onset_consensus(t.spans, t.logs).drop("note")
