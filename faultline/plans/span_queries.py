"""Queries P1-P11 and T1-T14."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.expr import round6, rpc_callee, severity_rank
from faultline.operators import changes, logs, metrics, spans
from faultline.plans.registry import query
from faultline.plans.sqltext import EDGES, RESOLVED, p95
from faultline.plans.views import Telemetry, with_views


@query("p1_service_universe", with_views("spans", "metrics", "changes", body="""
select incident_id, service from spans union select incident_id, service from metrics
union select incident_id, service from changes"""))
def _(t: Telemetry) -> DataFrame:
    return spans.service_universe(t.spans, t.metrics, t.changes)


@query("p2_metric_keys", with_views("metrics", body="""
select incident_id, service, metric, count(*) as points from metrics group by all"""))
def _(t: Telemetry) -> DataFrame:
    return metrics.list_series(t.metrics).drop("unit")


@query("p3_metric_series", with_views("metrics", body="""
select incident_id, service, metric, time, round(value, 6) as value from metrics
where service='payment' and metric='latency_p95_ms'"""))
def _(t: Telemetry) -> DataFrame:
    return metrics.series_points(t.metrics, "payment", "latency_p95_ms").withColumn("value", round6("value"))


@query("p4_span_search", with_views("spans", extra=RESOLVED, body="""
select incident_id, span_id, time, service, callee, status from resolved
where service='checkout' and span_kind='client' and callee='payment' and status='OK'
  and contains(operation, 'Charge') and time between 1000 and 400000"""))
def _(t: Telemetry) -> DataFrame:
    found = spans.search_spans(t.spans, service="checkout", span_kind="CLIENT", status="ok", callee="payment",
                               operation_contains="Charge", start=1000, end=400000)
    return found.select("incident_id", "span_id", "time", "service", "callee", "status")


@query("p5_children_index", with_views("spans", body="""
select p.incident_id, p.span_id, p.service, c.span_id as child_id, c.service as child_service
from spans p join spans c on c.incident_id=p.incident_id and c.parent_span_id=p.span_id"""))
def _(t: Telemetry) -> DataFrame:
    return spans.children_index(t.spans).select("incident_id", "span_id", "service", "child_id", "child_service")


@query("p6_callee_resolution", with_views("spans", extra=RESOLVED, body="""
select incident_id, service, coalesce(callee, '-') as callee, span_kind, count(*) as n from resolved group by all"""))
def _(t: Telemetry) -> DataFrame:
    resolved = spans.resolve_callees(t.spans).withColumn("callee", F.coalesce("callee", F.lit("-")))
    return resolved.groupBy("incident_id", "service", "callee", "span_kind").agg(F.count(F.lit(1)).alias("n"))


@query("p7_rpc_callee", """
with docs as (select doc_id, concat('pkg.', replace(text, '/', ' '), 'Service/', lang) as operation from documents)
select doc_id, coalesce(nullif(lower(ltrim(regexp_replace(
  left(list_filter(string_split(split_part(operation, '/', 1), '.'), lambda x: lower(x) like '%service')[-1], -7),
  '([A-Z])', '-\\1', 'g'), '-')), ''), '-') as callee from docs""")
def _(t: Telemetry) -> DataFrame:
    operation = F.concat(F.lit("pkg."), F.replace(F.col("text"), F.lit("/"), F.lit(" ")), F.lit("Service/"), "lang")
    return t.table("documents").select("doc_id", F.coalesce(rpc_callee(operation), F.lit("-")).alias("callee"))


@query("p8_severity_rank", with_views("logs", body="""
select incident_id, severity, case lower(severity) when 'debug' then 1 when 'info' then 2 when 'warn' then 3
  when 'error' then 4 else 0 end as rank, count(*) as n from logs group by all"""))
def _(t: Telemetry) -> DataFrame:
    ranked = t.logs.withColumn("rank", severity_rank())
    return ranked.groupBy("incident_id", "severity", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("p9_log_search", with_views("logs", body="""
select incident_id, time, service, severity, message from logs
where service='checkout' and lower(severity) in ('warn', 'error') and contains(lower(message), 'user 1') and time between 5000 and 300000"""))
def _(t: Telemetry) -> DataFrame:
    found = logs.search_logs(t.logs, service="checkout", severity_min="WARN", contains="USER 1", start=5000, end=300000)
    return found.select("incident_id", "time", "service", "severity", "message")


_ERROR_TRACES = {"bad": "select distinct incident_id, trace_id from spans where status='ERROR'"}


def error_traces(t: Telemetry) -> DataFrame:
    return t.spans.where("status = 'ERROR'").select("incident_id", "trace_id").distinct()


@query("p10_trace_logs", with_views("spans", "logs", extra=_ERROR_TRACES, body="""
select incident_id, trace_id, time, service, message from logs where (incident_id, trace_id) in (select incident_id, trace_id from bad)"""))
def _(t: Telemetry) -> DataFrame:
    return logs.logs_of_traces(t.logs, error_traces(t)).select("incident_id", "trace_id", "time", "service", "message")


@query("p11_change_list", with_views("changes", body="""
select incident_id, id, time, service, kind, summary from changes where service='cart' and time between 10000 and 300000"""))
def _(t: Telemetry) -> DataFrame:
    return changes.search_changes(t.changes, service="cart", start=10000, end=300000)


@query("t1_dependency_graph", with_views("spans", extra=EDGES, body="select * from edges"))
def _(t: Telemetry) -> DataFrame:
    return spans.call_edges(t.spans)


@query("t1_dependency_services", with_views("spans", extra=EDGES, body="""
select incident_id, service from spans union select incident_id, callee as service from edges"""))
def _(t: Telemetry) -> DataFrame:
    return spans.dependency_services(t.spans)


@query("t2_first_error", with_views("spans", body="""
select incident_id, min(time) as second, arg_min(service, row(time, span_id)) as service,
  arg_min(span_kind, row(time, span_id)) as span_kind, arg_min(trace_id, row(time, span_id)) as trace_id
from spans where status='ERROR' group by 1"""))
def _(t: Telemetry) -> DataFrame:
    return spans.first_error(t.spans)


_SELF = {
    "below": "select incident_id, parent_span_id as span_id, sum(duration_ms) as ms from spans where parent_span_id is not null group by 1, 2",
    "self": """select s.*, greatest(0.0, s.duration_ms - coalesce(b.ms, 0.0)) as self_ms, s.time >= i.onset_second as after
      from spans s left join below b using (incident_id, span_id) join incidents i using (incident_id)""",
    "kept": "select * from self where self_ms >= 5 and span_kind='server'",
    "per": f"""select incident_id, service, coalesce({p95('self_ms', 'not after')}, 0.0) as pre, {p95('self_ms', 'after')} as post,
      max(self_ms) filter (where after) as mx, min(row(time, trace_id, span_id)) filter (where after) as seen from kept group by 1, 2""",
    "ranked": """select *, row_number() over (partition by incident_id order by post - pre desc, seen) as r from per where post is not null""",
}


@query("t3_latency_origin", with_views("spans", "incidents", extra=_SELF, body="""
select i.incident_id, case when post - pre >= 5 then service end as service,
  round(case when post - pre >= 5 then post end, 6) as self_latency_p95_ms,
  round(case when post - pre >= 5 then pre end, 6) as baseline_p95_ms,
  round(case when post - pre >= 5 then mx end, 6) as self_latency_max_ms
from incidents i left join ranked r on r.incident_id = i.incident_id and r.r = 1"""))
def _(t: Telemetry) -> DataFrame:
    found = spans.latency_origin(t.spans, t.incidents, min_self_ms=5.0)
    return found.select("incident_id", "service", *[
        round6(c).alias(c) for c in ("self_latency_p95_ms", "baseline_p95_ms", "self_latency_max_ms")])


_SHIFTS = RESOLVED | {
    "calls": """select r.*, time >= onset_second as after from resolved r join incidents using (incident_id)
      where span_kind='client' and callee <> '' and callee <> service""",
    "shift": f"""select incident_id, service as caller, callee, coalesce({p95(condition='not after')}, 0.0) as pre_p95_ms,
      coalesce({p95(condition='after')}, 0.0) as post_p95_ms, count(*) filter (where after) as post_samples from calls group by 1, 2, 3""",
    "deg": "select *, post_p95_ms - pre_p95_ms as ms from shift where post_p95_ms - pre_p95_ms >= 20 and post_samples > 0",
}


@query("t4_degraded_edges", with_views("spans", "incidents", extra=_SHIFTS, body="""
select incident_id, caller, callee, round(pre_p95_ms, 6) as pre_p95_ms, round(post_p95_ms, 6) as post_p95_ms,
  round(ms, 6) as shift_ms, post_samples, row_number() over (partition by incident_id order by ms desc, caller, callee) as position
from deg qualify position <= 20"""))
def _(t: Telemetry) -> DataFrame:
    found = spans.degraded_edges(t.spans, t.incidents, min_shift_ms=20.0)
    return found.select("incident_id", "caller", "callee", "post_samples", "position", *[
        round6(c).alias(c) for c in ("pre_p95_ms", "post_p95_ms", "shift_ms")])


_EXPLAIN = _SHIFTS | {
    "reach": """select incident_id, caller as node, callee as reached from deg union
      select r.incident_id, r.node, d.callee from reach r join deg d on d.incident_id=r.incident_id and d.caller=r.reached""",
    "expl": """select distinct incident_id, caller, callee, ms, callee as x from deg
      union select incident_id, caller, callee, ms, caller from deg
      union select d.incident_id, d.caller, d.callee, d.ms, r.reached from deg d join reach r on r.incident_id=d.incident_id and r.node=d.callee""",
    "score": """select e.incident_id, e.x, round(sum(e.ms) / max(tot.total), 9) as explained_ratio, max(i.n) as inbound,
        max(i.n) / max(c.n) as coverage, max(i.loud) as loud, max(tot.n) as degraded_edges
      from expl e join (select incident_id, sum(ms) as total, count(*) as n from deg group by 1) tot using (incident_id)
      join (select incident_id, callee as x, count(*) as n, max(ms) as loud from deg group by 1, 2) i using (incident_id, x)
      join (select incident_id, callee as x, count(*) as n from shift group by 1, 2) c using (incident_id, x) group by 1, 2""",
    "best": "select *, row_number() over (partition by incident_id order by explained_ratio desc, coverage desc, inbound desc, loud desc, x) as r from score",
    "own": f"""select s.incident_id, s.service as x, coalesce({p95(condition='time >= onset_second')}, 0.0)
      - coalesce({p95(condition='time < onset_second')}, 0.0) as own from spans s join incidents using (incident_id) where span_kind='server' group by 1, 2""",
}


@query("t4_edge_latency_origin", with_views("spans", "incidents", extra=_EXPLAIN, body="""
select i.incident_id, b.x as origin_service,
  case when b.x is null then null when coalesce(own, 0.0) < 20 then 'network_edge' else 'service_internal' end as classification,
  round(explained_ratio, 6) as explained_ratio, round(coverage, 6) as coverage, inbound, degraded_edges,
  round(case when b.x is not null then coalesce(own, 0.0) end, 6) as own_shift_ms
from incidents i left join best b on b.incident_id=i.incident_id and b.r=1 left join own o on o.incident_id=i.incident_id and o.x=b.x"""))
def _(t: Telemetry) -> DataFrame:
    found = spans.edge_latency_origin(t.spans, t.incidents, min_shift_ms=20.0)
    return found.select("incident_id", "origin_service", "classification", "inbound", "degraded_edges", *[
        round6(c).alias(c) for c in ("explained_ratio", "coverage", "own_shift_ms")])


@query("t4_edge_roles", with_views("spans", "incidents", extra=_EXPLAIN, body="""
select d.incident_id, b.x as origin_service, d.caller, d.callee, round(d.ms, 6) as shift_ms,
  case when d.caller = b.x then 'own_outbound' when d.callee = b.x then 'into_origin'
    when exists (select 1 from reach r where r.incident_id = d.incident_id and r.node = d.callee and r.reached = b.x) then 'victim_path'
    else 'not_explained' end as role
from deg d join best b on b.incident_id = d.incident_id and b.r = 1"""))
def _(t: Telemetry) -> DataFrame:
    return spans.edge_roles(t.spans, t.incidents, min_shift_ms=20.0).withColumn("shift_ms", round6("shift_ms"))


@query("t5_emission_gaps", with_views("spans", "incidents", extra={
    "active": "select distinct incident_id, service, cast(floor(time/600) as bigint) as b from spans",
    "nexts": """select *, lead(b) over (partition by incident_id, service order by b) as nxt,
      count(*) over (partition by incident_id, service) as n from active""",
    "gaps": """select incident_id, service, (b+1)*600 as gap_start_second, coalesce(nxt*600, window_end) as gap_end_second, nxt is not null as resumed
      from nexts join incidents using (incident_id) where n >= 2 and (nxt - b > 1 or (nxt is null and b < cast(floor(window_end/600) as bigint) - 1))"""},
    body="""select incident_id, service, gap_start_second, gap_end_second, resumed, row_number() over (partition by incident_id
  order by gap_end_second - gap_start_second desc, service, gap_start_second) as position from gaps qualify position <= 30"""))
def _(t: Telemetry) -> DataFrame:
    return spans.emission_gaps(t.spans, t.incidents, bucket=600)


_DEPTH = {
    "depths": """select incident_id, span_id, 0 as depth from spans s where not exists
        (select 1 from spans p where p.incident_id=s.incident_id and p.span_id=s.parent_span_id)
      union all select s.incident_id, s.span_id, d.depth+1 from depths d join spans s on s.incident_id=d.incident_id and s.parent_span_id=d.span_id"""
}
_ORIGIN = RESOLVED | _DEPTH | {
    "err": "select * from resolved where status='ERROR'",
    "leaf": "select * from err e where not exists (select 1 from err c where c.incident_id=e.incident_id and c.parent_span_id=e.span_id)",
    "deep": "select l.*, d.depth, max(d.depth) over (partition by l.incident_id) as top from leaf l join depths d using (incident_id, span_id)",
    "fails": "select distinct incident_id, service as callee, true as f from err where span_kind='server'",
    "votes": """select p.incident_id, p.depth, case when span_kind='client' and f is null then 'edge' else 'service' end as classification,
        case when span_kind='client' and f is null then null when span_kind='client' then p.callee else service end as service,
        case when span_kind='client' and f is null then service end as caller,
        case when span_kind='client' and f is null then p.callee end as callee, count(*) as votes, min(row(time, trace_id, span_id)) as seen
      from (select * replace (coalesce(callee, 'unknown') as callee) from deep where depth=top) p left join fails using (incident_id, callee) group by all""",
    "won": "select *, row_number() over (partition by incident_id order by votes desc, seen) as r from votes",
}


@query("t6_error_origin", with_views("spans", extra=_ORIGIN, body="""
select i.incident_id, coalesce(classification, 'unknown') as classification, service, caller, callee, depth, votes, e.first_error_second, e2.frontier_spans
from (select distinct incident_id from spans) i left join (select * from won where r=1) w using (incident_id)
left join (select incident_id, min(time) as first_error_second from err group by 1) e using (incident_id)
left join (select incident_id, count(*) as frontier_spans from deep where depth=top group by 1) e2 using (incident_id)"""))
def _(t: Telemetry) -> DataFrame:
    return spans.error_origin(t.spans).select(
        "incident_id", "classification", "service", "caller", "callee", "depth", "votes", "first_error_second", "frontier_spans")


@query("t7_find_spans", with_views("spans", body="""
select incident_id, span_id, time, service, operation, row_number() over (partition by incident_id order by time, trace_id, span_id) as position,
  count(*) over (partition by incident_id) as total_matched, count(*) over (partition by incident_id) > 50 as truncated
from spans where span_kind='server' and status='ERROR' qualify position <= 50"""))
def _(t: Telemetry) -> DataFrame:
    found = spans.find_spans(t.spans, span_kind="server", status="ERROR")
    return found.select("incident_id", "span_id", "time", "service", "operation", "position", "total_matched", "truncated")


@query("t8_trace_listing", with_views("spans", extra=RESOLVED | _ERROR_TRACES, body="""
select incident_id, trace_id, span_id, service, case when span_kind='client' then callee end as callee, status
from resolved where (incident_id, trace_id) in (select incident_id, trace_id from bad)"""))
def _(t: Telemetry) -> DataFrame:
    return spans.fetch_traces(t.spans, error_traces(t)).select("incident_id", "trace_id", "span_id", "service", "callee", "status")


@query("t9_slowest_operations", with_views("spans", extra={
    "g": f"""select incident_id, service, operation, span_kind, count(*) as count, {p95()} as p95_ms, max(duration_ms) as max_ms,
      min(row(time, trace_id, span_id)) as seen from spans where time >= 216000 group by 1, 2, 3, 4"""}, body="""
select incident_id, service, operation, span_kind, count, round(p95_ms, 6) as p95_ms, round(max_ms, 6) as max_ms,
  row_number() over (partition by incident_id order by g.p95_ms desc, seen) as position from g qualify position <= 10"""))
def _(t: Telemetry) -> DataFrame:
    found = spans.slowest_operations(t.spans, start=216000)
    return found.withColumn("p95_ms", round6("p95_ms")).withColumn("max_ms", round6("max_ms"))


@query("t10_error_summary", with_views("spans", extra=RESOLVED, body="""
select incident_id, service, span_kind as role, case when span_kind='client' then callee end as callee, count(*) as error_count
from resolved where status='ERROR' and time >= 216000 group by all"""))
def _(t: Telemetry) -> DataFrame:
    return spans.error_summary(t.spans, start=216000).drop("first_seen")


@query("t11_span_tree", with_views("spans", extra=_ERROR_TRACES | {
    "walk": """select s.incident_id, s.trace_id, s.span_id, 0 as depth, [row(s.time, s.span_id)] as path from spans s
        join bad using (incident_id, trace_id) where not exists (select 1 from spans p where p.incident_id=s.incident_id and p.trace_id=s.trace_id and p.span_id=s.parent_span_id)
      union all select s.incident_id, s.trace_id, s.span_id, w.depth+1, list_append(w.path, row(s.time, s.span_id))
        from walk w join spans s on s.incident_id=w.incident_id and s.trace_id=w.trace_id and s.parent_span_id=w.span_id"""}, body="""
select incident_id, trace_id, span_id, depth, row_number() over (partition by incident_id, trace_id order by path) - 1 as position, service, operation
from walk join spans using (incident_id, trace_id, span_id)"""))
def _(t: Telemetry) -> DataFrame:
    return spans.span_tree(t.spans, error_traces(t)).select(
        "incident_id", "trace_id", "span_id", "depth", "position", "service", "operation")


@query("t12_latency_breakdown", with_views("spans", extra=_ERROR_TRACES | {
    "picked": "select * from spans join bad using (incident_id, trace_id)",
    "roots": """select incident_id, trace_id, max(duration_ms) as root from picked s where not exists
      (select 1 from picked p where p.incident_id=s.incident_id and p.trace_id=s.trace_id and p.span_id=s.parent_span_id) group by 1, 2"""}, body="""
select incident_id, trace_id, span_id, service, operation, duration_ms, root as root_duration_ms,
  round(case when root <> 0 then duration_ms / root else 0.0 end, 6) as pct_of_root from picked join roots using (incident_id, trace_id)"""))
def _(t: Telemetry) -> DataFrame:
    return spans.latency_breakdown(t.spans, error_traces(t)).withColumn("pct_of_root", round6("pct_of_root"))


@query("t13_compare_pre_post", with_views("spans", "incidents", body="""
select i.incident_id,
  arg_min(trace_id, row(time, trace_id, span_id)) filter (where status='OK' and time <= onset_second - 1) as healthy_trace_id,
  arg_min(trace_id, row(time, trace_id, span_id)) filter (where status='ERROR' and time >= onset_second) as failing_trace_id
from incidents i left join (select * from spans where contains(operation, 'op')) s using (incident_id) group by 1"""))
def _(t: Telemetry) -> DataFrame:
    return spans.compare_pre_post(t.spans, t.incidents, "op").drop("note")


@query("t14_service_summary", with_views("spans", body=f"""
select incident_id, service, count(*) as total_spans, count(*) filter (where status='ERROR') as error_spans,
  count(*) filter (where status='ERROR' and span_kind='server') as server_error_spans,
  round(count(*) filter (where status='ERROR') / count(*), 6) as error_rate, round({p95()}, 6) as p95_ms from spans group by 1, 2"""))
def _(t: Telemetry) -> DataFrame:
    found = spans.service_summary(t.spans)
    return found.withColumn("error_rate", round6("error_rate")).withColumn("p95_ms", round6("p95_ms"))
