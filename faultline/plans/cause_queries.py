"""Queries G1-G10 and R1-R12."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.operators import graph, hypothesis, paths, ranking, spans
from faultline.plans.registry import query
from faultline.plans.signal_queries import rounded
from faultline.plans.span_queries import _DEPTH
from faultline.plans.sqltext import EDGES, ONSET_EFFECTS, RESOLVED, STATIC
from faultline.plans.views import Telemetry, with_views

_REACH = {
    "down": """select incident_id, caller as node, callee as reached from edges
      union select d.incident_id, d.node, e.callee from down d join edges e on e.incident_id=d.incident_id and e.caller=d.reached""",
}
_SVC = {"svc": "select distinct incident_id, service from spans"}


def _list(expr: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(distinct {expr})), ','), '')"


def _paths(edge: str) -> dict[str, str]:
    """All simple shortest-path candidates from each source, kept to the first level per target."""
    return {
        "walk": f"""select incident_id, source, source as target, [source] as path from srcs
          union all select w.incident_id, w.source, e.callee, list_append(w.path, e.callee) from walk w
            join {edge} e on e.incident_id=w.incident_id and e.caller=w.target where not list_contains(w.path, e.callee)""",
        "shortest": "select incident_id, source, target, arg_min(path, row(len(path), path)) as path from walk group by 1, 2, 3",
    }


@query("g1_span_depth", with_views("spans", extra=_DEPTH, body="select incident_id, span_id, depth from depths"))
def _(t: Telemetry) -> DataFrame:
    return paths.span_depths(t.spans)


@query("g2_transitive_closure", with_views("spans", extra=EDGES | _REACH, body="""
select incident_id, node, reached from down where node <> reached"""))
def _(t: Telemetry) -> DataFrame:
    return graph.transitive_closure(spans.call_edges(t.spans))


@query("g3_shortest_path", with_views("spans", extra=EDGES | {
    "srcs": "select distinct incident_id, caller as source from edges"} | _paths("edges"), body="""
select incident_id, source, target, array_to_string(path, '>') as path from shortest"""))
def _(t: Telemetry) -> DataFrame:
    edges = spans.call_edges(t.spans)
    found = graph.shortest_paths(edges, edges.select("incident_id", F.col("caller").alias("source")))
    return found.withColumn("path", F.array_join("path", ">"))


@query("g4_filtered_edges", with_views("spans", extra=RESOLVED, body="""
select distinct incident_id, service as caller, callee from resolved where span_kind='client' and status='ERROR' and callee <> service
  and time >= 100000 and time < 300000"""))
def _(t: Telemetry) -> DataFrame:
    return spans.call_edges(t.spans, error_only=True, since=F.lit(100000), before=F.lit(300000))


@query("g5_dependencies", with_views("spans", extra=EDGES | _SVC, body=f"""
select s.incident_id, s.service, {_list('a.caller')} as callers, {_list('b.callee')} as callees from svc s
left join edges a on a.incident_id=s.incident_id and a.callee=s.service left join edges b on b.incident_id=s.incident_id and b.caller=s.service group by 1, 2"""))
def _(t: Telemetry) -> DataFrame:
    services = t.spans.select("incident_id", "service").distinct()
    found = graph.dependencies(spans.call_edges(t.spans), services)
    return found.withColumn("callers", F.array_join("callers", ",")).withColumn("callees", F.array_join("callees", ","))


@query("g6_blast_radius", with_views("spans", extra=EDGES | _REACH | _SVC, body=f"""
select s.incident_id, s.service, {_list('a.node')} as upstream, {_list('b.reached')} as downstream from svc s
left join down a on a.incident_id=s.incident_id and a.reached=s.service and a.node <> s.service
left join down b on b.incident_id=s.incident_id and b.node=s.service and b.reached <> s.service group by 1, 2"""))
def _(t: Telemetry) -> DataFrame:
    services = t.spans.select("incident_id", "service").distinct()
    found = graph.blast_radius(spans.call_edges(t.spans), services)
    return found.withColumn("upstream", F.array_join("upstream", ",")).withColumn("downstream", F.array_join("downstream", ","))


@query("g7_critical_path", with_views("spans", extra=EDGES | _SVC | {
    "srcs": "select distinct incident_id, 'frontend' as source from spans"} | _paths("edges"), body="""
select s.incident_id, 'frontend' as source, s.service as target, coalesce(array_to_string(path, '>'), '') as path, path is not null as found
from svc s left join shortest p on p.incident_id=s.incident_id and p.target=s.service"""))
def _(t: Telemetry) -> DataFrame:
    targets = t.spans.select("incident_id", F.col("service").alias("target")).distinct()
    return graph.critical_path(spans.call_edges(t.spans), targets).withColumn("path", F.array_join("path", ">"))


_BAD = RESOLVED | {
    "bad": "select distinct incident_id, service as caller, callee from resolved where span_kind='client' and status='ERROR' and callee <> service",
    "srcs": """select incident_id, min(caller) as source from bad b where not exists (select 1 from bad x where x.incident_id=b.incident_id and x.callee=b.caller) group by 1""",
    "ends": """select incident_id, coalesce(min(callee) filter (where not exists (select 1 from bad x where x.incident_id=b.incident_id and x.caller=b.callee)), min(callee)) as terminal
      from bad b group by 1""",
    "own": "select distinct incident_id, service as terminal, true as f from spans where status='ERROR' and span_kind='server'",
} | _paths("bad")


@query("g8_propagation_origin", with_views("spans", "incidents", extra=_BAD, body="""
select i.incident_id, case when e.terminal is null then 'unknown' when f then 'service' else 'edge' end as classification,
  case when f then e.terminal end as origin_service, e.terminal, coalesce(array_to_string(case when s.source is null then [e.terminal] else path end, '>'), '') as path,
  coalesce(f, false) as terminal_has_server_error
from incidents i left join ends e using (incident_id) left join srcs s using (incident_id)
left join shortest p on p.incident_id=i.incident_id and p.source=s.source and p.target=e.terminal left join own o on o.incident_id=i.incident_id and o.terminal=e.terminal"""))
def _(t: Telemetry) -> DataFrame:
    return graph.propagation_origin(t.spans).withColumn("path", F.array_join("path", ">"))


@query("g9_new_error_edges", with_views("spans", "incidents", extra=RESOLVED | {
    "b": "select r.*, time >= onset_second as after from resolved r join incidents using (incident_id) where span_kind='client' and status='ERROR' and callee <> service"},
    body="""select distinct incident_id, service as caller, callee from b where after
  except select incident_id, service, callee from b where not after"""))
def _(t: Telemetry) -> DataFrame:
    return graph.new_error_edges(t.spans, t.incidents)


@query("g10_topology_source", with_views("spans", "incidents", extra=EDGES | STATIC, body="""
select incident_id, caller, callee, 'static' as source from static_edges
union all select concat(incident_id, '_traced'), caller, callee, 'trace' from edges"""))
def _(t: Telemetry) -> DataFrame:
    """Every incident has static edges; a copy of each, under its own id, has traces only."""
    seen = spans.call_edges(t.spans)
    copies = seen.withColumn("incident_id", F.concat("incident_id", F.lit("_traced")))
    return graph.resolve_topology(t.static_edges, seen.unionByName(copies)).select("incident_id", "caller", "callee", "source")


# ---- ranking --------------------------------------------------------------------------------

_FX = ONSET_EFFECTS | {
    "fx": """select incident_id, service, greatest(0.0, coalesce(max(effect_z) filter (where metric='cpu_cores'), 0.0)) as z_resource,
      greatest(0.0, coalesce(max(effect_z) filter (where metric='latency_p95_ms'), 0.0)) as z_latency,
      greatest(0.0, coalesce(max(effect_z) filter (where metric='request_error_rate'), 0.0)) as z_error from shifts group by all"""}
_RANK = EDGES | _FX | {
    "node": """select n.incident_id, n.service, coalesce(z_resource, 0.0) as zr, coalesce(z_latency, 0.0) as zl, coalesce(z_error, 0.0) as ze,
        greatest(coalesce(z_resource, 0.0), coalesce(z_latency, 0.0), coalesce(z_error, 0.0)) as zt,
        not exists (select 1 from edges e where e.incident_id=n.incident_id and e.callee=n.service) as demoted
      from (select incident_id, caller as service from edges union select incident_id, callee from edges) n left join fx using (incident_id, service)""",
    "reg": """select incident_id, case when max(zt) < 3 then 'none' when max(zr)=max(zt) then 'resource' when max(zl)=max(zt) then 'latency' else 'error' end as regime from node group by 1""",
    "hood": """select incident_id, caller as service, callee as near from edges union select incident_id, callee, caller from edges union select incident_id, service, service from node""",
    "cov": """select h.incident_id, h.service, round(sum(n.zl) / max(a.total), 9) as coverage from hood h join node n on n.incident_id=h.incident_id and n.service=h.near and n.zl >= 3
      join node self on self.incident_id=h.incident_id and self.service=h.service and self.zl >= 3
      join (select incident_id, sum(zl) as total from node where zl >= 3 group by 1) a on a.incident_id=h.incident_id group by 1, 2""",
    "full_": """select n.*, r.regime, coalesce(c.coverage, 0.0) as coverage, max(c.coverage) over (partition by n.incident_id) as best,
      exists (select 1 from edges e join node m on m.incident_id=e.incident_id and m.service=e.callee and m.ze >= 3 where e.incident_id=n.incident_id and e.caller=n.service) as blames
      from node n join reg r using (incident_id) left join cov c using (incident_id, service)""",
    "first_": """select *, row_number() over (partition by incident_id order by
       case regime when 'none' then -round(zt, 9) when 'resource' then -round(zr, 9) when 'latency' then (zl < 3)::int else (ze < 3)::int end,
       case regime when 'none' then demoted::int when 'resource' then 0 when 'latency' then (coverage < best - 0.05)::int else (ze < 3 or blames)::int end,
       case regime when 'none' then 0.0 when 'resource' then -round(zt, 9) else demoted::int end,
       case regime when 'latency' then -coverage when 'error' then -round(ze, 9) else 0.0 end,
       case regime when 'latency' then -round(zt, 9) else 0.0 end, service) as r from full_""",
    "lift": """select d.incident_id, arg_min(m.service, row(-round(greatest(m.zl, m.zr), 9), m.service)) as origin from first_ d
      join edges e on e.incident_id=d.incident_id and e.caller=d.service join node m on m.incident_id=e.incident_id and m.service=e.callee
      where d.r=1 and d.regime='error' and d.ze >= 3 and greatest(m.zl, m.zr) >= 3 and m.ze < 3 group by 1""",
    "ranked": """select f.*, row_number() over (partition by incident_id order by case when service = origin then 0 else 1 end, r) as rank
      from first_ f left join lift using (incident_id)""",
    "dom": """select *, case when zr = zt then 'resource' when zl = zt then 'latency' else 'error' end as family from ranked""",
}


def effects(t: Telemetry) -> DataFrame:
    return ranking.onset_effects(t.metrics, t.incidents)


def ranked(t: Telemetry) -> DataFrame:
    return ranking.rank_services(spans.call_edges(t.spans), effects(t))


@query("r1_onset_effects", with_views("metrics", "incidents", extra=_FX, body="""
select incident_id, service, unnest(['resource', 'latency', 'error']) as family, unnest([round(z_resource, 6), round(z_latency, 6), round(z_error, 6)]) as z from fx"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(ranking.effects_long(effects(t)), "z")


@query("r2_onset_signatures", with_views("metrics", "incidents", extra=_FX, body="""
select incident_id, service, z_resource >= 3 as resource, z_latency >= 3 as latency, z_error >= 3 as error from fx"""))
def _(t: Telemetry) -> DataFrame:
    return ranking.signatures(effects(t))


@query("r3_rank_services", with_views("metrics", "incidents", extra=_RANK, body="""
select incident_id, service, rank, regime, round(zr, 6) as z_resource, round(zl, 6) as z_latency, round(ze, 6) as z_error, round(coverage, 6) as coverage,
  demoted, zt >= 3 as anomalous from ranked"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(ranked(t), "z_resource", "z_latency", "z_error", "coverage")




@query("r3_rank_error_regime", with_views("metrics", "incidents", extra=_RANK | {
    "fx": """select incident_id, service, 0.0 as z_resource, case when service in ('payment', 'shipping') then z_latency + 4.0 else z_latency end as z_latency,
      z_error + z_latency + case when service in ('frontend', 'checkout') then 40.0 else 0.0 end as z_error from (
      select incident_id, service, coalesce(max(effect_z) filter (where metric='latency_p95_ms'), 0.0) as z_latency,
        coalesce(max(effect_z) filter (where metric='request_error_rate'), 0.0) as z_error from shifts group by all)"""}, body="""
select incident_id, service, rank, regime from ranked"""))
def _(t: Telemetry) -> DataFrame:
    """The error regime, reached by shifting the measured effects: callers fail, callees slow down."""
    shifted = effects(t).select(
        "incident_id", "service", F.lit(0.0).alias("z_resource"),
        (F.col("z_latency") + F.when(F.col("service").isin("payment", "shipping"), 4.0).otherwise(0.0)).alias("z_latency"),
        (F.col("z_error") + F.col("z_latency") + F.when(F.col("service").isin("frontend", "checkout"), 40.0).otherwise(0.0)).alias("z_error"))
    return ranking.rank_services(spans.call_edges(t.spans), shifted).select("incident_id", "service", "rank", "regime")


@query("r4_anomalous_services", with_views("metrics", "incidents", extra=_FX, body="""
select incident_id, service from fx where greatest(z_resource, z_latency, z_error) >= 3"""))
def _(t: Telemetry) -> DataFrame:
    return ranking.anomalous(effects(t))


@query("r5_localise", with_views("metrics", "incidents", extra=_RANK | {
    "wd": "select *, row_number() over (partition by incident_id, zt >= 3 and rank > 1 order by service) as v from dom"}, body="""
select d.incident_id, d.service as root_cause_service, case when zt > 0 then family end as signature,
  case when zt > 0 then case family when 'resource' then 'resource saturation' when 'latency' then 'latency/slowdown' else 'errors' end end as fault_type,
  round(zt, 6) as effect_z, round(zt - coalesce(a.nxt, 0.0), 6) as rank_margin, regime, a.ranked_services,
  concat(d.service, ' shows a ', case when zt > 0 then family else 'anomalous' end, ' step at onset (z=', printf('%.0f', zt), '); ranked #1 of ', a.n, ' live services by effect size',
    case when v.t is null then '' else concat('; downstream victims inheriting the symptom: ', v.t) end) as evidence
from dom d join (select incident_id, count(*) as n, max(zt) filter (where rank=2) as nxt, string_agg(service, ',' order by rank) filter (where rank <= 5) as ranked_services from dom group by 1) a using (incident_id)
left join (select incident_id, string_agg(concat(service, ' (z=', printf('%.0f', zt), ')'), ', ' order by v) as t from wd where zt >= 3 and rank > 1 and v <= 3 group by 1) v using (incident_id)
where d.rank = 1"""))
def _(t: Telemetry) -> DataFrame:
    return ranking.localise(ranked(t))


def verdicts(t: Telemetry) -> DataFrame:
    """One verdict per service of every incident, refuting most and guessing its signature."""
    return t.spans.select("incident_id", F.col("service").alias("candidate_service")).distinct().select(
        "incident_id", "candidate_service", F.col("candidate_service").isin("frontend", "cart").alias("supported"),
        F.when(F.col("candidate_service") < "m", "error").otherwise("latency").alias("signature"))


_VERDICTS = {"verdicts": """select distinct incident_id, service as candidate_service, service in ('frontend', 'cart') as supported,
  case when service < 'm' then 'error' else 'latency' end as signature from spans"""}


@query("r6_reconcile_verdicts", with_views("metrics", "incidents", extra=_RANK | _VERDICTS, body="""
select incident_id, candidate_service, case when zt >= 3 then true else supported end as supported, case when zt >= 3 then
    case when z_resource = zt then 'resource' when z_latency = zt then 'latency' else 'error' end else signature end as signature,
  case when zt >= 3 or supported then candidate_service end as root_cause_service,
  case when zt >= 3 then z_resource >= 3 end as observed_resource, case when zt >= 3 then z_latency >= 3 end as observed_latency, case when zt >= 3 then z_error >= 3 end as observed_error
from verdicts left join (select *, service as candidate_service, greatest(z_resource, z_latency, z_error) as zt from fx) using (incident_id, candidate_service)"""))
def _(t: Telemetry) -> DataFrame:
    return ranking.reconcile_verdicts(verdicts(t), effects(t))


@query("r7_missed_origins", with_views("metrics", "incidents", extra=_RANK, body="""
select incident_id, service, rank, family as signature from dom where rank <= 3 and zt >= 3 and service not in ('frontend', 'cart')"""))
def _(t: Telemetry) -> DataFrame:
    return ranking.missed_origins(ranked(t), verdicts(t).where("supported"))


@query("r8_final_pick", with_views("metrics", "incidents", extra=_RANK | _VERDICTS | {
    "marked": "select d.*, coalesce(not v.supported, false) and zt < 3 as out from dom d left join verdicts v on v.incident_id=d.incident_id and v.candidate_service=d.service",
    "kept": "select *, row_number() over (partition by incident_id order by rank) as final_rank from (select *, bool_and(out) over (partition by incident_id) as none_left from marked) where not out or none_left"},
    body="""select incident_id, service, final_rank, case when zt >= 3 then case family when 'resource' then 'resource saturation' when 'latency' then 'latency/slowdown' else 'errors' end end as fault_type
from kept where final_rank <= 5"""))
def _(t: Telemetry) -> DataFrame:
    return ranking.final_pick(ranked(t), verdicts(t))


# ---- hypotheses -----------------------------------------------------------------------------

_SIG = RESOLVED | ONSET_EFFECTS | {
    "sig": """select incident_id, service, coalesce(n, 0) as server_errors, coalesce(er, 0.0) as error_rise, coalesce(lr, 0.0) as latency_rise, coalesce(rr, 0) as resource_rises from
      (select incident_id, service, count(*) as n from spans where status='ERROR' and span_kind='server' group by 1, 2) full join
      (select incident_id, service, max(post_mean - pre_mean) filter (where metric='request_error_rate') as er, max(post_mean - pre_mean) filter (where metric='latency_p95_ms') as lr,
        count(*) filter (where metric='cpu_cores' and post_mean - pre_mean > 1.0) as rr from shifts group by 1, 2) using (incident_id, service)""",
    "hyp": """select incident_id, concat('h_', service) as id, 'service' as kind, service, cast(null as varchar) as caller, cast(null as varchar) as callee from (select distinct incident_id, service from spans)
      union all select distinct incident_id, concat('e_', service, '_', callee), 'edge', null, service, callee from resolved where span_kind='client' and callee <> service""",
}


def hypotheses(t: Telemetry) -> DataFrame:
    """Every service and every call edge as a hypothesis."""
    none = F.lit(None).cast("string")
    services = t.spans.select("incident_id", "service").distinct().select(
        "incident_id", F.concat(F.lit("h_"), "service").alias("id"), F.lit("service").alias("kind"), "service",
        none.alias("caller"), none.alias("callee"))
    edges = spans.call_edges(t.spans).select(
        "incident_id", F.concat(F.lit("e_"), "caller", F.lit("_"), "callee").alias("id"), F.lit("edge").alias("kind"),
        none.alias("service"), "caller", "callee")
    return services.unionByName(edges)


def malformed_hypotheses(t: Telemetry) -> DataFrame:
    """Per incident a service hypothesis without a service and one of an unknown kind."""
    none = F.lit(None).cast("string")
    kinds = t.spans.select("incident_id").distinct().withColumn("kind", F.explode(F.array(F.lit("service"), F.lit("guess"))))
    return kinds.select("incident_id", F.concat(F.lit("m_"), "kind").alias("id"), "kind", none.alias("service"), none.alias("caller"), none.alias("callee"))


@query("r9_gather_evidence", with_views("metrics", "changes", "incidents", extra=_SIG | {
    "allhyp": """select * from hyp union all select incident_id, concat('m_', kind), kind, null, null, null
      from (select distinct incident_id from spans) cross join (select unnest(['service', 'guess']) as kind)""",
    "ce": "select incident_id, service as caller, callee, count(*) as client_errors from resolved where status='ERROR' and span_kind='client' and callee is not null group by 1, 2, 3",
    "j": """select h.incident_id, h.id, h.kind, coalesce(h.service, h.caller) as service, coalesce(s.server_errors, 0) as own, coalesce(c.client_errors, 0) as nc, coalesce(k.server_errors, 0) as ns,
      coalesce(s.error_rise > 0.02 or s.latency_rise > 100 or s.resource_rises > 0, false) as moved from allhyp h
      left join sig s on s.incident_id=h.incident_id and s.service=h.service left join sig k on k.incident_id=h.incident_id and k.service=h.callee
      left join ce c on c.incident_id=h.incident_id and c.caller=h.caller and c.callee=h.callee""",
    "near": "select c.incident_id, c.service, arg_min(c.id, row(-c.time, c.id)) as suspect from changes c join incidents using (incident_id) where c.time < onset_second group by 1, 2"},
    body="""select incident_id, id, kind, service, case when id like 'm_%' then false when kind='service' then own > 0 or moved else nc > 0 and ns = 0 end as supported,
  case when id like 'm_%' then 0.0e0 when kind='service' then case when own > 0 then 0.9e0 when moved then 0.6e0 else 0.1e0 end when nc > 0 and ns = 0 then 0.8e0 when nc > 0 then 0.3e0 else 0.0e0 end as confidence,
  case when id like 'm_%' then null when kind='service' then own else ns end as server_errors, suspect as suspect_change_id from j left join near using (incident_id, service)"""))
def _(t: Telemetry) -> DataFrame:
    return hypothesis.gather_evidence(hypotheses(t).union(malformed_hypotheses(t)), t.spans, t.metrics, t.changes, t.incidents).drop("client_errors")


@query("r10_rule_out_services", with_views("metrics", "incidents", extra=_SIG, body="""
select incident_id, service, not (server_errors > 0 or latency_rise > 100 or resource_rises > 0) as ruled_out from sig"""))
def _(t: Telemetry) -> DataFrame:
    return hypothesis.rule_out_services(t.spans, t.metrics, t.incidents).drop("reason")


@query("r10_rule_out_changes", with_views("changes", "incidents", body="""
select incident_id, id, time >= onset_second as ruled_out from changes join incidents using (incident_id)"""))
def _(t: Telemetry) -> DataFrame:
    return hypothesis.rule_out_changes(t.changes, t.incidents).drop("reason")


_EVIDENCE = ONSET_EFFECTS | {
    "sus": """select t.incident_id, t.service, max(c.id) as culprit from truth t left join changes c on c.incident_id=t.incident_id and c.service=t.service group by 1, 2"""}
_EVIDENCE_LINES = """select incident_id, 0 as section, concat(service, ' own server spans error (', count(*), '): a service-fault signal') as line from spans join sus using (incident_id, service)
  where status='ERROR' and span_kind='server' group by incident_id, service
union all select incident_id, case metric when 'request_error_rate' then 1 when 'latency_p95_ms' then 2 else 3 end,
  concat(service, ' ', case metric when 'request_error_rate' then 'error rate' when 'latency_p95_ms' then 'p95 latency' else 'cpu cores' end, ' rose from ', printf('%.2f', pre_mean), ' to ', printf('%.2f', post_mean), ' after onset')
  from shifts join sus using (incident_id, service) where post_mean - pre_mean > case metric when 'request_error_rate' then 0.02 when 'latency_p95_ms' then 100.0 else 1.0 end
union all select c.incident_id, 9, concat('culprit ', c.id, ' on ', c.service, ' at second ', c.time, ' precedes onset ', onset_second, ': ', summary)
  from changes c join sus on sus.incident_id=c.incident_id and sus.culprit=c.id join incidents i on i.incident_id=c.incident_id"""


def suspects(t: Telemetry) -> DataFrame:
    culprit = t.changes.groupBy("incident_id", "service").agg(F.max("id").alias("culprit_change_id"))
    return t.truth.join(culprit, ["incident_id", "service"], "left").select("incident_id", "service", "culprit_change_id")


@query("r11_evidence_lines", with_views("metrics", "changes", "incidents", "truth", extra=_EVIDENCE, body=_EVIDENCE_LINES))
def _(t: Telemetry) -> DataFrame:
    found = hypothesis.evidence_lines(suspects(t), t.spans, t.metrics, t.changes, t.incidents)
    return found.select("incident_id", "section", "line")


@query("r11_evidence_bundle", with_views("metrics", "changes", "incidents", "truth", extra=_EVIDENCE | {"ln": _EVIDENCE_LINES}, body="""
select sus.incident_id, service, culprit as culprit_change_id, (select string_agg(line, '|' order by section) from ln where ln.incident_id=sus.incident_id) as evidence,
  1 + (select count(*) from changes c where c.incident_id=sus.incident_id) as timeline_entries from sus"""))
def _(t: Telemetry) -> DataFrame:
    """The timeline holds every change and the onset."""
    found = hypothesis.evidence_bundle(suspects(t), t.spans, t.metrics, t.changes, t.incidents)
    return found.withColumn("evidence", F.array_join("evidence", "|"))


_BOOK = ", ".join(f"({i}, '{rid}', {ks!r})" for i, (rid, _, ks) in enumerate(hypothesis.RUNBOOKS))


@query("r12_runbook_match", f"""
with book(place, id, keywords) as (values {_BOOK}), q as (select doc_id, text from documents),
terms as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 3)) as ts from q),
sc as (select doc_id, id, place, len(list_filter(ts, lambda t: len(list_filter(keywords, lambda k: contains(k, t) or contains(t, k))) > 0)) as score from terms, book),
top as (select *, row_number() over (partition by doc_id order by score desc, place) as position from sc where score > 0)
select doc_id, id, position, score from top where position <= 3
union all select doc_id, 'rb-degradation', 1, 0 from q where doc_id not in (select doc_id from top)""")
def _(t: Telemetry) -> DataFrame:
    symptoms = t.table("documents").select(F.col("doc_id").alias("incident_id"), F.col("text").alias("query"))
    found = hypothesis.match_runbooks(symptoms)
    return found.select(F.col("incident_id").alias("doc_id"), "id", "position", "score")


@query("r12_runbook_steps", """
with wanted as (select distinct concat('rb-', case when l_orderkey % 10 = 0 then 'x' else '' end, l_partkey) as id from lineitem)
select id, p_name as title, p_type as "when", p_brand || '|' || p_size as steps, case when p_name is null then concat('no runbook with id ', id) end as note
from wanted left join part on id = concat('rb-', p_partkey)""")
def _(t: Telemetry) -> DataFrame:
    """Parts as runbooks, asked for by line items; some ids are unknown."""
    books = t.table("part").select(
        F.concat(F.lit("rb-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("when"),
        F.array("p_brand", F.col("p_size").cast("string")).alias("steps"))
    wanted = t.table("lineitem").select(F.concat(
        F.lit("rb-"), F.when(F.col("l_orderkey") % 10 == 0, "x").otherwise(""), F.col("l_partkey").cast("string")).alias("id"))
    found = hypothesis.runbook_steps(books, wanted)
    return found.withColumn("steps", F.when(F.col("steps").isNotNull(), F.array_join("steps", "|")))
