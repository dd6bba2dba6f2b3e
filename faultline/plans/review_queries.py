"""Queries A1-A6, D1-D11, E1-E9 and J1-J7."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.expr import alert_fingerprint, round6
from faultline.operators import alerts, audit, grading, quality
from faultline.plans.cause_queries import _RANK, ranked
from faultline.plans.registry import query
from faultline.plans.signal_queries import rounded
from faultline.plans.views import Telemetry, with_views

# fixed values of the test rules: name, metric, threshold, comparison, seconds, severity, signal
RULES = [
    (0, "UserFacingDegradation", "request_error_rate", 0.02, ">", 7200, "critical", "degradation"),
    (1, "UserFacingDegradation", "latency_p95_ms", 250.0, ">=", 14400, "critical", "degradation"),
    (2, "FrontendHighLatency", "latency_p95_ms", 300.0, ">", 0, "warning", "latency_p95"),
    (3, "CheckoutFailureRate", "cpu_cores", 4.0, "<", 0, "warning", "cpu"),
]


def rules(t: Telemetry) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(
        ("rule_id", "alertname", "metric", "threshold", "comparison", "for_seconds", "severity", "signal"), r)]) for r in RULES]
    one = t.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return one.select(
        "*", F.concat_ws(" ", "metric", "comparison", F.col("threshold").cast("string")).alias("expr"),
        F.create_map(F.lit("tier"), F.lit("user_facing"), F.lit("signal"), F.col("signal")).alias("labels"),
        F.create_map(F.lit("summary"), F.lit("{{value}} since second {{starts_at}}")).alias("annotation_templates")).drop("signal")


_RULE_SQL = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in RULES)
_FIRED = {
    "rules": f"select * from (values {_RULE_SQL}) as v(rule_id, alertname, metric, threshold, comparison, for_seconds, severity, signal)",
    "top": "select incident_id, metric, time, max(value) as value from metrics group by all",
    "hits": """select t.*, rule_id, for_seconds, case comparison when '>' then value > threshold when '>=' then value >= threshold when '<' then value < threshold else value <= threshold end as hit
      from top t join rules using (metric)""",
    "runs": "select *, sum((not hit)::int) over (partition by incident_id, rule_id order by time) as run from hits",
    "sustained": "select incident_id, rule_id, run, min(time) as start, max(time) - min(time) as lasted, arg_min(value, time) as value, max(for_seconds) as need from runs where hit group by 1, 2, 3",
    "fired": "select incident_id, rule_id, min(start) as starts_at_second, arg_min(value, start) as value from sustained where lasted >= need group by 1, 2",
    "alert": """select f.*, r.alertname, r.severity, r.signal, left(sha256(concat(r.alertname, '|signal=', r.signal, ',tier=user_facing')), 16) as fingerprint
      from fired f join rules r using (rule_id)""",
    "kept": """select *, row_number() over (partition by incident_id, fingerprint order by severity='warning', starts_at_second, alertname, rule_id) as r from alert""",
}


def derived(t: Telemetry) -> DataFrame:
    return alerts.derive_alerts(t.metrics, rules(t), t.incidents)


@query("a1_sustained_breach", with_views("metrics", extra=_FIRED, body="""
select incident_id, rule_id, starts_at_second, round(value, 6) as value from fired"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(alerts.sustained_breaches(t.metrics, rules(t)), "value")


@query("a2_derive_alerts", with_views("metrics", "incidents", extra=_FIRED, body="""
select incident_id, alertname, severity, starts_at_second, round(value, 6) as value, fingerprint from kept where r = 1
union all select incident_id, null, null, null, null, null from incidents where incident_id not in (select incident_id from kept)"""))
def _(t: Telemetry) -> DataFrame:
    return rounded(derived(t).select("incident_id", "alertname", "severity", "starts_at_second", "value", "fingerprint"), "value")


@query("a3_alert_fingerprint", with_views("spans", body="""
select incident_id, service, left(sha256(concat('HighErrorRate|kind=', span_kind, ',service=', service)), 16) as fingerprint,
  left(sha1(concat('HighErrorRate|kind=', span_kind, ',service=', service)), 16) as short_fingerprint, count(*) as n
from spans group by incident_id, service, span_kind"""))
def _(t: Telemetry) -> DataFrame:
    labels = F.create_map(F.lit("service"), F.col("service"), F.lit("kind"), F.col("span_kind"))
    name = F.lit("HighErrorRate")
    return t.spans.groupBy("incident_id", "service", "span_kind").agg(F.count(F.lit(1)).alias("n")).select(
        "incident_id", "service", alert_fingerprint(name, labels).alias("fingerprint"),
        alert_fingerprint(name, labels, "sha1").alias("short_fingerprint"), "n")


@query("a4_annotations", with_views("spans", body="""
select incident_id, span_id, concat('Degradation ', cast(duration_ms as varchar), ' since second ', time, ' value ', cast(duration_ms as varchar)) as summary from spans"""))
def _(t: Telemetry) -> DataFrame:
    templates = F.create_map(F.lit("summary"), F.lit("Degradation {{value}} since second {{starts_at}} value {{value}}"))
    text = alerts.render_annotations(templates, F.col("duration_ms"), F.col("time"))
    return t.spans.select("incident_id", "span_id", F.try_element_at(text, F.lit("summary")).alias("summary"))


@query("a5_symptom_violations", with_views("metrics", "incidents", extra=_FIRED, body="""
select incident_id, alertname, 'label signal has a value outside the allowed set' as violation from kept where r = 1 and signal = 'cpu'"""))
def _(t: Telemetry) -> DataFrame:
    return alerts.symptom_violations(derived(t).where("violation IS NULL"))


_MATRIX = _FIRED | {
    "matrix": """select i.incident_id as scenario_id, coalesce(list_sort(list(k.alertname) filter (where k.alertname is not null)), []) as names
      from incidents i left join kept k on k.incident_id=i.incident_id and k.r=1 group by 1"""}


def matrix(t: Telemetry) -> DataFrame:
    scenario = F.col("incident_id").alias("scenario_id")
    fired = derived(t).where("violation IS NULL").select(scenario, "alertname")
    return alerts.coverage_matrix(t.incidents.select(scenario), fired)


@query("a6_coverage_matrix", with_views("metrics", "incidents", extra=_MATRIX, body="""
select scenario_id, array_to_string(names, ',') as alertnames from matrix"""))
def _(t: Telemetry) -> DataFrame:
    return matrix(t).withColumn("alertnames", F.array_join("alertnames", ","))


@query("a6_coverage_violations", with_views("metrics", "incidents", extra=_MATRIX, body="""
select 'E1' as invariant, '' as subject, scenario_id from matrix where len(names) = 0
union all select 'E2', n, min(scenario_id) from (select distinct scenario_id, unnest(names) as n from matrix) group by n having count(*) = 1
union all select 'E3', s, min(scenario_id) from (select scenario_id, array_to_string(list_sort(list_distinct(names)), ',') as s from matrix) group by s having count(*) = 1"""))
def _(t: Telemetry) -> DataFrame:
    return alerts.coverage_violations(matrix(t))


@query("a6_coverage_gaps", """
with matrix as (select concat('sc_', c_custkey) as scenario_id, coalesce(list_sort(list(distinct concat(o_orderpriority, ' ', cast(floor(o_totalprice / 1000) as bigint))) filter (where o_orderkey is not null)), []) as names
  from customer left join orders on o_custkey = c_custkey group by 1)
select 'E1' as invariant, '' as subject, scenario_id from matrix where len(names) = 0
union all select 'E2', n, min(scenario_id) from (select scenario_id, unnest(names) as n from matrix) group by n having count(*) = 1
union all select 'E3', s, min(scenario_id) from (select scenario_id, array_to_string(names, ',') as s from matrix) group by s having count(*) = 1""")
def _(t: Telemetry) -> DataFrame:
    """A scenario per customer with its orders as alerts: silent ones, lonely names and lonely sets all occur."""
    scenarios = t.table("customer").select(F.concat(F.lit("sc_"), F.col("c_custkey").cast("string")).alias("scenario_id"))
    price = F.floor(F.col("o_totalprice") / 1000).cast("string")
    fired = t.table("orders").select(
        F.concat(F.lit("sc_"), F.col("o_custkey").cast("string")).alias("scenario_id"), F.concat("o_orderpriority", F.lit(" "), price).alias("alertname"))
    return alerts.coverage_violations(alerts.coverage_matrix(scenarios, fired))


# ---- quality --------------------------------------------------------------------------------

_TOKENS = ["license", "Copyright", "password", "http", "@"]


@query("d1_banned_tokens", """
with lines as (select doc_id, unnest(string_split(text, E'\\n')) as line, generate_subscripts(string_split(text, E'\\n'), 1) as line_number from documents),
tokens as (select unnest(['license', 'Copyright', 'password', 'http', '@']) as token)
select doc_id, line_number, token from lines join tokens on contains(line, token)""")
def _(t: Telemetry) -> DataFrame:
    lines = t.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    lines = lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_number"), "line")
    return quality.banned_token_findings(lines, _TOKENS)


@query("d2_public_attributes", """
select event_id, concat_ws(',', case when event_type <> 'error' then concat('kind=', event_type) end, case when not contains(props, '7') then concat('props=', props) end) as attributes from events""")
def _(t: Telemetry) -> DataFrame:
    attributes = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("props"), F.col("props"), F.lit("feature_flag.key"), F.lit("x"))
    kept = quality.public_attributes(attributes, [*quality.BANNED_TOKENS, "error", "7"])
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.table("events").select("event_id", F.array_join(pairs, ",").alias("attributes"))


@query("d3_redaction", """
select doc_id, md5(replace(replace(text, 'the', '[redacted]'), 'http', '[redacted]')) as digest, contains(text, 'the') or contains(text, 'http') as redacted from documents""")
def _(t: Telemetry) -> DataFrame:
    found = quality.redact_rows(t.table("documents").select("doc_id", "text"), "text", ["the", "http"])
    return found.select("doc_id", F.md5("text").alias("digest"), "redacted")


@query("d4_signal_gates", with_views("metrics", "logs", "incidents", "truth", extra={
    "seen": "select m.*, time >= onset_second as after from metrics m join truth using (incident_id, service) join incidents using (incident_id)",
    "im": """select incident_id, bool_or(after) as post, avg(value) filter (where metric='request_error_rate' and not after) as e0, avg(value) filter (where metric='request_error_rate' and after) as e1,
      avg(value) filter (where metric='latency_p95_ms' and not after) as l0, avg(value) filter (where metric='latency_p95_ms' and after) as l1,
      avg(value) filter (where metric='cpu_cores' and not after) as c0, avg(value) filter (where metric='cpu_cores' and after) as c1 from seen group by 1"""}, body="""
select incident_id, violation from (
 select incident_id, case when (select count(*) from spans s where s.incident_id=i.incident_id) < 1700 then 'too few spans' end as violation from incidents i
 union all select incident_id, case when (select count(*) from logs s where s.incident_id=i.incident_id) < 20 then 'too few logs' end from incidents i
 union all select incident_id, case when e0 > 0.005 then 'pre-onset error rate exceeds the healthy gate' end from im
 union all select incident_id, case when not (coalesce(e1 - e0 >= 0.3, false) or coalesce(l0 > 0 and l1 / l0 >= 6, false) or coalesce(c1 - c0 >= 50, false)) then 'post-onset impact is below the error, latency and cpu gates' end from im)
where violation is not null"""))
def _(t: Telemetry) -> DataFrame:
    gates = {"min_spans": 1700, "min_logs": 20, "max_pre_error": 0.005, "error_delta": 0.3, "latency_ratio": 6.0, "cpu_delta": 50.0}
    return quality.signal_gates(t.incidents, t.truth, t.spans, t.logs, t.metrics, gates)


_CULPRITS = {
    "near": """select c.incident_id, arg_min(c.id, row(-c.time, c.id)) as culprit from changes c join incidents using (incident_id) join truth t
      on t.incident_id=c.incident_id and t.service=c.service where c.time < onset_second group by 1""",
    "sealed": """select t.incident_id, case when t.incident_id='inc_1' then 'chg_none' else culprit end as culprit, culprit as near, c.first_id, c.last_id, c.last_time from truth t join near using (incident_id)
      join (select incident_id, arg_min(id, row(time, id)) as first_id, arg_max(id, row(time, id)) as last_id, max(time) as last_time from changes group by 1) c using (incident_id)""",
}


def sealed(t: Telemetry) -> DataFrame:
    """Truth with a culprit (unknown for inc_1) and three decoys: first, a made-up one, the nearest change."""
    from faultline.operators.changes import nearest_before

    probes = t.truth.join(t.incidents.select("incident_id", "onset_second"), "incident_id")
    near = nearest_before(t.changes, probes.select("incident_id", "service", "onset_second"))
    order = F.struct("time", "id")
    ends = t.changes.groupBy("incident_id").agg(F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"),
                                                F.max("time").alias("last_time"))
    joined = near.where("change_id IS NOT NULL").join(ends, "incident_id")
    return joined.select(
        "incident_id", "service", F.when(F.col("incident_id") == "inc_1", "chg_none").otherwise(F.col("change_id")).alias("culprit_change_id"),
        F.array("first_id", F.lit("chg_x"), "change_id").alias("decoy_change_ids"), "last_time", "last_id", F.col("change_id").alias("near_id"))


@query("d5_manifest_gates", with_views("changes", "incidents", "truth", extra=_CULPRITS, body="""
select incident_id, 'traces' as item, 'missing signal' as violation from incidents
union all select incident_id, culprit, 'culprit is not a known change' from sealed where incident_id='inc_1'
union all select incident_id, 'chg_x', 'decoy is not a known change' from sealed
union all select incident_id, near, 'decoy duplicates the culprit' from sealed where culprit = near
union all select incident_id, first_id, 'decoy duplicates the culprit' from sealed where culprit = first_id
union all select incident_id, null, 'manifest has no alerts' from incidents where incident_id not in (select incident_id from sealed)
union all select incident_id, 'Late', 'alert starts outside the window' from sealed where last_time > 431000"""))
def _(t: Telemetry) -> DataFrame:
    signals = F.array(F.lit("metrics"), F.lit("logs"), F.lit("changes"))
    manifests = t.incidents.select("incident_id", F.lit(431000).alias("window_end"), signals.alias("available_signals"))
    fired = sealed(t).select("incident_id", F.lit("Late").alias("alertname"), F.col("last_time").alias("starts_at_second"))
    return quality.manifest_violations(manifests, sealed(t), t.changes, fired)


@query("d6_replay_differences", with_views("spans", body="""
select span_id, cast(1 as bigint) as surplus from spans where time < 1000 union all select span_id, cast(-1 as bigint) from spans where time > 431000"""))
def _(t: Telemetry) -> DataFrame:
    first = t.spans.where("time <= 431000")
    second = t.spans.where("time >= 1000")
    return quality.replay_differences(first, second).select("span_id", "surplus")


def fingerprints(t: Telemetry) -> DataFrame:
    return quality.incident_fingerprints(t.incidents, t.metrics, t.logs, t.spans, t.changes)


_FP = {
    "seen": "select m.*, time >= onset_second as after from metrics m join incidents using (incident_id)",
    "per": """select incident_id, service, avg(value) filter (where metric='request_error_rate' and not after) as e0, avg(value) filter (where metric='request_error_rate' and after) as e1,
      avg(value) filter (where metric='latency_p95_ms' and not after) as l0, avg(value) filter (where metric='latency_p95_ms' and after) as l1,
      avg(value) filter (where metric='cpu_cores' and not after) as c0, avg(value) filter (where metric='cpu_cores' and after) as c1 from seen group by 1, 2""",
    "fl": """select *, coalesce(c0 > 0 and c1 / c0 >= 1.25, false) as hot, coalesce(e1 - e0 >= 0.05, false) or coalesce(l0 > 0 and l1 / l0 >= 1.5, false) or coalesce(c0 > 0 and c1 / c0 >= 1.25, false) as hit,
      row_number() over (partition by incident_id order by e1 desc nulls last, service) as er, row_number() over (partition by incident_id order by l1 desc nulls last, service) as lr from per""",
    "lists": """select incident_id, coalesce(string_agg(service, ',' order by service) filter (where hit), '') as impacted_services, coalesce(string_agg(service, ',' order by service) filter (where hot), '') as resource_anomalies,
      coalesce(string_agg(service, ',' order by er) filter (where er <= 5 and e1 is not null), '') as top_error_services, coalesce(string_agg(service, ',' order by lr) filter (where lr <= 5 and l1 is not null), '') as top_latency_services from fl group by 1""",
    "base": "select incident_id, service, metric, avg(value) as b from seen where not after group by all",
    "early": """select incident_id, arg_min(service, row(time, service)) as earliest_anomalous_service from seen join base using (incident_id, service, metric) where after and
      case metric when 'request_error_rate' then value >= b + 0.05e0 when 'latency_p95_ms' then b > 0 and value >= b * 1.5e0 else b > 0 and value >= b * 1.25e0 end group by 1""",
    "cl": r"""select incident_id, left(trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '\b[0-9a-f]{8,}\b', '<id>', 'g'), '\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g')), 120) as tpl, count(*) as n
      from logs join incidents using (incident_id) where time >= onset_second group by 1, 2""",
    "clr": "select *, row_number() over (partition by incident_id order by n desc, tpl) as r from cl",
    "slow": "select incident_id, concat(service, ':', operation) as s, row_number() over (partition by incident_id order by duration_ms desc, service, operation, span_id) as r from spans",
}


@query("d7_incident_fingerprints", with_views("metrics", "logs", "changes", "incidents", extra=_FP, body="""
select i.incident_id, l.impacted_services, e.earliest_anomalous_service, l.top_error_services, l.top_latency_services, l.resource_anomalies,
  (select string_agg(tpl, '|' order by r) from clr where r <= 5 and clr.incident_id=i.incident_id) as dominant_log_clusters,
  (select string_agg(s, '|' order by r) from slow where r <= 5 and slow.incident_id=i.incident_id) as slowest_spans,
  (select count(*) from changes c where c.incident_id=i.incident_id) as change_events,
  (select min(time) from changes c where c.incident_id=i.incident_id) as first_change_second, (select max(time) from changes c where c.incident_id=i.incident_id) as last_change_second
from incidents i left join lists l using (incident_id) left join early e using (incident_id)"""))
def _(t: Telemetry) -> DataFrame:
    lists = {c: F.array_join(c, ",") for c in ("impacted_services", "top_error_services", "top_latency_services", "resource_anomalies")}
    return fingerprints(t).withColumns({**lists, "dominant_log_clusters": F.array_join("dominant_log_clusters", "|"),
                                        "slowest_spans": F.array_join("slowest_spans", "|")})


@query("d7_change_timing", with_views("changes", body="select incident_id, id, time from changes"))
def _(t: Telemetry) -> DataFrame:
    return quality.change_timing(t.changes)


@query("d8_confusable_pairs", with_views("metrics", "logs", "incidents", extra=_FP | {
    "sets": """select incident_id, string_split(impacted_services, ',') as a, string_split(top_error_services, ',') as b, string_split(top_latency_services, ',') as c,
      string_split(resource_anomalies, ',') as d, (select list(tpl) from clr where r <= 5 and clr.incident_id=lists.incident_id) as e from lists""",
    "pair": "select incident_id as l, concat('inc_', (substr(incident_id, 5)::int + 1) % 6) as r from incidents"}, body="""
select l as left_id, r as right_id, not (list_has_any(list_filter(x.a, lambda v: v <> ''), y.a) or list_has_any(x.b, y.b) or list_has_any(x.c, y.c)
  or list_has_any(list_filter(x.d, lambda v: v <> ''), y.d) or list_has_any(x.e, y.e)) as trivially_distinct
from pair join sets x on x.incident_id=l join sets y on y.incident_id=r"""))
def _(t: Telemetry) -> DataFrame:
    number = F.substring_index("incident_id", "_", -1).cast("int")
    pairs = t.incidents.select(F.col("incident_id").alias("left_id"), F.concat(F.lit("inc_"), ((number + 1) % 6).cast("string")).alias("right_id"))
    return quality.trivially_distinct(fingerprints(t), pairs)


_SHARED = _FP | {
    "item": """select distinct incident_id, f, unnest(vs) as v from (
      select incident_id, 'impacted_services' as f, list_filter(string_split(impacted_services, ','), lambda v: v <> '') as vs from lists
      union all select incident_id, 'top_error_services', string_split(top_error_services, ',') from lists
      union all select incident_id, 'top_latency_services', string_split(top_latency_services, ',') from lists
      union all select incident_id, 'resource_anomalies', list_filter(string_split(resource_anomalies, ','), lambda v: v <> '') from lists
      union all select incident_id, 'dominant_log_clusters', list(tpl) from clr where r <= 5 group by 1)""",
    "held": "select *, count(*) over (partition by f, v) as holders from item",
}


@query("d8_sharing_pairs", with_views("metrics", "logs", "incidents", extra=_SHARED, body="""
select x.incident_id as left_id, y.incident_id as right_id, count(distinct x.f) as shared_features, count(*) as shared_values
from held x join held y on x.f = y.f and x.v = y.v and x.incident_id < y.incident_id
group by 1, 2 having min(x.holders) <= 3"""))
def _(t: Telemetry) -> DataFrame:
    return quality.sharing_pairs(fingerprints(t), hot=3)[0]


@query("d8_sharing_classes", with_views("metrics", "logs", "incidents", extra=_SHARED, body="""
select incident_id, f as feature, v as value, holders from held where holders > 3"""))
def _(t: Telemetry) -> DataFrame:
    return quality.sharing_pairs(fingerprints(t), hot=3)[1]


def reports(t: Telemetry) -> DataFrame:
    """One draft report per customer order group: mostly sound, with every kind of mistake in it."""
    o = t.table("orders")
    bad = F.col("o_orderkey") % 7
    chg = F.concat(F.lit("chg_"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    return o.select(
        F.concat(F.lit("inc_"), (F.col("o_orderkey") % 6).cast("string")).alias("change_incident"),
        F.concat(F.lit("rep_"), F.col("o_orderkey").cast("string")).alias("report_id"),
        F.when(bad == 1, "edge").when(bad == 2, "other").otherwise("service").alias("kind"),
        F.when(bad == 3, none).otherwise(F.lit("payment")).alias("service"), F.when(bad == 1, "frontend").alias("caller"), none.alias("callee"),
        F.when(bad == 4, none).when(bad == 5, F.lit("chg_none")).otherwise(chg).alias("culprit_change_id"),
        F.when(bad == 6, F.array(chg)).otherwise(F.array().cast("array<string>")).alias("ruled_out_change_ids"),
        F.when(bad == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("line"))).alias("evidence"), bad.alias("bad"))


@query("d9_report_issues", """
select concat('rep_', o_orderkey) as incident_id, case o_orderkey % 7 when 0 then 'evidence is empty' when 1 then 'root cause of kind edge requires caller and callee'
  when 2 then 'root cause kind must be service or edge' when 3 then 'root cause of kind service requires a service' when 4 then 'culprit change is empty'
  when 5 then 'culprit change is not a known change' else 'culprit change is also ruled out' end as issue from orders""")
def _(t: Telemetry) -> DataFrame:
    # Each order is its own incident here, with one change that carries its key.
    drafts = reports(t).withColumn("incident_id", F.col("report_id"))
    known = t.table("orders").select(F.concat(F.lit("rep_"), F.col("o_orderkey").cast("string")).alias("incident_id"),
                                     F.concat(F.lit("chg_"), F.col("o_orderkey").cast("string")).alias("id"))
    return quality.report_issues(drafts, known)


@query("d10_missing_decoys", with_views("changes", "incidents", "truth", extra=_CULPRITS, body="""
select c.incident_id, c.id from changes c join sealed s using (incident_id) where c.id <> s.culprit and c.id <> s.first_id"""))
def _(t: Telemetry) -> DataFrame:
    drafts = sealed(t).select("incident_id", "culprit_change_id", F.slice("decoy_change_ids", 1, 1).alias("ruled_out_change_ids"))
    return quality.missing_decoys(drafts, t.changes)


@query("d11_finding_issues", with_views("spans", body="""
select incident_id, span_id as finding_id, issue from (
  select incident_id, span_id, case when span_kind='client' then 'service is required' end as issue from spans
  union all select incident_id, span_id, case when status='ERROR' and duration_ms < 100 then 'an origin requires evidence' end from spans
  union all select incident_id, span_id, case when status='ERROR' and operation='op4' then 'an origin requires a fault type' end from spans
  union all select incident_id, span_id, case when duration_ms / 100 > 1 then 'confidence must be between 0 and 1' end from spans) where issue is not null"""))
def _(t: Telemetry) -> DataFrame:
    findings = t.spans.select(
        "incident_id", F.col("span_id").alias("finding_id"), F.when(F.col("span_kind") == "server", F.col("service")).alias("service"),
        (F.col("status") == "ERROR").alias("is_origin"), F.when(F.col("operation") != "op4", "latency").alias("fault_type"),
        (F.col("duration_ms") / 100).alias("confidence"),
        F.when(F.col("duration_ms") < 100, F.array().cast("array<string>")).otherwise(F.array("span_id")).alias("evidence"))
    return quality.finding_issues(findings)


# ---- grading --------------------------------------------------------------------------------

def graded_truth(t: Telemetry) -> DataFrame:
    """One truth per order, with every kind of location."""
    o = t.table("orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("scn_"), k.cast("string")).alias("incident_id"), F.when(k % 3 == 0, "edge").otherwise("service").alias("kind"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("type"), F.concat(F.lit("svc"), (k % 5).cast("string")).alias("service"),
        F.concat(F.lit("svc"), (k % 2).cast("string")).alias("caller"), F.concat(F.lit("svc"), (k % 4).cast("string")).alias("callee"),
        F.concat(F.lit("chg_"), (k % 9).cast("string")).alias("culprit_change_id"), F.array(F.lit("chg_1"), F.lit("chg_2")).alias("decoy_change_ids"),
        F.when(k % 4 == 1, F.array(F.lit("svc1"), F.lit("svc3"))).alias("accepted_services"), F.col("o_orderstatus").alias("indicator"))


def graded_reports(t: Telemetry) -> DataFrame:
    o = t.table("orders").where(F.col("o_orderstatus") != "P")
    c = F.col("o_custkey")
    return o.select(
        F.concat(F.lit("scn_"), F.col("o_orderkey").cast("string")).alias("incident_id"), F.when(c % 2 == 0, "edge").otherwise("service").alias("kind"),
        F.concat(F.lit("X-"), "o_orderpriority").alias("type"), F.concat(F.lit("svc"), (c % 5).cast("string")).alias("service"),
        F.concat(F.lit("svc"), (c % 4).cast("string")).alias("caller"), F.concat(F.lit("svc"), (c % 3).cast("string")).alias("callee"),
        F.concat(F.lit("chg_"), (c % 9).cast("string")).alias("culprit_change_id"),
        F.array(F.lit("chg_1"), F.concat(F.lit("chg_"), (c % 4).cast("string"))).alias("ruled_out_change_ids"),
        F.array(F.lit("status"), F.when(c % 3 == 0, "F").otherwise("saw O today")).alias("evidence"))


_GRADE = {
    "tr": """select o_orderkey as k, o_custkey as c, concat('scn_', o_orderkey) as incident_id, case when o_orderkey % 3 = 0 then 'edge' else 'service' end as kind, o_orderkey % 4 = 1 as acc,
      o_orderstatus <> 'P' as sent, case when o_custkey % 2 = 0 then 'edge' else 'service' end as rkind, o_orderstatus as ind from orders""",
    "gr": """select *, sent and case when kind='edge' then rkind='edge' and c % 4 = k % 2 and c % 3 = k % 4
        else (rkind='service' and case when acc then c % 5 in (1, 3) else c % 5 = k % 5 end) or (acc and rkind='edge' and c % 4 in (1, 3) and c % 3 in (1, 3)) end as loc,
      sent and c % 9 = k % 9 as cul, sent and c % 4 = 2 as dec from tr""",
}


@query("e1_grade_reports", with_views("graded_runs", extra=_GRADE, body="""
select incident_id, loc as location_correct, cul as culprit_correct, dec as decoys_ruled_out, sent as type_match, not sent as missing_report, loc and cul as correct from gr"""))
def _(t: Telemetry) -> DataFrame:
    return grading.grade_reports(graded_truth(t), graded_reports(t))


@query("e2_type_match", """
select doc_id, len(list_intersect(rt, tt)) >= greatest(1, len(tt) - 1) and len(rt) > 0 as matched from (
  select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as rt, ['the', 'license', lang] as tt from documents)""")
def _(t: Telemetry) -> DataFrame:
    truth = F.concat(F.lit("The License: "), "lang")
    return t.table("documents").select("doc_id", grading.type_match("text", truth).alias("matched"))


@query("e3_grade_localisation", with_views("graded_runs", extra=_GRADE, body="""
select incident_id, sent and (case when acc then c % 5 in (1, 3) else c % 5 = k % 5 end or (rkind='edge' and case when acc then c % 4 in (1, 3) and c % 3 in (1, 3) else c % 4 = k % 5 and c % 3 = k % 5 end)) as location_correct,
  sent as type_match, sent and contains(case when c % 3 = 0 then 'status F' else 'status saw O today' end, ind) as indicator_correct from tr"""))
def _(t: Telemetry) -> DataFrame:
    return grading.grade_localisation(graded_truth(t), graded_reports(t))


@query("e4_scenario_reliability", with_views("graded_runs", body="""
select scenario_id, count(*) as runs, count_if(correct) as passes, count_if(location_correct) as location_correct_passes, count_if(culprit_correct) as culprit_correct_passes,
  count_if(decoys_ruled_out) as decoys_ruled_out_passes, count_if(type_match) as type_match_passes, round(count_if(correct) / count(*), 6) as pass_rate,
  count_if(correct) > 0 as passed_any, count_if(correct) = count(*) as passed_all, count_if(correct) > 0 and count_if(correct) < count(*) as flaky,
  round(sum(cost), 4) as total_cost, sum(calls) as total_calls from graded_runs group by 1"""))
def _(t: Telemetry) -> DataFrame:
    return grading.scenario_reliability(t.graded_runs).withColumn("pass_rate", round6("pass_rate")).withColumn("total_cost", F.round("total_cost", 4))


@query("e4_suite_reliability", with_views("graded_runs", extra={
    "per": "select scenario_id, count(*) as n, count_if(correct) as p from graded_runs group by 1"}, body="""
select (select count(*) from per) as scenarios, count(*) as total_runs, count_if(correct) as total_passes, round(count_if(correct) / count(*), 6) as micro_pass_rate,
  round((select count_if(p > 0) / count(*) from per), 6) as pass_at_k, round((select count_if(p = n) / count(*) from per), 6) as pass_hat_k,
  round(count_if(location_correct) / count(*), 6) as location_correct_rate, round(count_if(culprit_correct) / count(*), 6) as culprit_correct_rate,
  round(count_if(decoys_ruled_out) / count(*), 6) as decoys_ruled_out_rate, round(count_if(type_match) / count(*), 6) as type_match_rate,
  round(avg(cost), 6) as mean_cost, round(avg(calls), 6) as mean_calls from graded_runs"""))
def _(t: Telemetry) -> DataFrame:
    rates = ["micro_pass_rate", "pass_at_k", "pass_hat_k", *[f"{d}_rate" for d in grading.DIMENSIONS], "mean_cost", "mean_calls"]
    return rounded(grading.suite_reliability(t.graded_runs), *rates)


# fixed values of the test cases: systems, services and faults
_SYSTEMS, _FAULTS = ["ob", "ss", "tt"], ["cpu", "mem", "disk", "socket", "delay", "loss", "f1", "f3", "zz"]


def cases(t: Telemetry) -> DataFrame:
    """Case names built from orders: system, multi-token service, fault, instance."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    return t.table("orders").select(
        F.concat_ws("_", pick(_SYSTEMS, k), F.concat(F.lit("svc_"), (c % 3).cast("string")), pick(_FAULTS, c), k.cast("string")).alias("case_id"),
        (F.col("o_orderstatus") == "F").alias("correct"))


_CASES = {"cases": """select concat_ws('_', ['ob', 'ss', 'tt'][o_orderkey % 3 + 1], concat('svc_', o_custkey % 3), f, o_orderkey) as case_id, ['ob', 'ss', 'tt'][o_orderkey % 3 + 1] as system, f as fault,
    concat('svc_', o_custkey % 3) as service, cast(o_orderkey as varchar) as instance, o_orderstatus='F' as correct,
    case when f in ('cpu', 'mem', 'disk', 'socket') then 'resource' when f in ('delay', 'loss') then 'network' when f in ('f1', 'f3') then 'code' else 'unknown' end as category
  from (select *, ['cpu', 'mem', 'disk', 'socket', 'delay', 'loss', 'f1', 'f3', 'zz'][o_custkey % 9 + 1] as f from orders)"""}


@query("e5_scorecard", with_views("graded_runs", extra=_CASES, body="""
select case grouping_id(system, fault, category) when 7 then 'overall' when 3 then 'system' when 5 then 'fault' else 'category' end as level,
  coalesce(system, fault, category, 'all') as name, count(*) as n, count_if(correct) as hits, round(count_if(correct) / count(*), 6) as ac1
from cases group by grouping sets ((), (system), (fault), (category))"""))
def _(t: Telemetry) -> DataFrame:
    from faultline.sources.benchmark import parse_cases

    return rounded(grading.scorecard(parse_cases(cases(t))), "ac1")


@query("e6_ranked_accuracy", with_views("metrics", "incidents", "truth", extra=_RANK | {
    "b": "select t.incident_id, min(rank) as r from truth t left join ranked k on k.incident_id=t.incident_id and k.service in (t.service, 'frontend') group by 1"}, body="""
select count(*) as incidents, round(avg((coalesce(r, 99) <= 1)::int), 6) as ac_at_1, round(avg((coalesce(r, 99) <= 3)::int), 6) as ac_at_3, round(avg((coalesce(r, 99) <= 5)::int), 6) as ac_at_5,
  round(avg(((coalesce(r, 99) <= 1)::int + (coalesce(r, 99) <= 2)::int + (coalesce(r, 99) <= 3)::int + (coalesce(r, 99) <= 4)::int + (coalesce(r, 99) <= 5)::int) / 5), 6) as avg_at_5 from b"""))
def _(t: Telemetry) -> DataFrame:
    truth = t.truth.select("incident_id", F.array("service", F.lit("frontend")).alias("accepted_services"))
    return rounded(grading.ranked_accuracy(ranked(t), truth), "ac_at_1", "ac_at_3", "ac_at_5", "avg_at_5")


# fixed values: USD per million tokens by role
PRICES = [
    ("manager", "input", 5.0), ("manager", "output", 25.0), ("manager", "cache_read", 0.5), ("manager", "cache_write", 6.25),
    ("worker", "input", 3.0), ("worker", "output", 15.0), ("worker", "cache_read", 0.3), ("worker", "cache_write", 3.75),
]


def usage(t: Telemetry) -> DataFrame:
    """Token usage per order (run) and role, from its line items."""
    li = t.table("lineitem")
    role = F.when(F.col("l_linenumber") == 1, "manager").otherwise("worker").alias("role")
    q = F.col("l_quantity").cast("long")
    return li.groupBy(F.col("l_orderkey").alias("run_id"), role).agg(
        (F.sum(q) * 1000).alias("input"), (F.sum(q) * 100).alias("output"), (F.sum(q) * 5000).alias("cache_read"), F.sum(q).alias("cache_write"))


def prices(t: Telemetry) -> DataFrame:
    rows = [F.struct(F.lit(r).alias("role"), F.lit(k).alias("kind"), F.lit(p).alias("per_million")) for r, k, p in PRICES]
    return t.spark.range(1).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


_COST = {"cost": """select l_orderkey as run_id, sum(cast(l_quantity as bigint) * case when l_linenumber = 1 then 1000 * 5.0e0 + 100 * 25.0e0 + 5000 * 0.5e0 + 6.25e0 else 1000 * 3.0e0 + 100 * 15.0e0 + 5000 * 0.3e0 + 3.75e0 end) / 1e6 as usd
  from lineitem group by 1"""}


@query("e7_run_costs", with_views("graded_runs", extra=_COST, body="select run_id, round(usd, 8) as cost_usd from cost"))
def _(t: Telemetry) -> DataFrame:
    return grading.run_costs(usage(t), prices(t)).withColumn("cost_usd", F.round("cost_usd", 8))


def tool_calls(t: Telemetry) -> DataFrame:
    """Line items read as the tool calls of a run."""
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") == 1, "manager").otherwise("worker").alias("role"),
        F.concat(F.lit("tool_"), (F.col("l_suppkey") % 7).cast("string")).alias("tool"), (F.col("l_returnflag") == "R").alias("error"),
        (F.col("l_linestatus") == "O").alias("denied"), F.col("l_quantity").alias("ms"), (F.col("l_discount") > 0.05).alias("cached"), F.col("l_partkey").alias("rows"))


@query("e8_tool_calls", """
select l_orderkey as run_id, case when l_linenumber = 1 then 'manager' else 'worker' end as role, concat('tool_', l_suppkey % 7) as tool, count(*) as calls,
  count_if(l_returnflag='R') as errors, count_if(l_linestatus='O') as denials from lineitem group by all""")
def _(t: Telemetry) -> DataFrame:
    return grading.tool_call_counts(tool_calls(t))


@query("e8_run_scorecards", with_views("graded_runs", extra={
    "tc": """select l_orderkey as run_id, count(*) as tool_calls, count_if(l_linenumber = 1) as manager_calls, count_if(l_linenumber <> 1) as worker_calls, count_if(l_returnflag='R') as tool_errors,
      count_if(l_linestatus='O') as hook_denials, count_if(l_discount <= 0.05) as backend_queries, count_if(l_discount > 0.05) as cache_hits, sum(l_partkey) as rows_read from lineitem group by 1"""}, body="""
select o_orderkey as run_id, round(o_totalprice / 1000, 1) as wall_s, coalesce(tool_calls, 0) as tool_calls, coalesce(manager_calls, 0) as manager_calls, coalesce(worker_calls, 0) as worker_calls,
  coalesce(tool_errors, 0) as tool_errors, coalesce(hook_denials, 0) as hook_denials, coalesce(backend_queries, 0) as backend_queries, coalesce(cache_hits, 0) as cache_hits,
  cast(coalesce(rows_read, 0) as bigint) as rows_read, o_orderstatus='F' as completed from orders left join tc on tc.run_id=o_orderkey"""))
def _(t: Telemetry) -> DataFrame:
    runs = t.table("orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") / 1000).alias("wall_s"),
                                    F.when(F.col("o_orderstatus") == "F", "reported").otherwise("budget").alias("stop"))
    calls = tool_calls(t)
    found = grading.run_scorecards(runs, calls, calls.select("run_id", "ms", "cached", "rows"), grading.run_costs(usage(t), prices(t)))
    return found.drop("stop", "query_ms", "cost_usd")


@query("e9_run_tree", """
with recursive a as (select conv_id as run_id, concat('a', cast(turn as varchar)) as agent_id, case when turn > 0 then concat('a', cast(turn // 2 as varchar)) end as p, turn from conversations),
g as (select run_id, agent_id, max(case when p <> agent_id then p end) as parent_id, min(turn) as first_seq, count(*) as records, 0 as z from a group by 1, 2),
w as (select run_id, agent_id, 0 as depth from g where parent_id is null or not exists (select 1 from g x where x.run_id=g.run_id and x.agent_id=g.parent_id)
  union all select g.run_id, g.agent_id, w.depth + 1 from w join g on g.run_id=w.run_id and g.parent_id=w.agent_id)
select g.run_id, g.agent_id, g.parent_id, g.first_seq, g.records, w.depth from g join w using (run_id, agent_id)""")
def _(t: Telemetry) -> DataFrame:
    c = t.table("conversations")
    agent = F.concat(F.lit("a"), F.col("turn").cast("string"))
    parent = F.concat(F.lit("a"), F.floor(F.col("turn") / 2).cast("string"))
    records = c.select(F.col("conv_id").alias("run_id"), agent.alias("agent_id"), F.when((F.col("turn") > 0) & (parent != agent), parent).alias("parent_id"),
                       F.col("turn").alias("seq"), F.col("role").alias("kind"), F.lit(None).cast("string").alias("traceback"))
    return grading.run_tree(records).drop("failures")


@query("e9_run_failures", """
select conv_id as run_id, concat('a', turn // 2) as agent_id, count(*) as records,
  count(*) filter (where length(text) % 5 = 0 or role = 'user' and turn % 4 = 2) as failures from conversations group by all""")
def _(t: Telemetry) -> DataFrame:
    """Two turns an agent; some records carry a traceback, some say that the harness failed."""
    c = t.table("conversations")
    half = F.floor(F.col("turn") / 2).cast("string")
    failed = (F.col("role") == "user") & (F.col("turn") % 4 == 2)
    records = c.select(
        F.col("conv_id").alias("run_id"), F.concat(F.lit("a"), half).alias("agent_id"), F.lit(None).cast("string").alias("parent_id"), F.col("turn").alias("seq"),
        F.when(failed, "harness_fail").otherwise(F.col("role")).alias("kind"), F.when(F.length("text") % 5 == 0, F.col("text")).alias("traceback"))
    return grading.run_tree(records).select("run_id", "agent_id", "records", "failures")


# ---- audit ----------------------------------------------------------------------------------

_FOLD = {
    "p": "select action_id, max(seq) as p from journal where kind='proposed' group by 1",
    "d": "select action_id, min(seq) as d, arg_min(kind, seq) as k from journal join p using (action_id) where kind in ('approved', 'denied', 'expired') and seq > p group by 1",
    "s": "select action_id, min(seq) as s, arg_min(kind, seq) as k from journal join d using (action_id) where d.k='approved' and journal.kind in ('execute_started', 'expired') and seq > d group by 1",
    "r": "select action_id, arg_min(ok, seq) as ok, min(seq) as r from journal join s using (action_id) where s.k='execute_started' and journal.kind='execute_result' and seq > s group by 1",
    "o": "select distinct action_id, true as posted from journal join p using (action_id) where kind='posted' and seq > p",
    "fold": """select p.action_id, case when r.r is not null then case when r.ok then 'done' else 'failed' end when s.k='execute_started' then 'executing' when s.k='expired' then 'expired'
      when d.k is not null then d.k when posted then 'posted' else 'proposed' end as status from p left join d using (action_id) left join s using (action_id) left join r using (action_id) left join o using (action_id)""",
}


@query("j1_journal_fold", with_views("journal", extra=_FOLD, body="select action_id, status from fold"))
def _(t: Telemetry) -> DataFrame:
    return audit.fold_journal(t.journal).select("action_id", "status")


@query("j2_audit_report", with_views("journal", extra=_FOLD, body="""
select count(*) as considered, count_if(status in ('approved', 'executing', 'done', 'failed')) as approved, count_if(status in ('done', 'failed')) as executed,
  cast(0 as bigint) as near_miss_count, (select count(*) from journal where kind='execute_result' and action_id not in (select action_id from journal where kind='approved')) as unapproved_executions,
  (select count(*) from journal where kind='execute_result' and action_id not in (select action_id from journal where kind='approved')) = 0 as safe from fold"""))
def _(t: Telemetry) -> DataFrame:
    return audit.audit_report(t.journal)


@query("j2_near_misses", with_views("journal", extra={
    "near": "select action_id, seq, case when seq % 7 = 3 then 'near_miss' else kind end as kind, ok from journal"}, body="""
select count(*) as near_miss_count from near where kind='near_miss'"""))
def _(t: Telemetry) -> DataFrame:
    """Every seventh event of the journal is a near miss instead."""
    near = t.journal.withColumn("kind", F.when(F.col("seq") % 7 == 3, "near_miss").otherwise(F.col("kind")))
    return audit.audit_report(near).select("near_miss_count")


@query("j2_status_counts", with_views("journal", extra=_FOLD, body="select status, count(*) as actions from fold group by 1"))
def _(t: Telemetry) -> DataFrame:
    return audit.status_counts(t.journal)


_ATTEMPTS = _FOLD | {
    "st": """select action_id, case when status in ('posted', 'proposed') then 'approved' else status end as status, (cast(substr(action_id, 5) as bigint) % 3) as h from fold""",
    "att": "select concat('act_', user_id) as action_id, event_id as attempt_seq, event_id % 3 as h, event_id as now from events where event_type='purchase'",
    "jd": """select att.action_id, attempt_seq, case when status in ('executing', 'done', 'failed') then 'already_consumed' when coalesce(status, '') <> 'approved' then 'not_approved'
      when now > 500 and att.action_id like '%1' then 'expired' when att.h <> st.h then 'denied_hash' else 'executed' end as v from att left join st using (action_id)""",
    "se": "select action_id, min(attempt_seq) as a, arg_min(v, attempt_seq) as v from jd where v in ('executed', 'expired') group by 1",
}


@query("j3_gate_decisions", with_views("journal", extra=_ATTEMPTS, body="""
select action_id, attempt_seq, case when attempt_seq > se.a then case when se.v='executed' then 'already_consumed' else 'not_approved' end else jd.v end as verdict
from jd left join se using (action_id)"""))
def _(t: Telemetry) -> DataFrame:
    number = F.substring("action_id", 5, 20).cast("long")
    states = audit.fold_journal(t.journal).select(
        "action_id", F.when(F.col("status").isin("posted", "proposed"), "approved").otherwise(F.col("status")).alias("status"),
        F.when(F.col("action_id").endswith("1"), 500).alias("expires_at"), (number % 3).alias("approved_hash"))
    attempts = t.table("events").where("event_type = 'purchase'").select(
        F.concat(F.lit("act_"), F.col("user_id").cast("string")).alias("action_id"), F.col("event_id").alias("attempt_seq"),
        F.col("event_id").alias("now"), (F.col("event_id") % 3).alias("content_hash"))
    return audit.gate_decisions(states, attempts)


@query("j4_content_hash", """
select event_id, sha256(concat('{"kind": "', event_type, '", "params": {"replicas": ', user_id, ', "zone": "z', user_id % 3, '"}, "target_service": "svc"}')) as content_hash from events""")
def _(t: Telemetry) -> DataFrame:
    zone = F.concat(F.lit('"z'), (F.col("user_id") % 3).cast("string"), F.lit('"'))
    params = F.create_map(F.lit("zone"), zone, F.lit("replicas"), F.col("user_id").cast("string"))
    return t.table("events").select("event_id", audit.content_hash("event_type", F.lit("svc"), params).alias("content_hash"))


def results(t: Telemetry) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    faults = F.array(*[F.lit(x) for x in ("cpu", "Memory pressure", "delay", "errors", "loss", "")])
    signs = F.array(F.lit("resource"), F.lit("latency"), F.lit("error"), F.lit("other"))
    return t.table("orders").select(
        k.alias("run_id"), F.concat(F.lit("svc"), (c % 5).cast("string")).alias("target_service"), F.get(faults, (k % 6).cast("int")).alias("fault_type"),
        F.get(signs, (c % 4).cast("int")).alias("signature"), (F.col("o_orderstatus") != "P").alias("confident"))


@query("j5_suggest_actions", """
with r as (select o_orderkey as run_id, concat('svc', o_custkey % 5) as svc, o_orderstatus <> 'P' as confident, o_orderkey % 6 as f, o_custkey % 4 as s from orders),
k as (select *, case when not confident then '' when f = 0 then 'cpu' when f = 1 then 'memory' when f = 2 then 'delay' when f = 4 then 'loss'
    when s = 0 then 'cpu' when s = 1 then 'delay' when s = 2 then 'error' else '' end as key from r),
m(key, position, kind, risk, d) as (values ('cpu', 1, 'restart', 'low', 'Start @ afresh.'), ('cpu', 2, 'scale', 'low', 'Run @ with 2 replicas.'),
  ('memory', 1, 'restart', 'low', 'Start @ afresh.'), ('memory', 2, 'scale', 'low', 'Run @ with 2 replicas.'),
  ('delay', 1, 'remove_impairment', 'low', 'Take the impairment off @.'), ('delay', 2, 'restart', 'low', 'Start @ afresh.'),
  ('loss', 1, 'remove_impairment', 'low', 'Take the impairment off @.'), ('loss', 2, 'restart', 'low', 'Start @ afresh.'),
  ('error', 1, 'revert_change', 'medium', 'Undo the latest change to @.'), ('error', 2, 'restart', 'low', 'Start @ afresh.'),
  ('', 1, 'open_ticket', 'low', 'File a ticket about @.'), ('', 2, 'page_oncall', 'low', 'Call whoever is on duty for @.'))
select run_id, svc as target_service, position, kind, case when key = '' then 'notify' else 'mutate' end as effect, risk, replace(d, '@', svc) as description, key <> '' and position = 1 as is_primary,
  true as reversible, case when kind = 'scale' then '2' else '-' end as replicas, concat('trace of ', svc, ';', run_id) as citations,
  sha256(concat('{"kind": "', kind, '", "params": {', case when kind = 'scale' then '"replicas": 2' else '' end, '}, "target_service": "', svc, '"}')) as content_hash
from k join m using (key)""")
def _(t: Telemetry) -> DataFrame:
    cited = F.array(F.concat(F.lit("trace of "), "target_service"), F.col("run_id").cast("string"))
    found = audit.suggest_actions(results(t).withColumn("citations", cited))
    return found.withColumn("replicas", F.coalesce(F.try_element_at("params", F.lit("replicas")), F.lit("-"))).withColumn(
        "citations", F.array_join("citations", ";")).drop("params")


@query("j5_briefs", """
select o_orderkey as run_id, concat('svc', o_custkey % 5) as root_cause_service, case when o_orderkey % 2 = 0 then 'latency' else 'error' end as signature,
  'a,b,c' as citations, o_orderkey % 2 = 0 and o_orderstatus = 'F' as confident, concat('svc', o_custkey % 5) as target_service from orders""")
def _(t: Telemetry) -> DataFrame:
    o = t.table("orders")
    k, svc = F.col("o_orderkey"), F.concat(F.lit("svc"), (F.col("o_custkey") % 5).cast("string"))
    even = k % 2 == 0
    runs = o.select(k.alias("run_id"), svc.alias("root_cause_service"), F.lit("cpu").alias("fault_type"),
                    F.when(even, F.array(svc, F.lit("y"))).otherwise(F.array(F.lit("top"), svc)).alias("ranked_services"))
    lines = F.array(*[F.lit(x) for x in "abcd"])
    none = F.lit(None).cast("string")
    own = o.select(k.alias("run_id"), F.lit(1).alias("place"), svc.alias("candidate_service"), none.alias("root_cause_service"),
                   (F.col("o_orderstatus") == "F").alias("supported"), F.lit("latency").alias("signature"), lines.alias("evidence"))
    top = o.where(k % 2 != 0).select(k.alias("run_id"), F.lit(2).alias("place"), F.lit("top").alias("candidate_service"), none.alias("root_cause_service"),
                                     F.lit(True).alias("supported"), F.lit("error").alias("signature"), lines.alias("evidence"))
    found = audit.briefs(runs, own.unionByName(top))
    return found.withColumn("citations", F.array_join("citations", ",")).drop("fault_type", "top_services")


@query("j6_recovery", """
select event_id, case when event_type='error' then false when user_id % 2 = 0 then value / 4 < 10 else value / 4 < value * 0.5 / 3 end as recovered from events""")
def _(t: Telemetry) -> DataFrame:
    after = F.when(F.col("event_type") != "error", F.col("value") / 4)
    threshold = F.when(F.col("user_id") % 2 == 0, 10.0)
    return t.table("events").select("event_id", audit.is_recovered(F.col("value") * 0.5, after, threshold).alias("recovered"))


@query("j7_frame_at", with_views("spans", "logs", extra={
    "fr": "select incident_id as stream_id, time as fetched_at, max(span_id) as payload from spans where status='ERROR' group by 1, 2",
    "pr": "select incident_id as stream_id, concat(trace_id, '-', span_id) as probe_id, time as at from logs where severity='Warn'"}, body="""
select p.stream_id, p.probe_id, p.at, coalesce(f.fetched_at, (select min(fetched_at) from fr where fr.stream_id=p.stream_id)) as fetched_at,
  coalesce(f.payload, (select arg_min(payload, fetched_at) from fr where fr.stream_id=p.stream_id)) as payload
from pr p asof left join fr f on p.stream_id=f.stream_id and p.at >= f.fetched_at"""))
def _(t: Telemetry) -> DataFrame:
    frames = t.spans.where("status = 'ERROR'").groupBy(F.col("incident_id").alias("stream_id"), F.col("time").alias("fetched_at")).agg(
        F.max("span_id").alias("payload"))
    probes = t.span_events.where("event_type = 'signup'").select(
        F.col("incident_id").alias("stream_id"), F.concat_ws("-", "trace_id", "span_id").alias("probe_id"), F.col("time").alias("at"))
    return audit.frame_at(frames, probes)
