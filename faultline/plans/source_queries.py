"""Queries S1-S24: payloads are rendered from the test tables row by row, then ingested again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.spans import dedup_spans
from faultline.plans.registry import query
from faultline.plans.review_queries import _CASES, cases, rules
from faultline.plans.signal_queries import rounded
from faultline.plans.sqltext import ONSET_EFFECTS
from faultline.plans.views import SERVICE_BY_POSITION, Telemetry, log_columns, with_views
from faultline.session import scratch_path
from faultline.sources import benchmark, bundle, case_folders as case_folders_source, otlp, sampling, vendor

BASE_S = 1_700_000_000
SERVICES = sorted({name for row in SERVICE_BY_POSITION for name in row})


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})


def span_lines(t: Telemetry) -> DataFrame:
    """Spans as JSON lines; some rows are broken on purpose, by position in the trace."""
    k = F.col("event_id") % 10
    attributes = F.create_map(F.lit("span.kind"), F.col("span_kind"))
    good = json_object(
        trace_id=F.col("trace_id"), span_id=F.col("span_id"), parent_span_id=F.col("parent_span_id"), time=F.when(k == 3, -1).otherwise(F.col("time")),
        service=F.when(k == 4, "").otherwise(F.col("service")), operation=F.col("operation"), duration_ms=F.col("duration_ms"), status=F.col("status"),
        attributes=attributes, surprise=F.when(k == 5, F.lit("x")))
    return t.span_events.select("incident_id", F.when(k == 6, F.lit("not json")).otherwise(good).alias("line"))


@query("s1_bundle_round_trip", with_views("spans", "metrics", "logs", "changes", body="""
select 'spans' as signal, incident_id, count(*) as n, sum(time) as seconds from spans group by all
union all select 'metrics', incident_id, count(*), sum(time) from metrics group by all
union all select 'logs', incident_id, count(*), sum(time) from logs group by all
union all select 'changes', incident_id, count(*), sum(time) from changes group by all"""))
def _(t: Telemetry) -> DataFrame:
    """Canonical tables written as JSON lines per incident, validated and read back."""
    root = scratch_path(t.spark, "bundle")
    kind = F.create_map(F.lit("span.kind"), F.col("span_kind"))
    tables = {
        "traces": t.spans.withColumn("attributes", kind).drop("span_kind"), "metrics": t.metrics.withColumn("unit", F.lit("u")),
        "logs": t.logs, "changes": t.changes.withColumn("diff_touches", F.array(F.lit("a"), F.lit("b")))}
    out = None
    for signal, df in tables.items():
        df.withColumn("incident", F.col("incident_id")).select("incident", F.to_json(F.struct(*[c for c in df.columns if c != "incident_id"])).alias("value")).write.partitionBy(
            "incident").text(f"{root}/{signal}")
        lines = t.spark.read.text(f"{root}/{signal}").select(F.col("value").alias("line"), F.col("incident").alias("incident_id"))
        valid, _ = bundle.split_valid(bundle.validate_rows(lines, signal))
        counted = valid.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.sum("time").alias("seconds")).select(
            F.lit("spans" if signal == "traces" else signal).alias("signal"), "incident_id", "n", "seconds")
        out = counted if out is None else out.unionByName(counted)
    return out


def lay_out(rows: DataFrame, root: str, name: str, form: str) -> None:
    """Write ``rows`` as ``<root>/<incident>/<name>``; a tilde in the column ``incident`` stands for a level of folders."""
    spark, staged = rows.sparkSession, f"{root}-staged/{name}"
    rows.write.partitionBy("incident").format(form).options(header="true", escape='"').save(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in fs.globStatus(path(f"{staged}/incident=*")):
        folder = found.getPath()
        target = path(f"{root}/{folder.getName().removeprefix('incident=').replace('~', '/')}/{name}")
        fs.mkdirs(target.getParent())
        fs.rename(folder, target)


def write_bundles(t: Telemetry, root: str) -> None:
    """A bundle folder per incident below ``root``: public signal files, a manifest, and a sealed truth that no reader may touch."""
    key = F.col("incident_id").alias("incident")
    stamp = F.col("onset_second")
    alert = F.struct(
        F.lit("UserFacingDegradation").alias("alertname"), F.lit("critical").alias("severity"), stamp.alias("starts_at_second"), F.lit("e > 1").alias("expr"),
        F.lit(2.5).alias("value"), F.col("incident_id").alias("fingerprint"))
    manifest = json_object(
        scenario_id=F.col("incident_id"), source=F.lit("recorded"), time_unit=F.lit("second"), window=F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")),
        symptom=F.lit("slow"), available_signals=F.array(F.lit("traces")), notes=F.array(F.lit("n")), alerts=F.array(alert, alert.withField("starts_at_second", stamp + 60)))
    steps = F.explode(F.array(json_object(id=F.lit("rb-1"), title=F.col("incident_id")), json_object(id=F.lit("rb-2"))))
    row = lambda df: F.to_json(F.struct(*[c for c in df.columns if c != "incident_id"]))
    metrics, changes = t.metrics.withColumn("unit", F.lit("u")), t.changes.withColumn("diff_touches", F.array(F.lit("a")))
    files = {
        "public/traces.jsonl": span_lines(t).select(key, F.col("line").alias("value")), "public/metrics.jsonl": metrics.select(key, row(metrics).alias("value")),
        "public/logs.jsonl": t.logs.drop("span_id").select(key, row(t.logs.drop("span_id")).alias("value")), "public/changes.jsonl": changes.select(key, row(changes).alias("value")),
        "public/manifest.json": t.incidents.select(key, manifest.alias("value")), "public/runbooks.jsonl": t.incidents.select(key, steps.alias("value")),
        "eval_only/truth.json": t.truth.select(key, F.lit("sealed").alias("value"))}
    for name, lines in files.items():
        lay_out(lines, root, name, "text")


@query("s1_bundle_scan", with_views("spanev", "metrics", "logs", "changes", "incidents", body="""
select 'spans' as part, incident_id, count(*) as n, sum(time) as total from spanev where event_id % 10 not in (3, 4, 5, 6) group by all
union all select 'rejects', incident_id, count(*), 0 from spanev where event_id % 10 in (3, 4, 5, 6) group by all
union all select 'metrics', incident_id, count(*), sum(time) from metrics group by all
union all select 'logs', incident_id, count(*), sum(time) from logs group by all
union all select 'changes', incident_id, count(*), sum(time) from changes group by all
union all select 'incidents', incident_id, 1, window_end from incidents
union all select 'alerts', incident_id, 2, 2 * onset_second + 60 from incidents
union all select 'runbooks', incident_id, 2, 1 from incidents"""))
def _(t: Telemetry) -> DataFrame:
    """Bundle folders with broken span lines and a sealed truth, read back by the scan."""
    root = scratch_path(t.spark, "bundles")
    write_bundles(t, root)
    found = bundle.read_bundles(t.spark, root, strict=False)
    measures = {
        "spans": F.col("time"), "rejects": F.lit(0), "metrics": F.col("time"), "logs": F.col("time"), "changes": F.col("time"), "incidents": F.col("window_end"),
        "alerts": F.col("starts_at_second"), "runbooks": F.map_contains_key("runbook", F.lit("title")).cast("int")}
    out = None
    for part, measure in measures.items():
        counted = found[part].groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.sum(measure).cast("long").alias("total")).select(
            F.lit(part).alias("part"), "incident_id", "n", "total")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("s2_strict_validation", with_views("spanev", body="""
select incident_id, case event_id % 10 when 3 then 'time is missing or negative' when 4 then 'service is empty' when 5 then 'unknown field surprise'
  when 6 then 'not a JSON object' else '' end as reason, count(*) as n from spanev group by all"""))
def _(t: Telemetry) -> DataFrame:
    checked = bundle.validate_rows(span_lines(t), "traces")
    reason = F.coalesce(F.get("reject_reasons", F.lit(0)), F.lit(""))
    return checked.groupBy("incident_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_span_dedup", with_views("spans", body="""
select incident_id, span_id, trace_id, parent_span_id, time, service, duration_ms from spans"""))
def _(t: Telemetry) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(1), F.lit(1) + (F.col("time") % 5)))
    repeated = t.spans.withColumn("_c", copies).drop("_c")
    return dedup_spans(repeated).select("incident_id", "span_id", "trace_id", "parent_span_id", "time", "service", "duration_ms")


@query("s4_prometheus_matrix", with_views("metrics", body=f"""
select incident_id, case when time % 21600 = 0 then 'batch' else service end as service, 'm' as metric, time, round(value, 6) as value, 'ratio' as unit, concat('kind=', metric) as attributes
from metrics where service <> 'ad' or time % 21600 = 0"""))
def _(t: Telemetry) -> DataFrame:
    stamp = (F.lit(BASE_S) + F.col("time") + 0.4).cast("string")
    label = F.when(F.col("time") % 21600 == 0, F.lit('"job": "batch"')).when(F.col("service") == "ad", F.lit('"other": "x"')).otherwise(
        F.concat(F.lit('"service_name": "'), "service", F.lit('"')))
    doc = F.concat(F.lit('{"result": [{"metric": {'), label, F.lit(', "kind": "'), "metric", F.lit('", "flag": "paymentFailure"}, "values": [['), stamp, F.lit(', "'),
                   F.col("value").cast("string"), F.lit('"], ['), stamp, F.lit(', "NaN"]]}]}'))
    docs = t.metrics.select("incident_id", F.lit(float(BASE_S)).alias("start_s"), doc.alias("doc"))
    found = vendor.prometheus_matrix(docs, "m", "ratio")
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rounded(found.withColumn("attributes", F.array_join(pairs, ",")), "value")


_STATUS = """case when event_id % 6 = 0 then 'ERROR' when event_id % 6 = 1 and event_id % 4 <> 0 then 'ERROR' when event_id % 6 = 2 and 400 + event_id % 200 >= 500 then 'ERROR'
  when event_id % 6 = 3 and event_id % 4 = 1 then 'ERROR' else 'OK' end"""


def tag_objects() -> Column:
    """Tags as JSON, choosing one status convention per span."""
    k, e = F.col("event_id") % 6, F.col("event_id")
    one = lambda key, value: F.concat(F.lit('{"key": "' + key + '", "value": '), value, F.lit("}"))
    return F.concat(F.lit("["), F.when(k == 0, one("error", F.lit("true"))).when(k == 1, one("rpc.grpc.status_code", (e % 4).cast("string")))
                    .when(k == 2, one("http.status_code", (F.lit(400) + e % 200).cast("string")))
                    .when(k == 3, one("otel.status_code", F.when(e % 4 == 1, F.lit('"error"')).otherwise(F.lit('"OK"'))))
                    .when(k == 5, one("error", F.lit('"true"')))  # a string is no flag
                    .otherwise(one("feature_flag.key", F.lit('"secret"'))), F.lit(', {"key": "span.kind", "value": "'), "span_kind", F.lit('"}]'))


@query("s5_jaeger_traces", with_views("spanev", body=f"""
select incident_id, trace_id, span_id, parent_span_id, time, service, operation, round(duration_ms, 6) as duration_ms, {_STATUS} as status from spanev"""))
def _(t: Telemetry) -> DataFrame:
    refs = F.when(F.col("parent_span_id").isNull(), F.lit("[]")).otherwise(F.concat(
        F.lit('[{"refType": "FOLLOWS_FROM", "spanID": "zz"}, {"refType": "CHILD_OF", "spanID": "'), "parent_span_id", F.lit('"}]')))
    doc = F.concat(
        F.lit('{"processes": {"p1": {"serviceName": "'), "service", F.lit('"}}, "spans": [{"traceID": "'), "trace_id", F.lit('", "spanID": "'), "span_id",
        F.lit('", "processID": "p1", "operationName": "'), "operation", F.lit('", "startTime": '), ((F.lit(BASE_S) + F.col("time")) * 1000000).cast("string"),
        F.lit(', "duration": '), (F.col("duration_ms") * 1000).cast("string"), F.lit(', "references": '), refs, F.lit(', "tags": '), tag_objects(),
        F.lit('}, {"traceID": "t", "spanID": "x", "processID": "p9", "startTime": 1, "duration": 1, "tags": []}]}'))
    found = vendor.jaeger_traces(t.span_events.select("incident_id", F.lit(float(BASE_S)).alias("start_s"), doc.alias("doc")))
    return rounded(found.drop("attributes"), "duration_ms")


@query("s6_span_status", with_views("spanev", body=f"select event_id, {_STATUS} as status from spanev"))
def _(t: Telemetry) -> DataFrame:
    tags = F.from_json(tag_objects(), "array<struct<key: string, value: variant>>")
    return t.span_events.select("event_id", vendor.span_status(tags).alias("status"))


@query("s7_opensearch_logs", with_views("logs", body="""
select incident_id, trace_id, service, time, message, case when lower(severity)='info' then 'INFO' else severity end as severity from logs"""))
def _(t: Telemetry) -> DataFrame:
    iso = F.date_format(F.timestamp_seconds(F.lit(BASE_S) + F.col("time")), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.concat(iso, F.lit(".4"), F.repeat(F.lit("3"), (F.col("time") % 8).cast("int")), F.lit("Z"))
    level = F.when(F.lower("severity") == "info", F.lit("")).when(F.col("time") % 2 == 0, F.concat(F.lit(', "severityText": "'), "severity", F.lit('"'))).otherwise(
        F.concat(F.lit(', "severity": {"text": "'), "severity", F.lit('"}')))
    place = F.when(F.col("time") % 3 == 0, F.lit('"attributes": {"service_name": "')).otherwise(F.lit('"resource": {"service.name": "'))
    doc = F.concat(F.lit('{"_id": "x", "_source": {"body": "'), "message", F.lit('", '), place, "service", F.lit('"}, "observedTimestamp": "'), stamp, F.lit('"'), level,
                   F.lit(', "traceId": "'), "trace_id", F.lit('"}}'))
    found = vendor.opensearch_logs(t.logs.select("incident_id", F.lit(float(BASE_S)).alias("start_s"), doc.alias("doc")))
    return found.drop("attributes")


_START_MS = BASE_S * 1000


@query("s8_flat_spans", with_views("spanev", body="""
select incident_id, trace_id, span_id, parent_span_id, time, service, operation, duration_ms, status, span_kind from spanev where event_id % 9 <> 0"""))
def _(t: Telemetry) -> DataFrame:
    rows = t.span_events.select(
        "incident_id", F.lit(_START_MS).alias("start_ms"), (F.lit(_START_MS) + F.col("time") * 1000 + 999).alias("timestamp"), F.col("trace_id").alias("trace.id"),
        F.when(F.col("event_id") % 9 != 0, F.col("span_id")).alias("id"), F.col("parent_span_id").alias("parent.id"), F.col("duration_ms").cast("string").alias("duration.ms"),
        F.col("operation").alias("name"), F.col("service").alias("service.name"), F.col("span_kind").alias("span.kind"), F.col("status").alias("otel.status_code"))
    return vendor.flat_spans(rows).drop("attributes")


@query("s8_flat_logs", with_views("logs", body="""
select incident_id, time, service, case when lower(severity)='debug' then 'INFO' else severity end as severity, message, trace_id from logs"""))
def _(t: Telemetry) -> DataFrame:
    rows = t.logs.select(
        "incident_id", F.lit(_START_MS).alias("start_ms"), (F.lit(_START_MS) + F.col("time") * 1000).alias("timestamp"), "message", F.col("service").alias("service.name"),
        F.when(F.col("severity") == "Warn", F.col("severity")).alias("severity.text"), F.when(~F.col("severity").isin("Warn", "debug"), F.col("severity")).alias("level"),
        F.col("trace_id").alias("trace.id"))
    return vendor.flat_logs(rows)


@query("s8_flat_changes", with_views("changes", body="""
select incident_id, id, time, service, kind, summary, case when kind='deploy' then 'a|b' else '' end as diff_touches from changes"""))
def _(t: Telemetry) -> DataFrame:
    rows = t.changes.select(
        "incident_id", F.lit(_START_MS).alias("start_ms"), (F.lit(_START_MS) + F.col("time") * 1000 + 1).alias("timestamp"), F.col("id").alias("changeId"), "service", "kind", "summary",
        F.when(F.col("kind") == "deploy", "a,,b").alias("diffTouches"))
    return vendor.flat_changes(rows).withColumn("diff_touches", F.array_join("diff_touches", "|"))


@query("s8_bucket_metrics", with_views("metrics", body="""
select incident_id, time, service, 'm' as metric, round(value, 6) as value, 'u' as unit from metrics"""))
def _(t: Telemetry) -> DataFrame:
    value = F.col("value").cast("string")
    body = F.when(F.col("metric") == "cpu_cores", F.concat(F.lit('{"s": "9 [", "l": [1, [2, {"x": 3}]], "a": {"b": {"c": {"d": {"95": '), value, F.lit("}}}}}"))).otherwise(value)
    doc = F.concat(F.lit('{"endTimeSeconds": 9, "flag": true, "name": "7", "v": '), body, F.lit(', "w": 1.5, "beginTimeSeconds": '),
                   (F.lit(BASE_S) + F.col("time")).cast("string"), F.lit("}"))
    rows = t.metrics.select("incident_id", "service", F.lit(_START_MS).alias("start_ms"), doc.alias("doc"))
    return rounded(vendor.bucketed_metrics(rows, "m", "u"), "value")


@query("s9_otlp_traces", with_views("spanev", body="""
select incident_id, lower(hex(encode(trace_id))) as trace_id, lower(hex(encode(span_id))) as span_id, lower(hex(encode(parent_span_id))) as parent_span_id, time, service, operation,
  round(floor(duration_ms * 1000) / 1000, 6) as duration_ms, status, span_kind from spanev"""))
def _(t: Telemetry) -> DataFrame:
    start = (F.lit(BASE_S) + F.col("time")) * 1000000000
    finish = start + F.floor(F.col("duration_ms") * 1000).cast("long") * 1000
    parent = F.when(F.col("parent_span_id").isNull(), F.lit("")).otherwise(F.concat(F.lit(', "parentSpanId": "'), F.base64(F.col("parent_span_id").cast("binary")), F.lit('"')))
    code = F.when(F.col("status") == "ERROR", F.when(F.col("time") % 2 == 0, F.lit("2")).otherwise(F.lit('"STATUS_CODE_ERROR"'))).otherwise(F.lit("0"))
    doc = F.concat(
        F.lit('{"batches": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "'), "service", F.lit('"}}]}, "scopeSpans": [{"spans": [{"traceId": "'),
        F.base64(F.col("trace_id").cast("binary")), F.lit('", "spanId": "'), F.base64(F.col("span_id").cast("binary")), F.lit('"'), parent, F.lit(', "name": "'), "operation",
        F.lit('", "startTimeUnixNano": "'), start.cast("string"), F.lit('", "endTimeUnixNano": "'), finish.cast("string"), F.lit('", "status": {"code": '), code,
        F.lit('}, "attributes": [{"key": "span.kind", "value": {"stringValue": "'), "span_kind", F.lit('"}}]}]}]}]}'))
    docs = t.span_events.select("incident_id", F.lit(_START_MS).alias("start_ms"), doc.alias("doc"))
    return rounded(vendor.otlp_traces(docs), "duration_ms")


def wide_frame(t: Telemetry, suffixes: dict[str, str]) -> DataFrame:
    """Metrics pivoted to one column per service and metric, one row per incident and time."""
    names = [F.max(F.when((F.col("service") == s) & (F.col("metric") == m), F.col("value"))).alias(f"{s}_{suffix}") for s in SERVICES for m, suffix in suffixes.items()]
    return t.metrics.groupBy("incident_id", (F.col("time") + BASE_S).alias("time")).agg(*names)


def windows(t: Telemetry) -> DataFrame:
    inject = t.incidents.select("incident_id", (F.lit(BASE_S) + F.col("onset_second")).alias("inject_time"))
    return benchmark.make_windows(inject, pre=144000, post=100000)


_CUT = "time between 216000 - 144000 and 216000 + 100000"


@query("s10_wide_metrics_json", with_views("metrics", body=f"""
select incident_id, service, case metric when 'cpu_cores' then 'cpu_utilization' else metric end as metric, time - 72000 as time, round(value, 6) as value,
  case metric when 'request_error_rate' then 'ratio' when 'latency_p95_ms' then 'ms' else 'ratio' end as unit from metrics where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    wide = wide_frame(t, {"request_error_rate": "error-rate", "latency_p95_ms": "resp_time_p95", "cpu_cores": "CPU_total"})
    objects = wide.select("incident_id", F.to_json(F.struct(*[c for c in wide.columns if c != "incident_id"])).alias("o"))
    docs = objects.select("incident_id", F.concat(F.lit("["), "o", F.lit("]")).alias("doc"))
    return rounded(benchmark.json_metrics(docs, windows(t)), "value")


@query("s10_wide_metrics_frame", with_views("metrics", body=f"""
select incident_id, service, case metric when 'cpu_cores' then 'queue' when 'latency_p95_ms' then 'memory_mb' else metric end as metric, time - 72000 as time, round(value, 6) as value,
  case metric when 'request_error_rate' then 'ratio' when 'latency_p95_ms' then 'MB' else 'count' end as unit from metrics where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    wide = wide_frame(t, {"request_error_rate": "errors", "latency_p95_ms": "mem_rss", "cpu_cores": "queue"})
    return rounded(benchmark.wide_metrics(wide, windows(t)), "value")


@query("s11_wide_metrics_csv", with_views("metrics", body=f"""
select incident_id, case when service = 'ad' then 'adservice' else service end as service, case metric when 'cpu_cores' then 'socket' else metric end as metric, time - 72000 as time,
  round(case metric when 'latency_p95_ms' then value * 1000 else value end, 6) as value, case metric when 'request_error_rate' then 'ratio' when 'latency_p95_ms' then 'ms' else 'count' end as unit
from metrics where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    """The wide frame goes through a real CSV file with a header, then back in."""
    path = scratch_path(t.spark, "wide-csv")
    wide = wide_frame(t, {"request_error_rate": "error", "latency_p95_ms": "latency-90", "cpu_cores": "socket"})
    wide.write.option("header", "true").csv(path)
    seen = t.spans.select("incident_id", F.when(F.col("service") == "ad", "adservice").otherwise(F.col("service")).alias("service")).distinct()
    return rounded(benchmark.wide_metrics(t.spark.read.option("header", "true").csv(path), windows(t), seen), "value")


@query("s12_reconcile_services", with_views("spans", body="""
select incident_id, case when service in ('ad', 'cart', 'shipping') then concat(service, 'service') else service end as service, count(*) as n from spans group by all"""))
def _(t: Telemetry) -> DataFrame:
    seen = t.spans.select("incident_id", F.when(F.col("service").isin("ad", "cart", "shipping"), F.concat("service", F.lit("service"))).when(
        F.col("service") != "payment", F.col("service")).alias("service")).where("service IS NOT NULL")
    fixed = benchmark.reconcile_services(t.spans.select("incident_id", "service", "span_id"), seen)
    return fixed.groupBy("incident_id", "service").agg(F.count(F.lit(1)).alias("n"))


@query("s13_aliased_logs", with_views("logs", body=f"""
select incident_id, time - 72000 as time, case when service='ad' then 'unknown' else service end as service, case when severity='debug' then 'info' else severity end as severity, message, trace_id
from logs where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    even = F.col("time") % 2 == 0
    rows = t.logs.select(
        "incident_id", F.when(even, (F.lit(BASE_S) + F.col("time")).cast("string")).otherwise("").alias("timestamp"), (F.lit(BASE_S) + F.col("time") + 0.25).cast("string").alias("time"),
        F.when(F.col("service") == "ad", "").when(even, F.col("service")).alias("service"), F.when(F.col("service") != "ad", F.col("service")).alias("pod"),
        F.when(F.col("severity") != "debug", F.col("severity")).alias("level"), F.col("message").alias("log"), F.col("trace_id").alias("traceId"))
    return benchmark.aliased_logs(rows, windows(t))


@query("s13_nanosecond_logs", with_views("logs", body=f"""
select incident_id, time - 72000 as time, service, severity, message, trace_id from logs where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    rows = t.logs.select("incident_id", F.concat((F.lit(BASE_S) + F.col("time")).cast("string"), F.lit("500000000")).alias("timestamp"),
                         F.col("service").alias("container_name"), F.col("severity").alias("level"), "message", "trace_id")
    return benchmark.nanosecond_logs(rows, windows(t))


@query("s14_aliased_traces", with_views("spans", body=f"""
select incident_id, time - 72000 as time, trace_id, span_id, parent_span_id, service, operation, duration_ms, case when status='OK' then 'UNSET' else status end as status from spans where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    rows = t.spans.select(
        "incident_id", (F.lit(BASE_S) + F.col("time")).cast("string").alias("startTime"), F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parent_id"), F.col("service").alias("serviceName"), F.col("operation").alias("name"), F.col("duration_ms").cast("string").alias("duration"),
        F.when(F.col("status") == "ERROR", "ERROR").otherwise("").alias("status"))
    return benchmark.aliased_traces(rows, windows(t))


_KINDS = {
    "link": "select c.incident_id, c.span_id, c.parent_span_id from spans c join spans p on p.incident_id=c.incident_id and p.span_id=c.parent_span_id where p.service <> c.service",
    "kinds": """select s.*, case when exists (select 1 from link l where l.incident_id=s.incident_id and l.parent_span_id=s.span_id) then 'client'
      when exists (select 1 from link l where l.incident_id=s.incident_id and l.span_id=s.span_id) then 'server' else 'internal' end as k from spans s"""}


@query("s14_microsecond_traces", with_views("spans", extra=_KINDS, body=f"""
select incident_id, time - 72000 as time, trace_id, span_id, parent_span_id, service, operation, round(duration_ms, 6) as duration_ms, status, k as span_kind from kinds where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    rows = t.spans.select(
        "incident_id", ((F.lit(BASE_S) + F.col("time")) * 1000 + 700).cast("string").alias("startTimeMillis"), F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"),
        F.col("parent_span_id").alias("parentSpanID"), F.col("service").alias("serviceName"), F.col("operation").alias("operationName"),
        (F.col("duration_ms") * 1000).cast("string").alias("duration"), F.when(F.col("status") == "ERROR", "13").otherwise("0").alias("statusCode"))
    return rounded(benchmark.microsecond_traces(rows, windows(t)), "duration_ms")


@query("s15_span_kinds", with_views("spans", extra=_KINDS, body="select incident_id, span_id, k as span_kind from kinds"))
def _(t: Telemetry) -> DataFrame:
    return benchmark.infer_span_kinds(t.spans.drop("span_kind")).select("incident_id", "span_id", "span_kind")


_CASE = {"cs": "select incident_id, concat('re2_', service, '_cpu_', substr(incident_id, 5)) as case_id from truth"}
_CASE_SPANS = _CASE | {
    "rep": "select *, cast(substr(span_id, 2) as bigint) % 10 = 0 as twice from spans",
    "own": "select incident_id, span_id, parent_span_id, case when twice then 'zzz' else service end as service from rep",
    "link": "select c.incident_id, c.span_id, c.parent_span_id from own c join own p on p.incident_id=c.incident_id and p.span_id=c.parent_span_id where p.service <> c.service",
    "kinds": """select o.incident_id, o.span_id, case when exists (select 1 from link l where l.incident_id=o.incident_id and l.parent_span_id=o.span_id) then 'client'
      when exists (select 1 from link l where l.incident_id=o.incident_id and l.span_id=o.span_id) then 'server' else 'internal' end as span_kind from own o""",
    "lines": "select incident_id, span_id, time, service from rep union all select incident_id, span_id, time - 5, 'zzz' from rep where twice"}


def case_folders(t: Telemetry, files: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    """A folder tree of cases with the given CSV files; its root and the windows read back from it."""
    root = scratch_path(t.spark, "cases")
    folder = t.truth.select("incident_id", F.concat("service", F.lit("_cpu~"), F.substring_index("incident_id", "_", -1)).alias("incident"))
    inject = t.incidents.join(folder, "incident_id").select("incident", (F.lit(BASE_S) + F.col("onset_second")).cast("string").alias("value"))
    lay_out(inject, root, "inject_time.txt", "text")
    for name, rows in files.items():
        lay_out(rows.join(folder, "incident_id").drop("incident_id"), root, name, "csv")
    return root, case_folders_source.read_case_windows(t.spark, root, "re2", pre=144000, post=100000)


@query("s15_case_traces", with_views("spans", "truth", extra=_CASE_SPANS, body=f"""
select case_id as incident_id, span_id, time - 72000 as time, service, span_kind from lines join kinds using (incident_id, span_id) join cs using (incident_id) where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    """Spans from a folder tree; each tenth id stands there twice, and its last line is the earlier in time."""
    twice = F.substring("span_id", 2, 99).cast("long") % 10 == 0
    again = t.spans.where(twice).withColumns({"time": F.col("time") - 5, "service": F.lit("zzz")})
    rows = t.spans.withColumn("_again", F.lit(0)).unionByName(again.withColumn("_again", F.lit(1)))
    folder = t.truth.select("incident_id", F.concat("service", F.lit("_cpu~"), F.substring_index("incident_id", "_", -1)).alias("incident"))
    ordered = rows.join(folder, "incident_id").repartitionByRange("incident", "_again", "span_id").sortWithinPartitions("incident", "_again", "span_id")
    root, windows_read = case_folders(t, {})
    lay_out(ordered.select(
        "incident", ((F.lit(BASE_S) + F.col("time")) * 1000 + 700).alias("startTimeMillis"), F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"),
        F.col("parent_span_id").alias("parentSpanID"), F.col("service").alias("serviceName"), F.col("operation").alias("operationName"),
        (F.col("duration_ms") * 1000).alias("duration"), F.lit(0).alias("statusCode")), root, "traces.csv", "csv")
    read = case_folders_source.read_case_csv(t.spark, root, "re2", "traces.csv")
    return benchmark.microsecond_traces(read, windows_read).select("incident_id", "span_id", "time", "service", "span_kind")


@query("s11_case_metrics", with_views("metrics", "truth", extra=_CASE, body=f"""
select case_id as incident_id, case when service = 'ad' then 'adservice' else service end as service, case metric when 'cpu_cores' then 'socket' else metric end as metric, time - 72000 as time,
  round(case metric when 'latency_p95_ms' then value * 1000 else value end, 6) as value, case metric when 'request_error_rate' then 'ratio' when 'latency_p95_ms' then 'ms' else 'count' end as unit
from metrics join cs using (incident_id) where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    """Wide metrics from a folder tree, their services named as in the traces beside them."""
    seen = t.spans.select("incident_id", F.when(F.col("service") == "ad", "adservice").otherwise(F.col("service")).alias("serviceName")).distinct()
    wide = wide_frame(t, {"request_error_rate": "error", "latency_p95_ms": "latency-90", "cpu_cores": "socket"})
    root, cut = case_folders(t, {"simple_metrics.csv": wide, "traces.csv": seen})
    services = case_folders_source.read_case_csv(t.spark, root, "re2", "traces.csv").select("incident_id", F.col("serviceName").alias("service"))
    return rounded(benchmark.wide_metrics(case_folders_source.read_case_csv(t.spark, root, "re2", "simple_metrics.csv").drop("_place"), cut, services), "value")


@query("s13_case_logs", with_views("logs", "truth", extra=_CASE, body=f"""
select case_id as incident_id, time - 72000 as time, service, severity, message, trace_id from logs join cs using (incident_id) where {_CUT}"""))
def _(t: Telemetry) -> DataFrame:
    """Logs in nanoseconds from a folder tree."""
    root, cut = case_folders(t, {"logs.csv": t.logs.select(
        "incident_id", F.concat((F.lit(BASE_S) + F.col("time")).cast("string"), F.lit("500000000")).alias("timestamp"),
        F.col("service").alias("container_name"), F.col("severity").alias("level"), "message", "trace_id")})
    return benchmark.nanosecond_logs(case_folders_source.read_case_csv(t.spark, root, "re2", "logs.csv"), cut)


@query("s16_window_cut", with_views("logs", body=f"select incident_id, time - 72000 as time, service, message from logs where {_CUT}"))
def _(t: Telemetry) -> DataFrame:
    rows = t.logs.select("incident_id", "service", "message", (F.col("time") + BASE_S).alias("time_abs"))
    return benchmark.cut_and_rebase(rows, windows(t)).select("incident_id", "time", "service", "message")


@query("s17_priority_downsample", with_views("logs", extra={
    "pri": "select *, lower(severity) in ('error', 'warn') as p from logs",
    "idx": """select *, row_number() over (partition by incident_id, p order by time, service, severity, message, trace_id, span_id) - 1 as i, count(*) over (partition by incident_id) as n,
      count(*) filter (where p) over (partition by incident_id) as top from pri""",
    "want": """select incident_id, least(n - top - 1, cast(floor(i * ((n - top) / cast(900 - top as double))) as bigint)) as j
      from (select distinct incident_id, n, top from idx where top < 900 and n > 900) s, range(900) r(i) where i < 900 - top"""}, body="""
select incident_id, time, service, severity, message from idx where n <= 900 or case when top >= 900 then p and i < 900 else p or (incident_id, i) in (select incident_id, j from want) end"""))
def _(t: Telemetry) -> DataFrame:
    rows = _numbered_logs(t)
    priority = F.upper("severity").isin("ERROR", "ERR", "CRITICAL", "FATAL", "WARN", "WARNING")
    kept = sampling.priority_downsample(rows, priority, 900, ["service", "severity", "message", "trace_id", "span_id"])
    return kept.select("incident_id", "time", "service", "severity", "message")


def _numbered_logs(t: Telemetry) -> DataFrame:
    """Logs with the id of their span, which makes the order total."""
    return t.span_events.select(*log_columns(), "span_id")


@query("s18_whole_trace_sample", """
with recursive spans as (select * from (%s)),
traces as (select incident_id, trace_id, count(*) as size, max(case when status='ERROR' then 1 else 0 end) as bad from spans group by all),
ranked as (select *, sum(size) over (partition by incident_id) as whole, row_number() over (partition by incident_id order by bad desc, trace_id) as i from traces),
fill as (
  select incident_id, trace_id, size, i, true as taken, size as used from ranked where i = 1
  union all
  select r.incident_id, r.trace_id, r.size, r.i, f.used + r.size <= 700, f.used + case when f.used + r.size <= 700 then r.size else 0 end
  from fill f join ranked r on r.incident_id = f.incident_id and r.i = f.i + 1)
select incident_id, trace_id, size as spans from fill join ranked using (incident_id, trace_id, size) where taken or whole <= 700""" % with_views("spans", body="select * from spans"))
def _(t: Telemetry) -> DataFrame:
    kept = sampling.whole_trace_sample(t.spans, 700)
    return kept.groupBy("incident_id", "trace_id").agg(F.count(F.lit(1)).alias("spans"))


@query("s19_bucketed_pull", with_views("logs", "incidents", extra={
    "slots": "select l.*, least(11, cast(floor(time / 36000.0e0) as bigint)) as slot from logs l",
    "r": "select *, row_number() over (partition by incident_id, slot order by time, service, message, span_id) as rn from slots",
    "d": "select *, row_number() over (partition by incident_id, message order by slot, time, service, message, span_id) as dn from r where rn <= 42"}, body="""
select incident_id, slot, time, service, message from d where dn = 1"""))
def _(t: Telemetry) -> DataFrame:
    rows = _numbered_logs(t)
    pulled = sampling.bucketed_pull(rows, t.incidents, 500, ["service", "message", "span_id"], doc_id="message")
    return pulled.select("incident_id", "slot", "time", "service", "message")


@query("s20_alertmanager", with_views("spanev", extra={
    "a": """select concat('b', cast(event_id // 4 as varchar)) as batch_id, event_id, time + (event_id % 10) / 10.0e0 as s,
      case event_id % 3 when 0 then 'UserFacingDegradation' else 'Other' end as alertname, value_text from (select *, cast(user_id as varchar) as value_text from spanev) where event_id % 5 <> 0"""}, body="""
select batch_id, alertname, 'critical' as severity, greatest(0, cast(round_even(s - min(s) over (partition by batch_id), 0) as bigint)) as starts_at_second,
  case when event_id % 2 = 0 then cast(value_text as double) else 0.0 end as value, case alertname when 'Other' then 'live:Other' else 'request_error_rate > 0.02' end as expr,
  left(sha256(concat(alertname, '|tier=user_facing')), 16) as fingerprint from a"""))
def _(t: Telemetry) -> DataFrame:
    """Each event is one payload part: a batch's alerts arrive in several documents."""
    e = F.col("event_id")
    stamp = F.concat(F.date_format(F.timestamp_seconds(F.lit(BASE_S) + F.col("time")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), (e % 10).cast("string"), F.lit("00000000Z"))
    name = F.when(e % 3 == 0, "UserFacingDegradation").otherwise("Other")
    note = F.when(e % 2 == 0, F.concat(F.lit('"value": "'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.lit('"value": "high"'))
    doc = F.concat(F.lit('{"alerts": [{"status": "'), F.when(e % 5 == 0, "resolved").otherwise("firing"), F.lit('", "startsAt": "'), stamp, F.lit('", "labels": {"alertname": "'), name,
                   F.lit('", "severity": "critical", "tier": "user_facing", "pod": "x"}, "annotations": {'), note, F.lit("}}]}"))
    batches = t.span_events.select(F.concat(F.lit("b"), F.floor(e / 4).cast("string")).alias("batch_id"), doc.alias("doc"))
    known = rules(t).where("rule_id = 0").select("alertname", "expr")
    return vendor.alertmanager_batches(batches, known).drop("labels", "annotations")


@query("s21_case_truth", with_views("graded_runs", extra=_CASES, body="""
select case_id as scenario_id, 'service' as kind, service, category as fault_category,
  case fault when 'cpu' then 'cpu exhaustion' when 'mem' then 'memory leak' when 'disk' then 'disk stress' when 'socket' then 'socket stress' when 'delay' then 'network delay' when 'loss' then 'packet loss'
    when 'f1' then 'code fault incorrect parameter' when 'f3' then 'code fault missing call' else fault end as type,
  case fault when 'cpu' then 'cpu_utilization' when 'mem' then 'memory_mb' when 'delay' then 'latency_p95_ms' when 'loss' then 'request_error_rate' end as root_cause_indicator from cases"""))
def _(t: Telemetry) -> DataFrame:
    return benchmark.build_truth(benchmark.parse_cases(cases(t))).drop("accepted_services")


@query("s22_symptoms", with_views("metrics", "incidents", extra=ONSET_EFFECTS | {
    "up": """select * from shifts where post_mean > pre_mean
      union all select * replace (concat(incident_id, '_noerr') as incident_id) from shifts where post_mean > pre_mean and metric <> 'request_error_rate'
      union all select * replace (concat(incident_id, '_bare') as incident_id) from shifts where post_mean > pre_mean and metric not in ('request_error_rate', 'latency_p95_ms')""",
    "b": "select *, row_number() over (partition by incident_id, metric order by round(post_mean - pre_mean, 9) desc, service) as r from up",
    "o": """select *, row_number() over (partition by incident_id order by case metric when 'request_error_rate' then 0 when 'latency_p95_ms' then 1 else 2 end, case when pre_mean > 0 then (post_mean - pre_mean) / pre_mean else 'inf'::double end desc, metric) as p from b where r = 1"""},
    body="""select incident_id, concat(case metric when 'request_error_rate' then 'Elevated error rate on ' when 'latency_p95_ms' then 'Elevated p95 latency on ' else 'Anomalous metric shift on ' end, service, ' beginning around second 216000.') as symptom,
  case metric when 'request_error_rate' then 'HighErrorRate' when 'latency_p95_ms' then 'HighLatency' else 'MetricAnomaly' end as alertname, case metric when 'request_error_rate' then 'critical' else 'warning' end as severity,
  round(post_mean, 6) as value, left(sha1(concat(case metric when 'request_error_rate' then 'HighErrorRate' when 'latency_p95_ms' then 'HighLatency' else 'MetricAnomaly' end, '|service=', service)), 16) as fingerprint from o where p = 1"""))
def _(t: Telemetry) -> DataFrame:
    """Copies of every incident, under ids of their own, lack the error rate or the latency too, so every branch is taken."""
    def copied(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("incident_id", F.concat("incident_id", F.lit(name)))

    given, incidents = t.metrics, t.incidents
    for name, absent in (("_noerr", ["request_error_rate"]), ("_bare", ["request_error_rate", "latency_p95_ms"])):
        given = given.unionByName(copied(t.metrics.where(~F.col("metric").isin(absent)), name))
        incidents = incidents.unionByName(copied(t.incidents, name))
    found = benchmark.synthesise_symptoms(given, incidents)
    return rounded(found.select("incident_id", "symptom", "alertname", "severity", "value", "fingerprint"), "value")


@query("s23_bundle_sink", with_views("spans", "logs", body="""
select 'traces' as signal, incident_id, count(*) as n, round(sum(duration_ms), 3) as total from spans group by all
union all select 'logs', incident_id, count(*), cast(sum(time) as double) from logs group by all"""))
def _(t: Telemetry) -> DataFrame:
    path = scratch_path(t.spark, "sink")
    bundle.write_bundle({"traces": t.spans, "logs": t.logs}, t.truth, path, fmt="parquet")
    read = lambda s: t.spark.read.parquet(f"{path}/public/{s}")
    spans = read("traces").groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_ms"), 3).alias("total"))
    logs = read("logs").groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.sum("time").cast("double").alias("total"))
    out = spans.withColumn("signal", F.lit("traces")).unionByName(logs.withColumn("signal", F.lit("logs")))
    return out.select("signal", "incident_id", "n", "total")


@query("s24_otlp_payloads", with_views("spans", "metrics", "logs", body="""
select 'traces' as signal, incident_id, service, cast(ceil(count(*) / 50) as bigint) as documents, count(*) as records, count(*) filter (where status='ERROR') as marks from spans group by all
union all select 'logs', incident_id, service, cast(ceil(count(*) / 50) as bigint), count(*), count(*) filter (where severity='ERROR') from logs group by all
union all select 'metrics', incident_id, service, cast(sum(ceil(n / 50)) as bigint), cast(sum(n) as bigint), cast(sum(n) as bigint) from (select incident_id, service, metric, count(*) as n from metrics group by all) group by all"""))
def _(t: Telemetry) -> DataFrame:
    marks = {"traces": '"status":{"code":2}', "logs": '"severityText":"ERROR"', "metrics": '"asDouble":'}
    sources = {"traces": otlp.span_records(t.spans, _START_MS), "logs": otlp.log_records(t.logs, _START_MS), "metrics": otlp.metric_records(t.metrics, _START_MS)}
    out = None
    for signal, records in sources.items():
        docs = otlp.payloads(records, signal, batch=50)
        found = (F.length("doc") - F.length(F.replace(F.col("doc"), F.lit(marks[signal]), F.lit("")))) / len(marks[signal])
        per = docs.groupBy("incident_id", "service").agg(
            F.count(F.lit(1)).alias("documents"), F.sum("records").alias("records"), F.sum(found.cast("long")).alias("marks")).withColumn("signal", F.lit(signal))
        out = per if out is None else out.unionByName(per)
    return out.select("signal", "incident_id", "service", "documents", "records", "marks")
