"""Telemetry payloads of common backends, normalised to canonical rows.

Every function takes one JSON document per row (column ``doc``) plus the
incident's window start where time is absolute, and explodes it in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.expr import alert_fingerprint
from faultline.operators.quality import BANNED_TOKENS, public_attributes


def _text(value: Column) -> Column:
    """Null for null or empty text."""
    return F.nullif(value, F.lit(""))


def relative_second(seconds: Column, start: Column) -> Column:
    """Half-even rounding to whole seconds since the window start, not below 0."""
    return F.greatest(F.lit(0), F.bround(seconds - start, 0).cast("long"))


def relative_floor_ms(ms: Column, start_ms: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((ms - start_ms) / 1000).cast("long"))


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO-8601 time with any number of fraction digits."""
    whole = F.regexp_replace(text, r"\.\d+", "")
    fraction = F.coalesce(_text(F.regexp_extract(text, r"\.(\d+)", 1)), F.lit("0"))
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long")
    return F.unix_micros(F.try_to_timestamp(whole)) / 1e6 + micros / 1e6


def prometheus_matrix(docs: DataFrame, metric: str, unit: str, service_label: str = "service_name") -> DataFrame:
    """``docs``: incident_id, start_s, doc = {"result": [{"metric": {}, "values": [[t, "v"]]}]}."""
    schema = "struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"
    series = docs.select("incident_id", "start_s", F.explode(F.from_json("doc", schema)["result"]).alias("s"))
    label = lambda k: _text(F.try_element_at(F.col("s.metric"), F.lit(k)))
    own = [service_label, "service", "job", "__name__"]
    attributes = F.map_filter(public_attributes(F.col("s.metric")), lambda k, v: ~k.isin(*own))
    points = series.select("incident_id", "start_s", F.coalesce(label(service_label), label("service"), label("job")).alias("service"),
                           attributes.alias("attributes"), F.explode("s.values").alias("p")).where((F.size("p") == 2) & F.col("service").isNotNull())
    value = F.get("p", F.lit(1)).try_cast("double")
    return points.select(
        "incident_id", relative_second(F.get("p", F.lit(0)).try_cast("double"), F.col("start_s")).alias("time"), "service",
        F.lit(metric).alias("metric"), value.alias("value"), F.lit(unit).alias("unit"), "attributes",
    ).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def span_status(tags: Column) -> Column:
    """ERROR from the error flag, a gRPC code other than 0, HTTP 5xx, or the OTel status, in that order.

    ``tags`` is an array of (key, value as variant); of a repeated key the last one
    counts. The error flag must be the JSON value true: the string "true" is none.
    """
    tag = lambda k: F.try_element_at(F.filter(tags, lambda t: t["key"] == k), F.lit(-1))["value"]
    text = lambda k: tag(k).cast("string")
    flagged = (F.schema_of_variant(tag("error")) == "BOOLEAN") & (text("error") == "true")
    http = F.coalesce(text("http.response.status_code"), text("http.status_code")).try_cast("double")
    return (
        F.when(flagged, "ERROR").when(text("rpc.grpc.status_code") != "0", "ERROR").when(http >= 500, "ERROR")
        .when(F.upper(text("otel.status_code")) == "ERROR", "ERROR").otherwise("OK"))


def jaeger_traces(docs: DataFrame) -> DataFrame:
    """``docs``: incident_id, start_s, doc = {"processes": {}, "spans": []}."""
    schema = """struct<processes: map<string, struct<serviceName: string>>, spans: array<struct<traceID: string, spanID: string, processID: string,
      operationName: string, startTime: double, duration: double, references: array<struct<refType: string, spanID: string>>,
      tags: array<struct<key: string, value: variant>>>>>"""
    spans = docs.select("incident_id", "start_s", F.from_json("doc", schema).alias("d")).select(
        "incident_id", "start_s", "d.processes", F.explode("d.spans").alias("s"))
    keyed = F.filter(F.coalesce("s.tags", F.array().cast("array<struct<key: string, value: variant>>")), lambda t: t["key"].isNotNull())
    tags = F.aggregate(keyed, F.create_map().cast("map<string,string>"),
                       lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != t["key"]), F.create_map(t["key"], t["value"].cast("string"))))
    # The status comes from all tags, before private ones are taken out.
    staged = spans.withColumn("status", span_status(keyed)).withColumn("tags", public_attributes(tags))
    parents = F.filter("s.references", lambda r: r["refType"] == "CHILD_OF")
    service = F.try_element_at("processes", F.col("s.processID"))["serviceName"]
    return staged.select(
        "incident_id", _text(F.col("s.traceID")).alias("trace_id"), _text(F.col("s.spanID")).alias("span_id"),
        _text(F.get(parents, F.lit(0))["spanID"]).alias("parent_span_id"),
        relative_second(F.col("s.startTime") / 1e6, F.col("start_s")).alias("time"), _text(service).alias("service"),
        F.coalesce(_text(F.col("s.operationName")), F.lit("unknown")).alias("operation"),
        (F.coalesce("s.duration", F.lit(0.0)) / 1000).alias("duration_ms"), "status",
        F.col("tags").alias("attributes"),
    ).where("trace_id IS NOT NULL AND span_id IS NOT NULL AND service IS NOT NULL")


def opensearch_logs(docs: DataFrame, tokens: list[str] = BANNED_TOKENS) -> DataFrame:
    """``docs``: incident_id, start_s, doc = one hit with ``_source``."""
    schema = """struct<_id: string, _source: struct<body: string, resource: map<string,string>, attributes: map<string,string>, time: string,
      timestamp: string, observedTimestamp: string, severityText: string, severity: string, traceId: string, trace_id: string>>"""
    rows = docs.select("incident_id", "start_s", F.from_json("doc", schema)["_source"].alias("s"))

    def named(which: str) -> list[Column]:
        return [_text(F.try_element_at(f"s.{which}", F.lit(k))) for k in ("service.name", "service_name")]

    service = F.coalesce(*named("resource"), *named("attributes"))
    stamp = F.coalesce(_text(F.col("s.time")), _text(F.col("s.timestamp")), _text(F.col("s.observedTimestamp")))
    seconds = F.coalesce(stamp.try_cast("double"), iso_seconds(stamp))
    nested = F.col("s.severity").startswith("{")
    severity = F.coalesce(
        _text(F.col("s.severityText")), F.when(nested, _text(F.get_json_object("s.severity", "$.text"))), _text(F.col("s.severity")), F.lit("INFO"))
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce("s.resource", empty)
    rest = F.map_filter(F.coalesce("s.attributes", empty), lambda k, v: ~F.map_contains_key(own, k))
    kept = rows.where(_text(F.col("s.body")).isNotNull() & service.isNotNull() & stamp.isNotNull()).where(
        ~F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.col("s.body").contains(t)))
    return kept.select(
        "incident_id", relative_second(seconds, F.col("start_s")).alias("time"), service.alias("service"), severity.alias("severity"),
        F.col("s.body").alias("message"), F.coalesce(_text(F.col("s.traceId")), _text(F.col("s.trace_id"))).alias("trace_id"),
        public_attributes(F.map_concat(rest, own), tokens).alias("attributes"))


# ---- flat rows with dotted columns --------------------------------------------------------

def _dotted(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def flat_spans(rows: DataFrame) -> DataFrame:
    """Rows with dotted columns, incident_id and start_ms; ragged rows are dropped."""
    c = lambda n: _dotted(rows, n)
    keep = ("span.kind", "rpc.method", "rpc.service")
    attributes = F.map_filter(F.create_map(*[x for k in keep for x in (F.lit(k), c(k).cast("string"))]), lambda k, v: v.isNotNull())
    out = rows.select(
        "incident_id", _text(c("trace.id")).alias("trace_id"), _text(c("id")).alias("span_id"), _text(c("parent.id")).alias("parent_span_id"),
        relative_floor_ms(F.coalesce(c("timestamp").try_cast("double"), F.col("start_ms")), F.col("start_ms")).alias("time"),
        _text(c("service.name")).alias("service"), _text(c("name")).alias("operation"),
        F.when(c("duration.ms").isNull(), 0.0).otherwise(c("duration.ms").try_cast("double")).alias("duration_ms"),
        F.when(c("otel.status_code") == "ERROR", "ERROR").otherwise("OK").alias("status"), F.lower(c("span.kind")).alias("span_kind"),
        attributes.alias("attributes"))
    return out.where("trace_id IS NOT NULL AND span_id IS NOT NULL AND service IS NOT NULL AND operation IS NOT NULL AND duration_ms >= 0")


def flat_logs(rows: DataFrame) -> DataFrame:
    c = lambda n: _dotted(rows, n)
    out = rows.select(
        "incident_id", relative_floor_ms(F.coalesce(c("timestamp").try_cast("double"), F.col("start_ms")), F.col("start_ms")).alias("time"),
        _text(c("service.name")).alias("service"), F.coalesce(_text(c("severity.text")), _text(c("level")), F.lit("INFO")).alias("severity"),
        _text(c("message")).alias("message"), _text(c("trace.id")).alias("trace_id"))
    return out.where("service IS NOT NULL AND message IS NOT NULL")


def flat_changes(rows: DataFrame) -> DataFrame:
    c = lambda n: _dotted(rows, n)
    touches = F.filter(F.split(F.coalesce(c("diffTouches"), F.lit("")), ","), lambda t: t != "")
    out = rows.select(
        "incident_id", _text(c("changeId")).alias("id"),
        relative_floor_ms(F.coalesce(c("timestamp").try_cast("double"), F.col("start_ms")), F.col("start_ms")).alias("time"),
        _text(c("service")).alias("service"), _text(c("kind")).alias("kind"), _text(c("summary")).alias("summary"), touches.alias("diff_touches"))
    return out.where("id IS NOT NULL AND service IS NOT NULL AND kind IS NOT NULL AND summary IS NOT NULL")


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def first_number(text: Column) -> Column:
    """First number of a JSON value, looking into nested objects of any depth in key order; booleans, strings and arrays do not count."""
    bare = F.regexp_replace(text, r'"[^"\\]*(?:\\.[^"\\]*)*"', '""')  # strings may hold digits and brackets
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + piece.startswith("[").cast("int") - piece.startswith("]").cast("int")
        kept = F.when(depth == 0, F.regexp_replace(piece, r"^[\[\]]", "")).otherwise("")
        return F.struct(depth.alias("depth"), F.concat(state["out"], kept).alias("out"))

    outside = F.aggregate(F.split(bare, r"(?=[\[\]])"), start, step)["out"]
    inner = F.nullif(F.regexp_extract(outside, _NUMBER, 0), F.lit(""))
    return F.when(text.startswith("{"), inner.try_cast("double")).when(text.rlike(f"^{_NUMBER}$"), text.try_cast("double"))


def _first_of(text: Column, skip: list[str]) -> Column:
    """First number among the members of a JSON object text but those to skip, in document order."""
    kinds = F.from_json(text, "map<string,variant>")  # tells "7" from 7, which the text map cannot
    entries = F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: ~e["key"].isin(*skip))
    unquoted = F.filter(entries, lambda e: F.schema_of_variant(F.try_element_at(kinds, e["key"])) != "STRING")
    values = F.transform(unquoted, lambda e: first_number(e["value"]))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def bucketed_metrics(rows: DataFrame, metric: str, unit: str) -> DataFrame:
    """``rows``: incident_id, service, start_ms, doc = one time bucket with ``beginTimeSeconds`` and aggregates."""
    begin = F.get_json_object("doc", "$.beginTimeSeconds").try_cast("double")
    value = _first_of(F.col("doc"), ["beginTimeSeconds", "endTimeSeconds"])
    return rows.select(
        "incident_id", relative_floor_ms(begin.cast("long") * 1000, F.col("start_ms")).alias("time"), "service", F.lit(metric).alias("metric"),
        value.alias("value"), F.lit(unit).alias("unit"), begin.alias("_b")).where("_b IS NOT NULL AND value IS NOT NULL").drop("_b")


# ---- OTLP JSON ----------------------------------------------------------------------------

_VALUE = "struct<stringValue: string, intValue: string, boolValue: string>"


def _attribute(attrs: Column, key: str) -> Column:
    v = F.get(F.filter(attrs, lambda a: a["key"] == key), F.lit(0))["value"]
    return F.coalesce(_text(v["stringValue"]), _text(v["intValue"]), _text(v["boolValue"]))


def _hex_id(text: Column) -> Column:
    return F.coalesce(F.lower(F.hex(F.try_to_binary(text, F.lit("base64")))), text)


def otlp_traces(docs: DataFrame) -> DataFrame:
    """``docs``: incident_id, start_ms, doc = {"batches": [...]} with base64 ids and nanosecond times."""
    attrs = f"array<struct<key: string, value: {_VALUE}>>"
    schema = f"""struct<batches: array<struct<resource: struct<attributes: {attrs}>, scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string,
      parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: string>, attributes: {attrs}>>>>>>>"""
    batches = docs.select("incident_id", "start_ms", F.explode(F.from_json("doc", schema)["batches"]).alias("b"))
    scopes = batches.select("incident_id", "start_ms", F.coalesce(_attribute(F.col("b.resource.attributes"), "service.name"), F.lit("unknown")).alias("service"),
                            F.explode("b.scopeSpans").alias("c"))
    spans = scopes.select("incident_id", "start_ms", "service", F.explode("c.spans").alias("s"))
    begin = F.coalesce(F.col("s.startTimeUnixNano").try_cast("long"), F.lit(0))
    finish = F.coalesce(F.col("s.endTimeUnixNano").try_cast("long"), begin)
    return spans.select(
        "incident_id", _hex_id(F.coalesce("s.traceId", F.lit(""))).alias("trace_id"), _hex_id(F.coalesce("s.spanId", F.lit(""))).alias("span_id"),
        _hex_id(_text(F.col("s.parentSpanId"))).alias("parent_span_id"), relative_floor_ms(F.floor(begin / 1e6), F.col("start_ms")).alias("time"), "service",
        F.coalesce("s.name", F.lit("unknown")).alias("operation"), F.greatest(F.lit(0.0), (finish - begin) / 1e6).alias("duration_ms"),
        F.when(F.col("s.status.code").isin("2", "STATUS_CODE_ERROR"), "ERROR").otherwise("OK").alias("status"),
        F.lower(F.coalesce(_attribute(F.col("s.attributes"), "span.kind"), F.lit("internal"))).alias("span_kind"))


# ---- webhook batches ----------------------------------------------------------------------

def alertmanager_batches(batches: DataFrame, rules: DataFrame) -> DataFrame:
    """Firing alerts of webhook payloads. ``batches``: batch_id, doc. ``rules``: alertname, expr."""
    schema = """struct<alerts: array<struct<status: string, startsAt: string, labels: map<string,string>, annotations: map<string,string>>>>"""
    alerts = batches.select("batch_id", F.explode(F.from_json("doc", schema)["alerts"]).alias("a")).where(
        F.coalesce("a.status", F.lit("firing")) == "firing").withColumn("_start", iso_seconds(F.trim("a.startsAt")))
    earliest = alerts.groupBy("batch_id").agg(F.min("_start").alias("_first"))
    expr = rules.groupBy("alertname").agg(F.max("expr").alias("expr"))
    named = alerts.join(earliest, "batch_id").withColumn("alertname", F.coalesce(F.try_element_at("a.labels", F.lit("alertname")), F.lit("")))
    labels = F.map_filter("a.labels", lambda k, v: k.isin("tier", "signal"))
    value = F.coalesce(F.try_element_at("a.annotations", F.lit("value")).try_cast("double"), F.lit(0.0))
    return named.join(expr, "alertname", "left").select(
        "batch_id", "alertname", F.coalesce(F.try_element_at("a.labels", F.lit("severity")), F.lit("")).alias("severity"),
        relative_second(F.col("_start"), F.col("_first")).alias("starts_at_second"), labels.alias("labels"), F.col("a.annotations").alias("annotations"),
        value.alias("value"), F.coalesce("expr", F.concat(F.lit("live:"), "alertname")).alias("expr"),
        alert_fingerprint("alertname", labels).alias("fingerprint"))
