"""Benchmark case ingest: names, truth, wide metrics, aliased logs and traces, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: fault code to wording, category and indicator metric
FAULT_TYPE = {
    "cpu": "cpu exhaustion", "mem": "memory leak", "disk": "disk stress", "socket": "socket stress", "delay": "network delay",
    "loss": "packet loss", "f1": "code fault incorrect parameter", "f2": "code fault missing parameter", "f3": "code fault missing call",
    "f4": "code fault incorrect return", "f5": "code fault missing exception handler",
}
FAULT_CATEGORY = {
    "cpu": "resource", "mem": "resource", "disk": "resource", "socket": "resource", "delay": "network", "loss": "network",
    "f1": "code", "f2": "code", "f3": "code", "f4": "code", "f5": "code",
}
FAULT_INDICATOR = {"cpu": "cpu_utilization", "mem": "memory_mb", "delay": "latency_p95_ms", "loss": "request_error_rate"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def parse_cases(cases: DataFrame, column: str = "case_id") -> DataFrame:
    """Split ``{system}_{service}_{fault}_{instance}``; the service may hold underscores.

    Names with fewer than four parts get ``case_error`` instead of parts.
    """
    parts = F.split(column, "_")
    n = F.size(parts)
    good = n >= 4
    fault = F.try_element_at(parts, F.lit(-2))
    return cases.select(
        "*", F.when(good, F.get(parts, F.lit(0))).alias("system"),
        F.when(good, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 3, F.lit(0))), "_")).alias("service"),
        F.when(good, fault).alias("fault"), F.when(good, F.try_element_at(parts, F.lit(-1))).alias("instance"),
        F.when(good, F.coalesce(lookup(FAULT_CATEGORY, fault), F.lit("unknown"))).alias("category"),
        F.when(~good, F.lit("unexpected case name")).alias("case_error"))


def build_truth(parsed: DataFrame) -> DataFrame:
    """Truth row of each well-formed case, from its name alone."""
    fault = F.col("fault")
    return parsed.where("case_error IS NULL").select(
        F.col("case_id").alias("scenario_id"), F.lit("service").alias("kind"), F.coalesce(lookup(FAULT_TYPE, fault), fault).alias("type"),
        "service", F.array("service").alias("accepted_services"), lookup(FAULT_INDICATOR, fault).alias("root_cause_indicator"),
        F.col("category").alias("fault_category"))


# ---- windows ------------------------------------------------------------------------------

def make_windows(cases: DataFrame, pre: int = 180, post: int = 300) -> DataFrame:
    """Inclusive windows around the injection. ``cases``: incident_id, inject_time."""
    return cases.select(
        "incident_id", (F.col("inject_time") - pre).alias("start_abs"), (F.col("inject_time") + post).alias("end_abs"), F.lit(pre).alias("onset_second"))


def cut_and_rebase(rows: DataFrame, windows: DataFrame, time: str = "time_abs") -> DataFrame:
    """Rows inside their incident's window, with time relative to its start."""
    joined = rows.join(windows.select("incident_id", "start_abs", "end_abs"), "incident_id")
    kept = joined.where(F.col(time).between(F.col("start_abs"), F.col("end_abs")))
    return kept.withColumn("time", F.col(time) - F.col("start_abs")).drop("start_abs", "end_abs", time)


def whole_number(text: Column, per: float = 1.0) -> Column:
    """A numeric text as a whole number, truncated toward zero; null when it is not a number."""
    return (text.try_cast("double") / per).try_cast("long")


# ---- wide metrics -------------------------------------------------------------------------

# fixed values: column suffix pattern, canonical metric and unit, most specific first
SUFFIXES = [
    (r"(?i)^(.+?)_(error[_-]?rate|errors?|error[_-]?ratio)$", "request_error_rate", "ratio"),
    (r"(?i)^(.+?)_(latency|duration|lat|resp(?:onse)?[_-]?time)(?:_p?\d+)?$", "latency_p95_ms", "ms"),
    (r"(?i)^(.+?)_(cpu)(?:_\w+)?$", "cpu_utilization", "ratio"),
    (r"(?i)^(.+?)_(mem|memory)(?:_\w+)?$", "memory_mb", "MB"),
]
# fixed values: base name to canonical metric, unit and scale
BASES = {
    "cpu": ("cpu_utilization", "ratio", 1.0), "mem": ("memory_mb", "MB", 1.0), "memory": ("memory_mb", "MB", 1.0),
    "error": ("request_error_rate", "ratio", 1.0), "errors": ("request_error_rate", "ratio", 1.0),
    "latency-90": ("latency_p95_ms", "ms", 1000.0), "latency-50": ("latency_p50_ms", "ms", 1000.0),
}


def canonical_column(column: Column) -> Column:
    """Struct (service, metric, unit) of a wide column name."""
    def entry(service: Column, metric: Column, unit: str) -> Column:
        return F.struct(service.alias("service"), metric.alias("metric"), F.lit(unit).alias("unit"))

    last = F.regexp_extract(column, r"^(.*)_([^_]*)$", 2)
    out = F.when(column.contains("_"), entry(F.regexp_extract(column, r"^(.*)_([^_]*)$", 1), last, "count")).otherwise(
        entry(column, F.lit("value"), "count"))
    for pattern, metric, unit in reversed(SUFFIXES):
        out = F.when(column.rlike(pattern), entry(F.regexp_extract(column, pattern, 1), F.lit(metric), unit)).otherwise(out)
    return out


def canonical_base(column: Column) -> Column:
    """Struct (service, metric, unit, scale) of a ``<service>_<base>`` name; null without an underscore."""
    service, base = (F.regexp_extract(column, r"^(.*)_([^_]*)$", i) for i in (1, 2))
    table = F.create_map(*[x for k, (m, u, s) in BASES.items() for x in (
        F.lit(k), F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.lit(s).alias("scale")))])
    known = F.try_element_at(table, F.lower(base))
    return F.when(column.contains("_"), F.struct(
        service.alias("service"), F.coalesce(known["metric"], base).alias("metric"), F.coalesce(known["unit"], F.lit("count")).alias("unit"),
        F.coalesce(known["scale"], F.lit(1.0)).alias("scale")))


def melt(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide numeric columns to (keys, column, value text)."""
    columns = [c for c in wide.columns if c not in keys]
    texts = wide.select(*keys, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return texts.unpivot(keys, columns, "column", "value")


def wide_metrics(wide: DataFrame, windows: DataFrame, trace_services: DataFrame | None = None, time: str = "time") -> DataFrame:
    """Wide frame with incident_id, a time column and one column per service metric.

    With ``trace_services`` the ``<service>_<base>`` naming of CSV exports is used:
    seconds become milliseconds and names are matched to those seen in spans.
    """
    long = melt(wide.withColumnRenamed(time, "time_abs"), ["incident_id", "time_abs"]).withColumn("time_abs", whole_number(F.col("time_abs").cast("string")))
    csv = trace_services is not None
    long = long.withColumn("c", canonical_base(F.col("column")) if csv else canonical_column(F.col("column"))).where("c IS NOT NULL")
    value = F.trim("value").try_cast("double")
    scaled = value * F.col("c.scale") if csv else value
    rows = long.where("value IS NOT NULL").where(~F.lower(F.trim("value")).isin("", "nan", "null")).select(
        "incident_id", "time_abs", F.col("c.service").alias("service"), F.col("c.metric").alias("metric"), scaled.alias("value"), F.col("c.unit").alias("unit"))
    rows = cut_and_rebase(rows.where("value IS NOT NULL AND time_abs IS NOT NULL"), windows)
    return reconcile_services(rows, trace_services) if csv else rows


def read_metric_json(lines: DataFrame) -> DataFrame:
    """Both JSON shapes to (incident_id, time_abs, column, value): one object of arrays, or a list of objects.

    ``lines``: incident_id, doc. The list form is exploded row by row.
    """
    is_list = F.ltrim("doc").startswith("[")
    table = F.from_json("doc", "map<string, array<double>>")
    objects = lines.where(~is_list).select("incident_id", table.alias("m"))
    columns = objects.select("incident_id", F.try_element_at("m", F.lit("time")).alias("t"), F.explode("m").alias("column", "v")).where("column <> 'time'")
    first = columns.select("incident_id", "column", F.explode(F.arrays_zip(F.col("t"), F.col("v"))).alias("p")).select(
        "incident_id", F.col("p.t").cast("long").alias("time_abs"), "column", F.col("p.v").alias("value"))
    rows = lines.where(is_list).select("incident_id", F.explode(F.from_json("doc", "array<map<string,double>>")).alias("m"))
    second = rows.select("incident_id", F.try_element_at("m", F.lit("time")).cast("long").alias("time_abs"), F.explode("m").alias("column", "value")).where("column <> 'time'")
    return first.unionByName(second)


def json_metrics(lines: DataFrame, windows: DataFrame) -> DataFrame:
    long = read_metric_json(lines).withColumn("c", canonical_column(F.col("column")))
    return cut_and_rebase(long.select("incident_id", "time_abs", "c.*", "value"), windows)


def reconcile_services(rows: DataFrame, trace_services: DataFrame) -> DataFrame:
    """Names seen in spans stay; else ``<name>service`` if spans have it; else unchanged."""
    known = trace_services.select("incident_id", "service").distinct()
    exact = known.withColumn("_exact", F.lit(True))
    longer = known.select("incident_id", F.col("service").alias("_long")).withColumn("_hit", F.lit(True))
    joined = rows.join(exact, ["incident_id", "service"], "left").withColumn("_long", F.concat("service", F.lit("service"))).join(
        longer, ["incident_id", "_long"], "left")
    name = F.when(F.col("_exact").isNotNull(), F.col("service")).when(F.col("_hit").isNotNull(), F.col("_long")).otherwise(F.col("service"))
    return joined.withColumn("service", name).select(*rows.columns)


# ---- logs and traces ----------------------------------------------------------------------

def pick(df: DataFrame, *aliases: str, default: str | None = None) -> Column:
    """First non-empty of the aliased columns that exist."""
    have = [F.nullif(F.col(f"`{a}`").cast("string"), F.lit("")) for a in aliases if a in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default).cast("string")


def aliased_logs(rows: DataFrame, windows: DataFrame) -> DataFrame:
    mapped = rows.select(
        "incident_id", whole_number(pick(rows, "timestamp", "time")).alias("time_abs"), pick(rows, "service", "pod", "container", default="unknown").alias("service"),
        pick(rows, "level", "severity", default="info").alias("severity"), pick(rows, "message", "log", "body", default="(no message)").alias("message"),
        pick(rows, "trace_id", "traceId").alias("trace_id"))
    return cut_and_rebase(mapped.where("time_abs IS NOT NULL"), windows)


def nanosecond_logs(rows: DataFrame, windows: DataFrame) -> DataFrame:
    mapped = rows.select(
        "incident_id", whole_number(F.trim(pick(rows, "timestamp", "time")), 1e9).alias("time_abs"), pick(rows, "container_name", default="unknown").alias("service"),
        pick(rows, "level", default="info").alias("severity"), pick(rows, "message", default="(no message)").alias("message"), pick(rows, "trace_id").alias("trace_id"))
    return cut_and_rebase(mapped.where("time_abs IS NOT NULL"), windows)


def aliased_traces(rows: DataFrame, windows: DataFrame) -> DataFrame:
    mapped = rows.select(
        "incident_id", whole_number(pick(rows, "start_time", "timestamp", "startTime")).alias("time_abs"), pick(rows, "trace_id", "traceId").alias("trace_id"),
        pick(rows, "span_id", "spanId").alias("span_id"), pick(rows, "parent_id", "parentSpanId", "parent_span_id").alias("parent_span_id"),
        pick(rows, "service", "serviceName", default="unknown").alias("service"), pick(rows, "operation", "operationName", "name", default="unknown").alias("operation"),
        F.coalesce(pick(rows, "duration_ms", "duration", "durationMs").try_cast("double"), F.lit(0.0)).alias("duration_ms"),
        pick(rows, "status", "status_code", "statusCode", default="UNSET").alias("status"))
    return cut_and_rebase(mapped.where("time_abs IS NOT NULL AND trace_id IS NOT NULL AND span_id IS NOT NULL"), windows)


def infer_span_kinds(spans: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Add ``span_kind``: the caller side of a cross-service link is client, the callee side server.

    Reads every span, windowed or not. Rows that repeat an id are one span: its service is
    the last one by ``order``, then by name, its parent the last that is given. Rows of a frame
    have no place of their own, so give a column that tells it where there is one. Both
    roles are reduced to distinct ids before the joins, so a parent of very many spans
    does not skew them.
    """
    last = F.struct(*order, "service")
    whole = spans.groupBy("incident_id", "span_id").agg(
        F.max_by("service", last).alias("service"), F.max_by("parent_span_id", F.when(F.col("parent_span_id").isNotNull(), last)).alias("parent_span_id"))
    parents = whole.select("incident_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("_ps"))
    links = whole.where("parent_span_id IS NOT NULL").join(parents, ["incident_id", "parent_span_id"]).where(F.col("_ps") != F.col("service"))
    clients = links.select("incident_id", F.col("parent_span_id").alias("span_id"), F.lit(True).alias("_client")).distinct()
    servers = links.select("incident_id", "span_id", F.lit(True).alias("_server")).distinct()
    kind = F.when(F.col("_client"), "client").when(F.col("_server"), "server").otherwise("internal")
    return spans.join(clients, ["incident_id", "span_id"], "left").join(servers, ["incident_id", "span_id"], "left").withColumn(
        "span_kind", kind).drop("_client", "_server")


def microsecond_traces(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Traces with millisecond starts, microsecond durations and numeric status; kinds are inferred.

    Rows read from case folders carry their place in the file, which tells the last of a repeated id; others go by time.
    """
    placed = ["_place"] if "_place" in rows.columns else []
    status = F.trim(pick(rows, "statusCode")).try_cast("double")
    micros = F.coalesce(F.trim(pick(rows, "duration")).try_cast("double"), F.lit(0.0))
    mapped = rows.select(
        "incident_id", *placed, whole_number(F.trim(pick(rows, "startTimeMillis")), 1000.0).alias("time_abs"), F.nullif(F.trim(pick(rows, "traceID", "traceId")), F.lit("")).alias("trace_id"),
        F.nullif(F.trim(pick(rows, "spanID", "spanId")), F.lit("")).alias("span_id"), F.nullif(F.trim(pick(rows, "parentSpanID")), F.lit("")).alias("parent_span_id"),
        pick(rows, "serviceName", default="unknown").alias("service"), pick(rows, "operationName", default="unknown").alias("operation"),
        F.greatest(F.lit(0.0), micros / 1000).alias("duration_ms"), F.when(F.coalesce(status, F.lit(0.0)) != 0, "ERROR").otherwise("OK").alias("status"))
    kinds = infer_span_kinds(mapped.where("span_id IS NOT NULL"), placed or ["time_abs"]).drop("_place")
    return cut_and_rebase(kinds.where("time_abs IS NOT NULL AND trace_id IS NOT NULL"), windows)


# ---- symptom ------------------------------------------------------------------------------

def synthesise_symptoms(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Symptom and alert from the largest rise: error rate, else p95, else any metric by relative rise."""
    from faultline.functions.expr import alert_fingerprint
    from faultline.operators.metrics import SERIES, mean_or_zero
    from faultline.operators.spans import with_onset

    after = F.col("time") >= F.col("onset_second")
    means = with_onset(metrics, incidents).groupBy(*SERIES, "onset_second").agg(mean_or_zero(~after).alias("pre"), mean_or_zero(after).alias("post"))
    rose = means.where(F.col("post") > F.col("pre")).withColumn("rise", F.col("post") - F.col("pre"))

    # Best service per metric, then the best metric; each is a mergeable aggregate with name ties.
    first = F.struct((-F.round("rise", 9)).alias("r"), "service")
    per = rose.groupBy("incident_id", "onset_second", "metric").agg(F.min_by(F.struct("service", "pre", "post"), first).alias("b"))
    relative = F.when(F.col("b.pre") > 0, (F.col("b.post") - F.col("b.pre")) / F.col("b.pre")).otherwise(F.lit(float("inf")))
    place = F.when(F.col("metric") == "request_error_rate", 0).when(F.col("metric") == "latency_p95_ms", 1).otherwise(2)
    best = per.groupBy("incident_id", "onset_second").agg(
        F.min_by(F.struct("metric", "b"), F.struct(place.alias("p"), (-relative).alias("r"), "metric")).alias("x"))
    picked = best.select("incident_id", "onset_second", "x.metric", F.col("x.b.service").alias("service"), F.col("x.b.post").alias("value"))
    kind = F.col("metric")
    error, latency = kind == "request_error_rate", kind == "latency_p95_ms"
    # fixed values: the wording and names of the synthesised alert
    lead = F.when(error, "Elevated error rate on ").when(latency, "Elevated p95 latency on ").otherwise("Anomalous metric shift on ")
    name = F.when(error, "HighErrorRate").when(latency, "HighLatency").otherwise("MetricAnomaly")
    labels = F.create_map(F.lit("service"), F.col("service"))
    return picked.select(
        "incident_id", F.concat(lead, "service", F.lit(" beginning around second "), F.col("onset_second").cast("string"), F.lit(".")).alias("symptom"),
        name.alias("alertname"), F.when(error, "critical").otherwise("warning").alias("severity"), F.col("onset_second").alias("starts_at_second"),
        labels.alias("labels"), "value",
        F.when(error, "request_error_rate > 0.05").when(latency, "latency_p95_ms > 250").otherwise(F.concat("metric", F.lit(" shifted after onset"))).alias("expr"),
        alert_fingerprint(name, labels, "sha1").alias("fingerprint"))
