"""Canonical tables as OTLP-JSON payload rows, for a file sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.ordered import ordered_index

# fixed values: span kind codes
KIND_CODES = {"internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}


def nanoseconds(base_ms: Column, second: Column) -> Column:
    return ((base_ms + second * 1000) * 1000000).cast("string")


def _resource(service: Column) -> Column:
    value = F.struct(service.alias("stringValue"))
    return F.struct(F.array(F.struct(F.lit("service.name").alias("key"), value.alias("value"))).alias("attributes"))


def span_records(spans: DataFrame, base_ms: int) -> DataFrame:
    start = (F.lit(base_ms) + F.col("time") * 1000) * 1000000
    codes = F.create_map(*[F.lit(x) for pair in KIND_CODES.items() for x in pair])
    kind = F.coalesce(F.col("span_kind"), F.lit("internal"))
    record = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("operation").alias("name"),
        F.coalesce(F.try_element_at(codes, kind), F.lit(0)).alias("kind"), start.cast("string").alias("startTimeUnixNano"),
        (start + (F.col("duration_ms") * 1000000).cast("long")).cast("string").alias("endTimeUnixNano"),
        F.struct(F.when(F.col("status") == "ERROR", 2).otherwise(0).alias("code")).alias("status"),
        F.array(F.struct(F.lit("span.kind").alias("key"), F.struct(kind.alias("stringValue")).alias("value"))).alias("attributes"))
    return spans.select("incident_id", "service", "time", record.alias("record"))


def metric_records(metrics: DataFrame, base_ms: int) -> DataFrame:
    point = F.struct(F.col("value").alias("asDouble"), nanoseconds(F.lit(base_ms), F.col("time")).alias("timeUnixNano"))
    return metrics.select("incident_id", "service", "metric", "time", point.alias("record"))


def log_records(logs: DataFrame, base_ms: int) -> DataFrame:
    trace = F.struct(F.lit("trace_id").alias("key"), F.struct(F.col("trace_id").alias("stringValue")).alias("value"))
    record = F.struct(
        nanoseconds(F.lit(base_ms), F.col("time")).alias("timeUnixNano"), F.coalesce("severity", F.lit("INFO")).alias("severityText"),
        F.struct(F.coalesce("message", F.lit("")).alias("stringValue")).alias("body"), F.when(F.col("trace_id").isNotNull(), F.array(trace)).alias("attributes"))
    return logs.select("incident_id", "service", "time", record.alias("record"))


def payloads(records: DataFrame, signal: str, batch: int = 2000) -> DataFrame:
    """Payload documents (incident_id, service, batch, doc) of at most ``batch`` records in time order.

    Batches are numbered from counts per range part, so a busy service yields more
    documents, never a larger one.
    """
    keys = ["incident_id", "service", *(["metric"] if signal == "metrics" else [])]
    placed = ordered_index(records.withColumn("j", F.to_json("record")), keys, ["time", "j"])
    packed = placed.groupBy(*keys, F.floor(F.col("idx") / batch).alias("batch")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "record"))), lambda s: s["record"]).alias("r"))
    resource = _resource(F.col("service"))
    if signal == "traces":
        body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col("r").alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    elif signal == "logs":
        body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col("r").alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    else:
        gauge = F.struct(F.col("metric").alias("name"), F.struct(F.col("r").alias("dataPoints")).alias("gauge"))
        body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(gauge).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return packed.select(*keys, "batch", F.size("r").alias("records"), F.to_json(body).alias("doc"))
