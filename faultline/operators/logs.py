"""Log search, templating and onset operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.expr import SEVERITY_RANKS, log_line, log_template, severity_rank, strip
from faultline.functions.ordered import top_per_group
from faultline.operators.spans import page

LOG_ORDER = ("time", "service", "severity", "message", "trace_id")


def log_order() -> Column:
    return F.struct("time", "service", "severity", "message", F.coalesce("trace_id", F.lit("")).alias("trace_id"))


def search_logs(
    logs: DataFrame, service: str | None = None, severity_min: str | None = None, contains: str | None = None,
    start: int | None = None, end: int | None = None,
) -> DataFrame:
    """Lines passing every filter; the text match ignores case, time ends are inclusive."""
    if service is not None:
        logs = logs.where(F.col("service") == service)
    if severity_min is not None:
        logs = logs.where(severity_rank() >= SEVERITY_RANKS.get(severity_min.lower(), 0))
    if contains is not None:
        logs = logs.where(F.lower("message").contains(contains.lower()))
    if start is not None:
        logs = logs.where(F.col("time") >= start)
    if end is not None:
        logs = logs.where(F.col("time") <= end)
    return logs


def _lines(df: DataFrame) -> DataFrame:
    return df.withColumn("message", log_line("message")).withColumn("severity", F.lower("severity"))


def find_logs(logs: DataFrame, limit: int = 30, **filters: object) -> DataFrame:
    order = [F.col("time"), F.col("service"), F.col("severity"), F.col("message"), F.coalesce("trace_id", F.lit(""))]
    return _lines(page(search_logs(logs, **filters), order, limit))


def logs_of_traces(logs: DataFrame, traces: DataFrame, severity_min: str | None = None) -> DataFrame:
    wanted = traces.select("incident_id", "trace_id").distinct()
    return search_logs(logs, severity_min=severity_min).join(wanted, ["incident_id", "trace_id"], "left_semi")


def trace_log_lines(logs: DataFrame, traces: DataFrame, severity_min: str | None = None) -> DataFrame:
    return _lines(logs_of_traces(logs, traces, severity_min))


def error_clusters(logs: DataFrame, limit: int = 10, service: str | None = None, start: int | None = None) -> DataFrame:
    """Error lines grouped by template, most frequent first, then first seen."""
    errors = search_logs(logs, service=service, severity_min="error", start=start)
    groups = errors.groupBy("incident_id", log_template("message").alias("template")).agg(
        F.count(F.lit(1)).alias("count"), F.min_by(F.substring(strip("message"), 1, 300), log_order()).alias("example"),
        F.sort_array(F.collect_set("service")).alias("services"), F.min(log_order()).alias("_first"))
    return top_per_group(groups, ["incident_id"], [F.col("count").desc(), F.col("_first")], limit, "position").drop("_first")


def level_counts(logs: DataFrame, bucket: int = 60, service: str | None = None) -> DataFrame:
    start = (F.floor(F.col("time") / bucket) * bucket).alias("start")
    return search_logs(logs, service=service).groupBy("incident_id", start, F.lower("severity").alias("level")).agg(
        F.count(F.lit(1)).alias("count"))


def level_histogram(logs: DataFrame, bucket: int = 60, service: str | None = None) -> DataFrame:
    """One row per bucket with a map of level to count."""
    return level_counts(logs, bucket, service).groupBy("incident_id", "start").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "count")))).alias("counts"))


def first_errors(logs: DataFrame, severity_min: str = "error") -> DataFrame:
    """Earliest line at or above a severity, per service."""
    rows = search_logs(logs, severity_min=severity_min)
    first = rows.groupBy("incident_id", "service").agg(
        F.min_by(F.struct("time", "severity", "message"), log_order()).alias("f"))
    return first.select("incident_id", "service", "f.time", F.lower("f.severity").alias("severity"),
                        F.substring(strip("f.message"), 1, 200).alias("message"))
