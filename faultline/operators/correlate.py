"""Correlation of spans, logs, metrics and changes around the onset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.expr import is_error
from faultline.functions.ordered import top_per_group
from faultline.operators.logs import search_logs
from faultline.operators.metrics import RED_METRICS, SERIES, mean_or_zero, significant_rise
from faultline.operators.spans import span_order, with_onset


def attribute_fault(observations: DataFrame) -> DataFrame:
    """Service fault if any server spans fail, else the loudest client edge, else unknown.

    ``observations``: incident_id, service, role, callee, error_count, first_seen.
    Each side is one mergeable aggregate; equal counts go to the first seen.
    """
    counted = observations.where(F.col("error_count") > 0)
    rank = F.struct((-F.col("error_count")).alias("n"), "first_seen")
    best = counted.groupBy("incident_id").agg(
        F.min_by(F.struct("service", "error_count"), F.when(F.col("role") == "server", rank)).alias("s"),
        F.min_by(F.struct("service", "callee", "error_count"), F.when(F.col("role") == "client", rank)).alias("c"))
    server, client = F.col("s").isNotNull(), F.col("c").isNotNull()
    out = observations.select("incident_id").distinct().join(best, "incident_id", "left")
    rationale = (
        F.when(server, F.concat("s.service", F.lit(" server spans error ("), F.col("s.error_count").cast("string"),
                                F.lit("): the service's own work failed")))
        .when(client, F.concat("c.service", F.lit(" client spans to "), F.coalesce("c.callee", F.lit("unknown")),
                               F.lit(" error ("), F.col("c.error_count").cast("string"), F.lit("): an edge fault")))
        .otherwise(F.lit("no erroring observations to attribute")))
    return out.select(
        "incident_id", F.when(server, "service").when(client, "edge").otherwise("unknown").alias("kind"),
        F.col("s.service").alias("service"), F.when(~server, F.col("c.service")).alias("caller"),
        F.when(~server, F.col("c.callee")).alias("callee"),
        F.when(server, 0.9).when(client, 0.8).otherwise(0.0).alias("confidence"), rationale.alias("rationale"))


def timeline(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Changes and the onset marker in order; a change precedes the onset on equal seconds."""
    timed = with_onset(changes, incidents)
    entries = timed.select(
        "incident_id", F.col("time").alias("second"), F.lit("change").alias("kind"),
        F.concat("id", F.lit(" on "), "service", F.lit(": "), "summary").alias("detail"),
        F.col("id").alias("change_id"), (F.col("time") < F.col("onset_second")).alias("before_onset"), F.lit(0).alias("tie"))
    marker = incidents.select(
        "incident_id", F.col("onset_second").alias("second"), F.lit("onset").alias("kind"),
        F.lit("first error span").alias("detail"), F.lit(None).cast("string").alias("change_id"),
        F.lit(False).alias("before_onset"), F.lit(1).alias("tie"))
    return entries.unionByName(marker)


def align_signals(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Pre and post means of every series with a flag for a significant rise."""
    timed = with_onset(metrics, incidents)
    after = F.col("time") >= F.col("onset_second")
    means = timed.groupBy(*SERIES).agg(mean_or_zero(~after).alias("pre_mean"), mean_or_zero(after).alias("post_mean"))
    place = F.when(F.col("metric") == RED_METRICS[0], 0).when(F.col("metric") == RED_METRICS[1], 1).otherwise(2)
    return means.select("*", significant_rise("metric", F.col("pre_mean"), F.col("post_mean")).alias("shifted"),
                        place.alias("signal_order"))


def exemplar_traces(spans: DataFrame, incidents: DataFrame, status: str = "ERROR", limit: int = 5) -> DataFrame:
    """First span of each of the first ``limit`` distinct traces per service after onset."""
    picked = with_onset(spans, incidents).where(
        (F.upper("status") == status.upper()) & (F.col("time") >= F.col("onset_second")))
    first = picked.groupBy("incident_id", "service", "trace_id").agg(
        F.min(span_order()).alias("_o"), F.min_by(F.struct("span_id", "operation", "duration_ms"), span_order()).alias("s"))
    top = top_per_group(first, ["incident_id", "service"], [F.col("_o")], limit, "position")
    return top.select("incident_id", "service", "position", "trace_id", "s.span_id", "s.operation", "s.duration_ms",
                      F.col("_o.time").alias("time"))


def onset_consensus(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Onset agreed by the first error span and the first error log."""
    traces = spans.where(is_error()).groupBy("incident_id").agg(F.min("time").alias("trace_onset_second"))
    lines = search_logs(logs, severity_min="error").groupBy("incident_id").agg(F.min("time").alias("first_error_log_second"))
    both = traces.join(lines, "incident_id", "full_outer")
    a, b = F.col("trace_onset_second"), F.col("first_error_log_second")
    agree = F.coalesce(F.abs(a - b) <= 60, F.lit(False))
    # fixed values: the wording of the notes
    return both.select(
        "incident_id", a, b, F.when(agree, F.least(a, b)).otherwise(F.coalesce(a, b)).alias("consensus_onset_second"),
        agree.alias("agreement"),
        F.when(agree, F.lit(None)).when(a.isNotNull(), "onsets differ by more than a minute; using the trace onset")
        .otherwise("no error spans; falling back to the log onset").alias("note"))
