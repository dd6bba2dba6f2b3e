"""Change event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.ordered import latest_before
from faultline.operators.spans import with_onset


def search_changes(
    changes: DataFrame, service: str | None = None, start: int | None = None, end: int | None = None
) -> DataFrame:
    if service is not None:
        changes = changes.where(F.col("service") == service)
    if start is not None:
        changes = changes.where(F.col("time") >= start)
    if end is not None:
        changes = changes.where(F.col("time") <= end)
    return changes


def lookback(
    changes: DataFrame, incidents: DataFrame, lookback_seconds: int | None = None, service: str | None = None
) -> DataFrame:
    """Changes strictly before onset with their distance to it; sort by gap, then id."""
    timed = with_onset(search_changes(changes, service=service), incidents)
    picked = timed.where(F.col("time") < F.col("onset_second"))
    if lookback_seconds is not None:
        picked = picked.where(F.col("time") >= F.col("onset_second") - lookback_seconds)
    return picked.withColumn("gap_seconds", F.col("onset_second") - F.col("time"))


def rank_culprits(changes: DataFrame, incidents: DataFrame, suspects: DataFrame) -> DataFrame:
    """Score of every change before onset: on the suspected service first, then nearness.

    ``suspects``: incident_id, suspected_service.
    """
    before = lookback(changes, incidents)
    widest = before.groupBy("incident_id").agg(F.max("gap_seconds").alias("_span"))
    joined = before.join(widest, "incident_id").join(suspects, "incident_id", "left")
    match = F.coalesce(F.col("service") == F.col("suspected_service"), F.lit(False))
    span = F.when(F.col("_span") == 0, F.lit(1)).otherwise(F.col("_span"))
    score = F.when(match, 10.0).otherwise(1.0) + (1.0 - F.col("gap_seconds") / span)
    reason = F.concat(
        F.when(match, F.concat(F.lit("on suspected service "), "service", F.lit("; "))).otherwise(F.lit("")),
        F.col("gap_seconds").cast("string"), F.lit("s before onset"))
    return joined.select("incident_id", F.col("id").alias("change_id"), "service", "time",
                         F.round(score, 3).alias("score"), reason.alias("reason"))


def nearest_before(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """The latest change strictly before each probe, ties to the smaller id.

    ``probes``: incident_id, service, onset_second and anything to carry along.
    """
    found = latest_before(probes, changes, ["incident_id", "service"], "onset_second", "time", ["id", "time"], strict=True, tie="id")
    return found.select(*probes.columns, F.col("found.id").alias("change_id"), F.col("found.time").alias("change_time"))
