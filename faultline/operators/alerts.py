"""Alert evaluation, allow-list checks and coverage invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.expr import alert_fingerprint
from faultline.functions.ordered import running_sums, top_per_group

# fixed values: alert names, label keys, label values and annotation text that name only symptoms
ALLOWED_NAMES = [
    "UserFacingDegradation", "CheckoutFailureRate", "FrontendHighErrorRate", "FrontendHighLatency", "CheckoutHighLatency",
]
ALLOWED_LABEL_KEYS = ["tier", "signal", "severity"]
ALLOWED_LABEL_VALUES = {
    "tier": ["user_facing"],
    "signal": ["degradation", "error_rate", "checkout_error_rate", "latency_p95", "checkout_latency_p95"],
}
FORBIDDEN_ANNOTATION_TEXT = ["labels.", "$labels", "{{labels", "service"]


def breaches(value: Column, comparison: Column, threshold: Column) -> Column:
    return (
        F.when(comparison == ">", value > threshold).when(comparison == ">=", value >= threshold)
        .when(comparison == "<", value < threshold).when(comparison == "<=", value <= threshold))


def sustained_breaches(series: DataFrame, rules: DataFrame) -> DataFrame:
    """First run of breaching samples that lasts ``for_seconds``, per incident and rule.

    ``series``: incident_id, metric, time, value (several services allowed: the
    largest value per second counts). ``rules``: rule_id, metric, threshold,
    comparison, for_seconds, and whatever the alert should carry. A missing,
    infinite or non-breaching sample ends a run; runs are numbered by a running
    sum of those ends, taken part by part.
    """
    top = series.groupBy("incident_id", "metric", "time").agg(F.max("value").alias("value"))
    judged = top.join(rules.select("rule_id", "metric", "threshold", "comparison", "for_seconds"), "metric")
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    hit = F.coalesce(finite & breaches(F.col("value"), F.col("comparison"), F.col("threshold")), F.lit(False))
    points = judged.select("incident_id", "rule_id", "for_seconds", "time", "value", hit.alias("hit"))
    runs = running_sums(points, ["incident_id", "rule_id"], ["time"], {"run": (~F.col("hit")).cast("int")})
    spans = runs.where("hit").groupBy("incident_id", "rule_id", "run", "for_seconds").agg(
        F.min("time").alias("start"), F.max("time").alias("stop"), F.min_by("value", "time").alias("value"))
    return spans.where(F.col("stop") - F.col("start") >= F.col("for_seconds")).groupBy("incident_id", "rule_id").agg(
        F.min("start").alias("starts_at_second"), F.min_by("value", "start").alias("value"))


def render_annotations(templates: Column, value: Column, starts_at: Column) -> Column:
    return F.transform_values(templates, lambda _, text: F.replace(
        F.replace(text, F.lit("{{value}}"), value.cast("string")), F.lit("{{starts_at}}"), starts_at.cast("string")))


def derive_alerts(series: DataFrame, rules: DataFrame, incidents: DataFrame) -> DataFrame:
    """One alert per fingerprint, the most severe and earliest; incidents that fire none get a violation."""
    fired = sustained_breaches(series, rules).join(rules, "rule_id")
    alerts = fired.select(
        "incident_id", "alertname", "severity", F.greatest(F.lit(0), F.col("starts_at_second")).alias("starts_at_second"),
        "value", "expr", "labels", render_annotations(F.col("annotation_templates"), F.col("value"), F.col("starts_at_second")).alias("annotations"),
        alert_fingerprint("alertname", "labels").alias("fingerprint"))
    order = [F.when(F.col("severity") == "critical", 0).otherwise(1), F.col("starts_at_second"), F.col("alertname"), F.col("expr")]
    kept = top_per_group(alerts, ["incident_id", "fingerprint"], order, 1)
    # fixed value: the wording of the violation
    quiet = incidents.select("incident_id").join(kept, "incident_id", "left_anti").withColumn(
        "violation", F.lit("no symptom rule fired over the recorded window"))
    return kept.withColumn("violation", F.lit(None).cast("string")).unionByName(quiet, allowMissingColumns=True)


def symptom_violations(alerts: DataFrame) -> DataFrame:
    """Rows (incident_id, alertname, violation) for alerts that name more than a symptom."""
    def words(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    name = F.when(~F.col("alertname").isin(*ALLOWED_NAMES), F.lit("alertname is not in the allow-list"))
    keys = F.transform(F.array_sort(F.array_except(F.map_keys("labels"), words(ALLOWED_LABEL_KEYS))),
                       lambda k: F.concat(F.lit("label key "), k, F.lit(" is not allowed")))
    values = []
    for key, allowed in ALLOWED_LABEL_VALUES.items():
        value = F.try_element_at("labels", F.lit(key))
        values.append(F.when(value.isNotNull() & ~value.isin(*allowed), F.lit(f"label {key} has a value outside the allowed set")))
    bad_text = F.exists(F.map_values("annotations"), lambda text: F.exists(words(FORBIDDEN_ANNOTATION_TEXT), lambda w: text.contains(w)))
    text = F.when(bad_text, F.lit("annotation contains forbidden text"))
    found = F.concat(F.array(name), keys, F.array(*values, text))
    return alerts.select("incident_id", "alertname", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("violation"))


def coverage_matrix(scenarios: DataFrame, alerts: DataFrame) -> DataFrame:
    """Sorted alert names per scenario; a scenario without alerts has an empty list."""
    names = alerts.groupBy("scenario_id").agg(F.sort_array(F.collect_list("alertname")).alias("alertnames"))
    return scenarios.select("scenario_id").join(names, "scenario_id", "left").withColumn(
        "alertnames", F.coalesce("alertnames", F.array().cast("array<string>")))


def coverage_violations(matrix: DataFrame) -> DataFrame:
    """E1 silent scenarios, E2 alert names of one scenario, E3 firing sets of one scenario."""
    silent = matrix.where(F.size("alertnames") == 0).select(
        F.lit("E1").alias("invariant"), F.lit("").alias("subject"), "scenario_id")
    named = matrix.select("scenario_id", F.explode(F.array_distinct("alertnames")).alias("subject"))
    lonely = named.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("scenario_id").alias("scenario_id")).where("n = 1")
    sets = matrix.groupBy(F.array_join(F.array_distinct("alertnames"), ",").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), F.min("scenario_id").alias("scenario_id")).where("n = 1")
    cols = ["invariant", "subject", "scenario_id"]
    return (
        silent.unionByName(lonely.withColumn("invariant", F.lit("E2")).select(*cols))
        .unionByName(sets.withColumn("invariant", F.lit("E3")).select(*cols)))
