"""Sealing, data-quality gates, incident fingerprints and report checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.functions.expr import log_fingerprint
from faultline.functions.ordered import ordered_index, top_per_group
from faultline.operators.metrics import SERIES
from faultline.operators.spans import with_onset
from faultline.session import store

# fixed values: tokens that must not appear in public data
BANNED_TOKENS = [
    "paymentFailure", "paymentUnreachable", "recommendationCacheFailure", "productCatalogFailure", "adHighCpu", "adManualGc",
    "cartFailure", "kafkaQueueProblems", "loadGeneratorFloodHomepage", "imageSlowLoad", "emailMemoryLeak", "feature_flag.key",
    "feature_flag.result.variant", "feature_flag.result.value", "feature_flag.", "raw_flag_key",
]
# fixed values: tokens redacted from outputs
REDACTED_TOKENS = [
    "feature_flag", "eval_only", "truth.json", "paymentFailure", "paymentUnreachable", "productCatalogFailure", "cartFailure",
    "adManualGc", "adHighCpu", "recommendationCacheFailure", "kafkaQueueProblems", "loadGeneratorFloodHomepage",
]
# fixed values: quality gates
GATES = {"min_spans": 50, "min_logs": 20, "max_pre_error": 0.10, "error_delta": 0.05, "latency_ratio": 1.5, "cpu_delta": 1.0}
REQUIRED_SIGNALS = ["metrics", "logs", "traces", "changes"]


def token_array(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens])


# ---- sealing ------------------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (path, line_number, line); numbers come from per-split counts."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return ordered_index(raw, ["path"], ["split", "seq"]).select(
        "path", (F.col("idx") + 1).alias("line_number"), "line")


def banned_token_findings(lines: DataFrame, tokens: list[str] = BANNED_TOKENS) -> DataFrame:
    """One row per line and banned token in it; the fixed token list rides along as an array."""
    hits = F.filter(token_array(tokens), lambda t: F.col("line").contains(t))
    keep = [c for c in lines.columns if c != "line"]
    return lines.select(*keep, F.explode(hits).alias("token"))


def public_attributes(attributes: str | Column, tokens: list[str] = BANNED_TOKENS) -> Column:
    """The entries of a map whose key and value hold no banned token."""
    column = F.col(attributes) if isinstance(attributes, str) else attributes
    banned = lambda text: F.coalesce(F.exists(token_array(tokens), lambda t: text.contains(t)), F.lit(False))
    return F.map_filter(column, lambda k, v: ~banned(k) & ~banned(v))


def redact(text: str | Column, tokens: list[str] = REDACTED_TOKENS) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    for token in tokens:
        column = F.replace(column, F.lit(token), F.lit("[redacted]"))
    return column


def redact_rows(rows: DataFrame, column: str, tokens: list[str] = REDACTED_TOKENS) -> DataFrame:
    clean = redact(column, tokens)
    return rows.withColumn("redacted", clean != F.col(column)).withColumn(column, clean)


# ---- gates --------------------------------------------------------------------------------

def metric_is(kind: str) -> Column:
    m = F.col("metric")
    return {"error": m.contains("error"), "latency": m.contains("latency") | m.contains("duration"),
            "cpu": m.contains("cpu"), "resource": m.contains("cpu") | m.contains("memory")}[kind]


def target_services(truth: DataFrame) -> DataFrame:
    named = [c for c in ("service", "caller", "callee") if c in truth.columns]
    pairs = F.array(*[F.col(c) for c in named])
    return truth.select("incident_id", F.explode(pairs).alias("service")).where("service <> ''").distinct()


def signal_gates(
    incidents: DataFrame, truth: DataFrame, spans: DataFrame, logs: DataFrame, metrics: DataFrame, gates: dict[str, float] = GATES
) -> DataFrame:
    """One row per incident and failed signal-quality gate."""
    targets = target_services(truth)
    sizes = spans.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_spans")).join(
        logs.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_logs")), "incident_id", "full_outer")
    after = F.col("time") >= F.col("onset_second")
    seen = with_onset(metrics.join(targets, ["incident_id", "service"], "left_semi"), incidents)

    def mean(kind: str, side: Column) -> Column:
        return F.avg(F.when(metric_is(kind) & side, F.col("value")))

    impact = seen.groupBy("incident_id").agg(
        F.max(after & (metric_is("error") | metric_is("latency") | metric_is("cpu"))).alias("has_post"),
        mean("error", ~after).alias("e0"), mean("error", after).alias("e1"), mean("latency", ~after).alias("l0"),
        mean("latency", after).alias("l1"), mean("cpu", ~after).alias("c0"), mean("cpu", after).alias("c1"))

    def evidence(df: DataFrame, name: str) -> DataFrame:
        hit = with_onset(df.join(targets, ["incident_id", "service"], "left_semi"), incidents)
        return hit.where(after).groupBy("incident_id").agg(F.lit(True).alias(name))

    joined = (
        incidents.select("incident_id").join(sizes, "incident_id", "left").join(impact, "incident_id", "left")
        .join(evidence(spans, "post_spans"), "incident_id", "left").join(evidence(logs, "post_logs"), "incident_id", "left"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    moved = (ok(F.col("e1") - F.col("e0") >= gates["error_delta"]) | ok((F.col("l0") > 0) & (F.col("l1") / F.col("l0") >= gates["latency_ratio"]))
             | ok(F.col("c1") - F.col("c0") >= gates["cpu_delta"]))
    failed = F.array(
        F.when(F.coalesce("n_spans", F.lit(0)) < gates["min_spans"], F.lit("too few spans")),
        F.when(F.coalesce("n_logs", F.lit(0)) < gates["min_logs"], F.lit("too few logs")),
        F.when(~ok(F.col("has_post")), F.lit("target has no post-onset error, latency or cpu metric")),
        F.when(ok(F.col("e0") > gates["max_pre_error"]), F.lit("pre-onset error rate exceeds the healthy gate")),
        F.when(~moved, F.lit("post-onset impact is below the error, latency and cpu gates")),
        F.when(~ok(F.col("post_spans")) & ~ok(F.col("post_logs")), F.lit("target has no post-onset log or trace evidence")))
    return joined.select("incident_id", F.explode(F.filter(failed, lambda v: v.isNotNull())).alias("violation"))


def manifest_violations(manifests: DataFrame, truth: DataFrame, changes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Missing signals, unknown or misused change ids, and alerts outside the window.

    ``manifests``: incident_id, window_end, available_signals. ``truth``: incident_id,
    culprit_change_id, decoy_change_ids. ``alerts``: incident_id, alertname, starts_at_second.
    """
    def rows(df: DataFrame, item: Column, violation: str) -> DataFrame:
        return df.select("incident_id", item.cast("string").alias("item"), F.lit(violation).alias("violation"))

    gone = F.array_except(token_array(REQUIRED_SIGNALS), F.col("available_signals"))
    signals = rows(manifests.select("incident_id", F.explode(gone).alias("s")), F.col("s"), "missing signal")
    known = changes.select("incident_id", F.col("id"), F.struct("time", "service", "kind", "summary").alias("body"))
    none = rows(truth.where(F.size("decoy_change_ids") == 0), F.lit(None), "truth has no decoys")
    culprit = truth.select("incident_id", F.col("culprit_change_id").alias("id"))
    decoys = truth.select("incident_id", "culprit_change_id", F.explode("decoy_change_ids").alias("id"))
    unknown_culprit = rows(culprit.join(known, ["incident_id", "id"], "left_anti"), F.col("id"), "culprit is not a known change")
    unknown_decoy = rows(decoys.join(known, ["incident_id", "id"], "left_anti"), F.col("id"), "decoy is not a known change")
    same = rows(decoys.where(F.col("id") == F.col("culprit_change_id")).join(known, ["incident_id", "id"], "left_semi"),
                F.col("id"), "decoy duplicates the culprit")
    quiet = rows(manifests.join(alerts, "incident_id", "left_anti"), F.lit(None), "manifest has no alerts")
    outside = alerts.join(manifests.select("incident_id", "window_end"), "incident_id").where(
        ~F.col("starts_at_second").between(F.lit(0), F.col("window_end")))
    late = rows(outside, F.col("alertname"), "alert starts outside the window")
    out = signals
    for part in (none, unknown_culprit, unknown_decoy, same, quiet, late):
        out = out.unionByName(part)
    return out


def replay_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that one load has and the other lacks, with multiplicity; empty means deterministic."""
    columns = first.columns
    both = first.select(*columns, F.lit(1).alias("_n")).unionByName(second.select(*columns, F.lit(-1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where(F.col("surplus") != 0)


# ---- fingerprints -------------------------------------------------------------------------

def _folded(df: DataFrame, name: str, value: str = "service") -> DataFrame:
    return df.groupBy("incident_id").agg(F.sort_array(F.collect_set(value)).alias(name))


def incident_fingerprints(
    incidents: DataFrame, metrics: DataFrame, logs: DataFrame, spans: DataFrame, changes: DataFrame
) -> DataFrame:
    """Nine observable features per incident; lists hold at most five entries or one per service."""
    after = F.col("time") >= F.col("onset_second")
    seen = with_onset(metrics, incidents)

    def mean(kind: str, side: Column) -> Column:
        return F.avg(F.when(metric_is(kind) & side, F.col("value")))

    per = seen.groupBy("incident_id", "service").agg(*[
        mean(kind, side).alias(f"{kind}{i}") for kind in ("error", "latency", "resource") for i, side in enumerate((~after, after))])
    ratio = lambda k, r: F.coalesce((F.col(f"{k}0") > 0) & (F.col(f"{k}1") / F.col(f"{k}0") >= r), F.lit(False))
    resource = ratio("resource", 1.25)
    error = F.coalesce(F.col("error1") - F.col("error0") >= 0.05, F.lit(False))
    impacted = _folded(per.where(error | ratio("latency", 1.5) | resource), "impacted_services")
    saturated = _folded(per.where(resource), "resource_anomalies")

    base = seen.groupBy(*SERIES).agg(F.avg(F.when(~after, F.col("value"))).alias("base")).where("base IS NOT NULL")
    odd = (
        F.when(metric_is("error"), F.col("value") >= F.col("base") + 0.05)
        .when(metric_is("latency"), (F.col("base") > 0) & (F.col("value") >= F.col("base") * 1.5))
        .when(metric_is("resource"), (F.col("base") > 0) & (F.col("value") >= F.col("base") * 1.25)).otherwise(False))
    earliest = seen.where(after).join(base, SERIES).where(odd).groupBy("incident_id").agg(
        F.min(F.struct("time", "service")).alias("e")).select("incident_id", F.col("e.service").alias("earliest_anomalous_service"))

    def top(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
        picked = top_per_group(df, ["incident_id"], order, 5, "_r").select("incident_id", "_r", value.alias("_x"))
        return picked.groupBy("incident_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_r", "_x"))), lambda s: s["_x"]).alias(name))

    def top_services(kind: str, name: str) -> DataFrame:
        have = per.where(F.col(f"{kind}1").isNotNull())
        return top(have, [F.col(f"{kind}1").desc(), F.col("service")], F.col("service"), name)

    clusters = with_onset(logs, incidents).where(after).groupBy("incident_id", log_fingerprint("message").alias("template")).agg(
        F.count(F.lit(1)).alias("n"))
    slow = [F.col("duration_ms").desc(), F.col("service"), F.col("operation"), F.col("span_id")]
    parts = [
        impacted, earliest, top_services("error", "top_error_services"), top_services("latency", "top_latency_services"),
        top(clusters, [F.col("n").desc(), F.col("template")], F.col("template"), "dominant_log_clusters"),
        top(spans, slow, F.concat_ws(":", "service", "operation"), "slowest_spans"), saturated,
        changes.groupBy("incident_id").agg(F.count(F.lit(1)).alias("change_events"), F.min("time").alias("first_change_second"),
                                           F.max("time").alias("last_change_second")),
    ]
    out = incidents.select("incident_id")
    for part in parts:
        out = out.join(part, "incident_id", "left")
    empty = F.array().cast("array<string>")
    lists = ["impacted_services", "top_error_services", "top_latency_services", "dominant_log_clusters", "slowest_spans", "resource_anomalies"]
    return out.withColumns({c: F.coalesce(c, empty) for c in lists})


def change_timing(changes: DataFrame) -> DataFrame:
    """The ninth feature in long form: the time of every change."""
    return changes.select("incident_id", "id", "time")


COMPARED = ["impacted_services", "top_error_services", "top_latency_services", "dominant_log_clusters", "resource_anomalies"]


def trivially_distinct(fingerprints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether the two incidents of each given pair (left_id, right_id) share nothing in five lists."""
    left = fingerprints.select(F.col("incident_id").alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in COMPARED])
    right = fingerprints.select(F.col("incident_id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in COMPARED])
    shared = F.lit(False)
    for c in COMPARED:
        shared = shared | F.arrays_overlap(f"l_{c}", f"r_{c}")
    return pairs.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", (~shared).alias("trivially_distinct"))


def sharing_pairs(fingerprints: DataFrame, hot: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Which incidents share a value in one of the five lists, without holding all against all.

    An inverted index (feature, value) to incidents brings together only incidents that
    share a value. Returns the pairs (left_id, right_id, shared_features, shared_values)
    that meet at a value of at most ``hot`` holders, counted over all their values, and
    the classes (incident_id, feature, value, holders) of the values with more. Two
    incidents share a value exactly if they are a pair or have a class in common, so
    nothing is lost and no value expands to all pairs of its holders. Null lists
    are empty, null values and incidents take no part, a repeated value counts once.
    """
    def tagged(i: int) -> Column:
        values = F.coalesce(COMPARED[i], F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(i).alias("f"), v.alias("value")))

    def holds(found: Column, i: int) -> Column:
        return F.exists(found, lambda x: x["f"] == i)

    places = range(len(COMPARED))
    entries = [tagged(i) for i in places]
    items = fingerprints.where(F.col("incident_id").isNotNull()).select("incident_id", F.explode(F.flatten(F.array(*entries))).alias("x")).select(
        "incident_id", "x.*").where(F.col("value").isNotNull()).distinct()
    items = store(items, "items")
    holders = store(items.groupBy("f", "value").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1), "holders")
    index = store(items.join(holders, ["f", "value"]), "index")
    common, rare = index.where(F.col("holders") > hot), index.where(F.col("holders") <= hot)
    left = rare.select("f", "value", F.col("incident_id").alias("left_id"))
    right = rare.select("f", "value", F.col("incident_id").alias("right_id"))
    bit = F.get(F.array(*[F.lit(1 << i) for i in places]), F.col("f"))
    met = left.join(right, ["f", "value"]).where(F.col("left_id") < F.col("right_id")).groupBy("left_id", "right_id").agg(
        F.bit_or(bit).alias("_mask"), F.count(F.lit(1)).alias("_n"))
    known = common.groupBy("incident_id").agg(F.collect_set(F.struct("f", "value")).alias("_hot"))
    lists = [known.select(F.col("incident_id").alias(f"{side}_id"), F.col("_hot").alias(f"_{side}")) for side in ("left", "right")]
    both = met.join(lists[0], "left_id", "left").join(lists[1], "right_id", "left")
    shared = F.coalesce(F.array_intersect("_left", "_right"), F.array().cast(known.schema["_hot"].dataType))
    mask = F.col("_mask")
    for i in places:
        mask = mask.bitwiseOR(F.when(holds(shared, i), 1 << i).otherwise(0))
    pairs = both.select("left_id", "right_id", F.bit_count(mask).cast("long").alias("shared_features"), (F.col("_n") + F.size(shared)).cast("long").alias("shared_values"))
    names = F.array(*[F.lit(c) for c in COMPARED])
    return pairs, common.select("incident_id", F.get(names, F.col("f")).alias("feature"), "value", "holders")


# ---- report checks ------------------------------------------------------------------------

def _issues(rows: DataFrame, keys: list[str], checks: list[tuple[Column, str]]) -> DataFrame:
    found = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in checks])
    return rows.select(*keys, F.explode(F.filter(found, lambda v: v.isNotNull())).alias("issue"))


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def report_issues(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per problem of a draft report.

    ``reports``: incident_id, kind, service, caller, callee, culprit_change_id,
    ruled_out_change_ids, evidence. Only incidents without any change may leave
    the culprit empty.
    """
    known = changes.select("incident_id", F.col("id").alias("culprit_change_id"), F.lit(True).alias("_known")).distinct()
    has = changes.select("incident_id", F.lit(True).alias("_has")).distinct()
    rows = reports.join(known, ["incident_id", "culprit_change_id"], "left").join(has, "incident_id", "left")
    kind = F.coalesce("kind", F.lit(""))
    blank = _blank("culprit_change_id")
    return _issues(rows, ["incident_id"], [
        ((kind == "service") & _blank("service"), "root cause of kind service requires a service"),
        ((kind == "edge") & (_blank("caller") | _blank("callee")), "root cause of kind edge requires caller and callee"),
        (~kind.isin("service", "edge"), "root cause kind must be service or edge"),
        (blank & F.col("_has").isNotNull(), "culprit change is empty"),
        (~blank & F.col("_known").isNull(), "culprit change is not a known change"),
        (~blank & F.coalesce(F.array_contains("ruled_out_change_ids", F.col("culprit_change_id")), F.lit(False)),
         "culprit change is also ruled out"),
        (F.coalesce(F.size("evidence"), F.lit(0)) == 0, "evidence is empty"),
    ])


def missing_decoys(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Known changes a report neither blames nor rules out, by anti join."""
    settled = reports.select("incident_id", F.explode(F.concat(
        F.array("culprit_change_id"), F.coalesce("ruled_out_change_ids", F.array().cast("array<string>")))).alias("id"))
    return (
        changes.select("incident_id", "id").distinct().join(reports.select("incident_id"), "incident_id", "left_semi")
        .join(settled, ["incident_id", "id"], "left_anti"))


def finding_issues(findings: DataFrame) -> DataFrame:
    """Contract problems of per-service findings.

    ``findings``: incident_id, finding_id, service, is_origin, fault_type, confidence, evidence.
    """
    origin = F.coalesce("is_origin", F.lit(False))
    return _issues(findings, ["incident_id", "finding_id"], [
        (_blank("service"), "service is required"),
        (origin & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "an origin requires evidence"),
        (origin & _blank("fault_type"), "an origin requires a fault type"),
        (F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "confidence must be between 0 and 1"),
    ])
