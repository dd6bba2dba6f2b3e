"""Evidence for and against hypotheses, evidence bundles and runbook matching."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.functions.expr import is_error, kind_is
from faultline.operators.changes import nearest_before
from faultline.operators.correlate import align_signals, timeline
from faultline.operators.metrics import RED_METRICS
from faultline.operators.spans import resolve_callees

# fixed values: rises that support a hypothesis
ERROR_RATE_RISE = 0.02
LATENCY_RISE_MS = 100.0
# fixed values: wording of signals in evidence lines
SIGNAL_LABELS = {"request_error_rate": "error rate", "latency_p95_ms": "p95 latency", "cpu_cores": "cpu cores"}


def service_signals(spans: DataFrame, metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per service: own server errors, RED rises and whether a resource metric rose."""
    errors = spans.where(is_error() & kind_is("server")).groupBy("incident_id", "service").agg(
        F.count(F.lit(1)).alias("server_errors"))
    signals = align_signals(metrics, incidents)
    rise = F.col("post_mean") - F.col("pre_mean")
    rises = signals.groupBy("incident_id", "service").agg(
        F.coalesce(F.max(F.when(F.col("metric") == RED_METRICS[0], rise)), F.lit(0.0)).alias("error_rise"),
        F.coalesce(F.max(F.when(F.col("metric") == RED_METRICS[1], rise)), F.lit(0.0)).alias("latency_rise"),
        F.count_if(F.col("shifted") & ~F.col("metric").isin(*RED_METRICS)).alias("resource_rises"))
    zero = {"server_errors": 0, "error_rise": 0.0, "latency_rise": 0.0, "resource_rises": 0}
    return errors.join(rises, ["incident_id", "service"], "full_outer").na.fill(zero)


def gather_evidence(
    hypotheses: DataFrame, spans: DataFrame, metrics: DataFrame, changes: DataFrame, incidents: DataFrame
) -> DataFrame:
    """Support and confidence of service and edge hypotheses, with the nearest earlier change.

    ``hypotheses``: incident_id, id, kind, service, caller, callee.
    """
    signals = service_signals(spans, metrics, incidents)
    edge_errors = (
        resolve_callees(spans).where(is_error() & kind_is("client") & F.col("callee").isNotNull())
        .groupBy("incident_id", F.col("service").alias("caller"), "callee").agg(F.count(F.lit(1)).alias("client_errors")))
    callee_errors = signals.select("incident_id", F.col("service").alias("callee"), F.col("server_errors").alias("callee_errors"))
    joined = (
        hypotheses.join(signals, ["incident_id", "service"], "left")
        .join(edge_errors, ["incident_id", "caller", "callee"], "left").join(callee_errors, ["incident_id", "callee"], "left")
        .join(incidents.select("incident_id", "onset_second"), "incident_id")
        .na.fill({"server_errors": 0, "error_rise": 0.0, "latency_rise": 0.0, "resource_rises": 0, "client_errors": 0, "callee_errors": 0}))
    is_service = (F.col("kind") == "service") & F.col("service").isNotNull()
    is_edge = (F.col("kind") == "edge") & F.col("caller").isNotNull() & F.col("callee").isNotNull()
    is_service, is_edge = F.coalesce(is_service, F.lit(False)), F.coalesce(is_edge, F.lit(False))
    moved = (F.col("error_rise") > ERROR_RATE_RISE) | (F.col("latency_rise") > LATENCY_RISE_MS) | (F.col("resource_rises") > 0)
    own = F.col("server_errors") > 0
    edge_ok = (F.col("client_errors") > 0) & (F.col("callee_errors") == 0)
    staged = joined.select(
        "incident_id", "id", "kind", "onset_second", F.when(is_service, F.col("service")).when(is_edge, F.col("caller")).alias("service"),
        F.when(is_service, own | moved).when(is_edge, edge_ok).otherwise(False).alias("supported"),
        F.when(is_service, F.when(own, 0.9).when(moved, 0.6).otherwise(0.1))
        .when(is_edge, F.when(edge_ok, 0.8).when(F.col("client_errors") > 0, 0.3).otherwise(0.0)).otherwise(0.0).alias("confidence"),
        F.when(is_service, F.col("server_errors")).when(is_edge, F.col("callee_errors")).alias("server_errors"),
        F.when(is_edge, F.col("client_errors")).alias("client_errors"))
    return nearest_before(changes, staged).withColumnRenamed("change_id", "suspect_change_id").drop("onset_second", "change_time")


def rule_out_services(spans: DataFrame, metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Services without own server errors, a latency rise above 100 ms or a resource rise."""
    fault = (F.col("server_errors") > 0) | (F.col("latency_rise") > LATENCY_RISE_MS) | (F.col("resource_rises") > 0)
    return service_signals(spans, metrics, incidents).select(
        "incident_id", "service", (~fault).alias("ruled_out"),
        F.when(fault, "shows an own-fault signal; cannot be eliminated")
        .otherwise("no own server errors and no meaningful rise after onset").alias("reason"))


def rule_out_changes(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    late = F.col("time") >= F.col("onset_second")
    return changes.join(incidents.select("incident_id", "onset_second"), "incident_id").select(
        "incident_id", "id", late.alias("ruled_out"),
        F.when(late, "at or after onset; a cause must precede its symptom")
        .otherwise("precedes onset; still a candidate").alias("reason"))


def _two(value: str) -> Column:
    return F.format_string("%.2f", F.bround(value, 2))


def evidence_lines(
    suspects: DataFrame, spans: DataFrame, metrics: DataFrame, changes: DataFrame, incidents: DataFrame
) -> DataFrame:
    """Evidence lines per suspect: own errors, signal rises, the culprit change.

    ``suspects``: incident_id, service, culprit_change_id.
    """
    keys = ["incident_id", "service"]
    own = spans.where(is_error() & kind_is("server")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(suspects, keys).select(
        "incident_id", F.lit(0).alias("section"), F.lit("").alias("item"),
        F.concat("service", F.lit(" own server spans error ("), F.col("n").cast("string"), F.lit("): a service-fault signal")).alias("line"))
    labels = F.create_map(*[x for k, v in SIGNAL_LABELS.items() for x in (F.lit(k), F.lit(v))])
    label = F.coalesce(F.try_element_at(labels, F.col("metric")), F.col("metric"))
    rises = align_signals(metrics, incidents).where("shifted").join(suspects, keys).select(
        "incident_id", (F.col("signal_order") + 1).alias("section"), F.col("metric").alias("item"),
        F.concat("service", F.lit(" "), label, F.lit(" rose from "), _two("pre_mean"), F.lit(" to "), _two("post_mean"),
                 F.lit(" after onset")).alias("line"))
    picked = changes.join(suspects.select("incident_id", F.col("culprit_change_id").alias("id")), ["incident_id", "id"]).join(
        incidents.select("incident_id", "onset_second"), "incident_id").select(
        "incident_id", F.lit(9).alias("section"), F.col("id").alias("item"),
        F.concat(F.lit("culprit "), "id", F.lit(" on "), "service", F.lit(" at second "), F.col("time").cast("string"),
                 F.lit(" precedes onset "), F.col("onset_second").cast("string"), F.lit(": "), "summary").alias("line"))
    return own.unionByName(rises).unionByName(picked)


def evidence_bundle(
    suspects: DataFrame, spans: DataFrame, metrics: DataFrame, changes: DataFrame, incidents: DataFrame
) -> DataFrame:
    """Evidence lines in order; the timeline stays a table, see ``timeline``."""
    lines = evidence_lines(suspects, spans, metrics, changes, incidents)
    folded = lines.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("section", "item", "line"))), lambda s: s["line"]).alias("evidence"))
    entries = timeline(changes, incidents).groupBy("incident_id").agg(F.count(F.lit(1)).alias("timeline_entries"))
    return suspects.join(folded, "incident_id", "left").join(entries, "incident_id", "left")


# fixed values: runbook catalogue (id, title, keywords) in catalogue order
RUNBOOKS = [
    ("rb-degradation", "User-facing degradation", ["degradation", "user-facing", "incident", "general", "page", "slo", "alert"]),
    ("rb-errors", "Elevated error rate", ["error", "errors", "failing", "failure", "5xx", "exception", "unavailable"]),
    ("rb-latency", "Latency or slowdown", ["latency", "slow", "slowdown", "p95", "timeout", "gc", "duration", "pause"]),
    ("rb-saturation", "Resource saturation", ["cpu", "saturation", "resource", "memory", "cores", "throttle", "load"]),
    ("rb-change", "Correlating a change to an incident", ["change", "deploy", "culprit", "correlate", "rollback", "config", "decoy"]),
]
DEFAULT_RUNBOOK = "rb-degradation"


def default_runbooks(spark: SparkSession) -> DataFrame:
    rows = [(i, rid, title, words) for i, (rid, title, words) in enumerate(RUNBOOKS)]
    return spark.createDataFrame(rows, "catalogue_order int, id string, title string, keywords array<string>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _fits(term: Column, words: list[str]) -> Column:
    """Whether a term of three letters or more lies in one of the words; the pieces of a word are few."""
    return term.isin(sorted({w[a:b] for w in words for a in range(len(w)) for b in range(a + 3, len(w) + 1)}))


def _shortest(words: list[str]) -> list[str]:
    """Without words that hold another one: what holds them holds that one too."""
    return [w for w in dict.fromkeys(words) if not any(v in w for v in words if v != w)]


def match_runbooks(symptoms: DataFrame, limit: int = 3) -> DataFrame:
    """Best runbooks per (incident_id, query): one point per query term that fits a keyword.

    The catalogue is a fixed constant, so a row is scored where it lies: keywords that its text
    does not hold are dropped before the terms are looked at, and only terms that fit some
    keyword are counted. Equal rows compete for the places, so they meet by a digest of the
    text; the text itself travels only if the caller reads it.
    """
    every = [w for _, _, words in RUNBOOKS for w in words]

    def fitting(text: Column) -> Column:
        there = F.filter(F.array(*[F.lit(w) for w in _shortest(every)]), lambda w: text.contains(w))
        terms = lambda held: F.filter(F.split(text, r"\s+"), lambda t: (F.length(t) >= 3) & (_fits(t, every) | F.exists(held, lambda w: t.contains(w))))
        return F.array_distinct(_let(there, terms))

    def scores(terms: Column) -> Column:
        """(-score, place) of each runbook with a point, best first."""
        points = lambda words: F.size(F.filter(terms, lambda t: functools.reduce(Column.__or__, [t.contains(w) for w in _shortest(words)], _fits(t, words))))
        places = [F.struct((-points(words)).alias("lost"), F.lit(place).alias("place")) for place, (_, _, words) in enumerate(RUNBOOKS)]
        return F.array_sort(F.filter(F.array(*places), lambda b: b["lost"] < 0))

    scored = symptoms.select("incident_id", "query", F.sha2("query", 256).alias("_text"), _let(_let(F.lower("query"), fitting), scores).alias("_best"))
    missed = F.size("_best") == 0
    # A row without a hit gives a row of its own, so copies need not meet in one task.
    groups = scored.groupBy("incident_id", "_text", "_best", F.when(missed, F.spark_partition_id()).alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.first("query").alias("query"))
    ids = F.array(*[F.lit(rid) for rid, _, _ in RUNBOOKS])
    hit = lambda b: F.struct(F.get(ids, b["place"]).alias("id"), (-b["lost"]).alias("score"))
    copies = F.least(F.col("_n"), F.lit(limit)).cast("int")
    hits = F.slice(F.flatten(F.transform("_best", lambda b: F.array_repeat(hit(b), copies))), 1, limit)
    placed = F.transform(hits, lambda h, i: F.struct((i + 1).alias("position"), h["id"].alias("id"), h["score"].alias("score")))
    default = F.struct(F.lit(1).alias("position"), F.lit(DEFAULT_RUNBOOK).alias("id"), F.lit(0).alias("score"))
    none = F.when(missed | F.col("incident_id").isNull(), F.array_repeat(default, F.col("_n").cast("int"))).otherwise(F.array().cast(
        "array<struct<position:int,id:string,score:int>>"))
    return groups.select("incident_id", "query", F.explode(F.concat(placed, none)).alias("r")).select("incident_id", "query", "r.position", "r.id", "r.score")


def runbook_steps(runbooks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Steps of the wanted runbook ids; unknown ids get a note. ``runbooks``: id, title, when, steps."""
    return wanted.select("id").distinct().join(runbooks, "id", "left").withColumn(
        "note", F.when(F.col("title").isNull(), F.concat(F.lit("no runbook with id "), "id")))
