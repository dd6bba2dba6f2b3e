"""Canonical schemas and the field rules that rows must satisfy."""

from __future__ import annotations

from pyspark.sql import types as T

_ATTRS = T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


S, L, D = T.StringType(), T.LongType(), T.DoubleType()

SPAN = T.StructType(_fields(trace_id=S, span_id=S, parent_span_id=S, time=L, service=S, operation=S, duration_ms=D, status=S) + [_ATTRS])
METRIC = T.StructType(_fields(time=L, service=S, metric=S, value=D, unit=S) + [_ATTRS])
LOG = T.StructType(_fields(time=L, service=S, severity=S, message=S, trace_id=S) + [_ATTRS])
CHANGE = T.StructType(_fields(id=S, time=L, service=S, kind=S, summary=S, diff_touches=T.ArrayType(S)))
ALERT = T.StructType(
    _fields(alertname=S, severity=S, starts_at_second=L, labels=T.MapType(S, S), annotations=T.MapType(S, S), value=D, expr=S, fingerprint=S))
MANIFEST = T.StructType(
    _fields(scenario_id=S, source=S, time_unit=S, window=T.StructType(_fields(start=L, end=L)), symptom=S, available_signals=T.ArrayType(S),
            notes=T.ArrayType(S), alerts=T.ArrayType(ALERT)))
ROOT_CAUSE = T.StructType(_fields(kind=S, type=S, service=S, caller=S, callee=S))
TRUTH = T.StructType(
    _fields(scenario_id=S, injection=T.StructType(_fields(raw_flag_key=S, variant=S, enabled_at_second=L)), root_cause=ROOT_CAUSE,
            culprit_change_id=S, expected_evidence=T.ArrayType(S), decoy_change_ids=T.ArrayType(S), accepted_services=T.ArrayType(S)))
TOPOLOGY = T.StructType(_fields(services=T.ArrayType(S), edges=T.ArrayType(T.StructType(_fields(caller=S, callee=S)))))

SIGNALS = {"traces": SPAN, "metrics": METRIC, "logs": LOG, "changes": CHANGE, "manifest": MANIFEST, "truth": TRUTH, "topology": TOPOLOGY}

# Rules per signal: a SQL predicate a valid row satisfies, and the reject reason.
_TEXT = "{0} is not null and {0} <> ''"


def _required(*columns: str) -> list[tuple[str, str]]:
    return [(_TEXT.format(c), f"{c} is empty") for c in columns]


def _not_negative(*columns: str) -> list[tuple[str, str]]:
    return [(f"{c} is not null and {c} >= 0", f"{c} is missing or negative") for c in columns]


RULES = {
    "traces": _required("trace_id", "span_id", "service", "operation", "status") + _not_negative("time", "duration_ms"),
    "metrics": _required("service", "metric", "unit") + _not_negative("time") + [("value is not null", "value is missing")],
    "logs": _required("service", "severity", "message") + _not_negative("time"),
    "changes": _required("id", "service", "kind", "summary") + _not_negative("time"),
    "manifest": _required("scenario_id", "source", "time_unit", "symptom") + [
        ("window is not null and window.start >= 0 and window.end > window.start", "window end must follow its start"),
        ("size(available_signals) > 0", "available_signals is empty"), ("size(alerts) > 0", "alerts is empty"),
        ("forall(alerts, a -> a.severity in ('warning', 'critical') and a.alertname <> '' and a.expr <> '' and a.fingerprint <> '' and a.starts_at_second >= 0)",
         "an alert is malformed")],
    "truth": _required("scenario_id", "culprit_change_id") + [
        ("root_cause.kind <> '' and root_cause.type <> ''", "root cause is malformed"),
        ("size(expected_evidence) > 0", "expected_evidence is empty"), ("size(decoy_change_ids) > 0", "decoy_change_ids is empty")],
    "topology": [("size(services) > 0", "services is empty"),
                 ("size(array_distinct(services)) = size(services)", "services must be unique"),
                 ("edges is null or forall(edges, e -> e.caller <> '' and e.callee <> '')", "an edge is malformed")],
}
