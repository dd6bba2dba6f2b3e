"""Span access paths and trace analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.expr import is_error, kind_is, rpc_callee
from faultline.functions.ordered import exact_p95, ordered_index, top_per_group
from faultline.operators import paths
from faultline.session import checkpoint, store

SPAN_ORDER = ("time", "trace_id", "span_id")


def span_order() -> Column:
    return F.struct(*SPAN_ORDER)


def with_onset(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """Attach ``onset_second``; Spark broadcasts the incident table only while it is small."""
    return df.join(incidents.select("incident_id", "onset_second"), "incident_id")


# ---- access paths -------------------------------------------------------------------------

def dedup_spans(spans: DataFrame) -> DataFrame:
    """One row per span id: the first in (time, trace, span, parent) order."""
    order = ["time", "trace_id", "span_id", F.coalesce("parent_span_id", F.lit(""))]
    return top_per_group(spans, ["incident_id", "span_id"], [F.col(o) if isinstance(o, str) else o for o in order], 1)


def service_universe(spans: DataFrame, metrics: DataFrame, changes: DataFrame) -> DataFrame:
    names = [t.select("incident_id", "service").distinct() for t in (spans, metrics, changes)]
    return names[0].union(names[1]).union(names[2]).distinct()


def resolve_callees(spans: DataFrame) -> DataFrame:
    """Add ``callee``: service of the first server child, else the RPC name.

    Children are reduced to one row per parent before the join, so a parent with
    very many children costs no more than any other.
    """
    children = (
        spans.where(kind_is("server") & F.col("parent_span_id").isNotNull())
        .groupBy("incident_id", F.col("parent_span_id").alias("span_id"))
        .agg(F.min_by("service", span_order()).alias("_child"))
    )
    named = F.col("operation")
    if "rpc_method" in spans.columns:
        named = F.coalesce(F.nullif(F.col("rpc_method"), F.lit("")), named)
    return (
        spans.join(children, ["incident_id", "span_id"], "left")
        .withColumn("callee", F.coalesce("_child", rpc_callee(named))).drop("_child")
    )


def children_index(spans: DataFrame) -> DataFrame:
    """Parent and child pairs that both exist in the incident."""
    child = spans.where(F.col("parent_span_id").isNotNull()).select(
        "incident_id", F.col("parent_span_id").alias("span_id"),
        F.col("span_id").alias("child_id"), F.col("service").alias("child_service"),
        F.col("span_kind").alias("child_kind"), F.col("duration_ms").alias("child_ms"),
    )
    return child.join(spans.select("incident_id", "span_id", "service"), ["incident_id", "span_id"])


def search_spans(
    spans: DataFrame, service: str | None = None, span_kind: str | None = None, status: str | None = None,
    callee: str | None = None, operation_contains: str | None = None,
    start: int | None = None, end: int | None = None,
) -> DataFrame:
    """Spans passing every given filter; both time ends are inclusive."""
    if callee is not None:
        spans = resolve_callees(spans).where(F.col("callee") == callee)
    if service is not None:
        spans = spans.where(F.col("service") == service)
    if span_kind is not None:
        spans = spans.where(kind_is(span_kind.lower()))
    if status is not None:
        spans = spans.where(F.upper("status") == status.upper())
    if operation_contains is not None:
        spans = spans.where(F.col("operation").contains(operation_contains))
    if start is not None:
        spans = spans.where(F.col("time") >= start)
    if end is not None:
        spans = spans.where(F.col("time") <= end)
    return spans


def page(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per incident with the total and a truncation note."""
    totals = df.groupBy("incident_id").agg(F.count(F.lit(1)).alias("total_matched"))
    shown = top_per_group(df, ["incident_id"], order, limit, rank="position")
    note = F.format_string(f"showing the first {limit} of %d matches; add filters to narrow", F.col("total_matched"))
    return (
        shown.join(totals, "incident_id")
        .withColumn("truncated", F.col("total_matched") > limit)
        .withColumn("note", F.when(F.col("truncated"), note))
    )


def find_spans(spans: DataFrame, limit: int = 50, **filters: object) -> DataFrame:
    return page(search_spans(spans, **filters), [F.col(c) for c in SPAN_ORDER], limit)


def fetch_traces(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Spans of the listed (incident_id, trace_id) pairs, callee shown for client spans only."""
    wanted = traces.select("incident_id", "trace_id").distinct()
    callee = F.when(kind_is("client"), F.col("callee"))
    return resolve_callees(spans).withColumn("callee", callee).join(wanted, ["incident_id", "trace_id"], "left_semi")


# ---- structure ----------------------------------------------------------------------------

def call_edges(
    spans: DataFrame, error_only: bool = False, before: Column | None = None, since: Column | None = None
) -> DataFrame:
    """Distinct caller to callee edges seen by client spans; ``before`` is exclusive."""
    resolved = resolve_callees(spans).where(kind_is("client"))
    if error_only:
        resolved = resolved.where(is_error())
    if before is not None:
        resolved = resolved.where(F.col("time") < before)
    if since is not None:
        resolved = resolved.where(F.col("time") >= since)
    return (
        resolved.where(F.col("callee").isNotNull() & (F.col("callee") != F.col("service")))
        .select("incident_id", F.col("service").alias("caller"), "callee").distinct()
    )


def dependency_services(spans: DataFrame) -> DataFrame:
    """Services of the dependency graph: every emitter plus every resolved callee."""
    callees = call_edges(spans).select("incident_id", F.col("callee").alias("service"))
    return spans.select("incident_id", "service").union(callees).distinct()


def first_error(spans: DataFrame) -> DataFrame:
    order = F.struct("time", "span_id")
    return spans.where(is_error()).groupBy("incident_id").agg(
        F.min("time").alias("second"), F.min_by("service", order).alias("service"),
        F.min_by(F.lower("span_kind"), order).alias("span_kind"), F.min_by("trace_id", order).alias("trace_id"),
    )


# ---- latency ------------------------------------------------------------------------------

def self_times(spans: DataFrame) -> DataFrame:
    """Add ``self_ms``: duration minus the summed duration of direct children, not below 0."""
    children = (
        spans.where(F.col("parent_span_id").isNotNull())
        .groupBy("incident_id", F.col("parent_span_id").alias("span_id"))
        .agg(F.sum("duration_ms").alias("_below"))
    )
    own = F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("_below", F.lit(0.0)))
    return spans.join(children, ["incident_id", "span_id"], "left").withColumn("self_ms", own).drop("_below")


def _ms(value: str | Column) -> Column:
    return F.format_string("%.0f", F.bround(F.col(value) if isinstance(value, str) else value, 0))


def latency_shifts(spans: DataFrame, incidents: DataFrame, min_self_ms: float = 50.0) -> DataFrame:
    """Self-time p95 before and after onset per service, serving or not."""
    timed = with_onset(self_times(spans), incidents)
    serving = spans.where(kind_is("server")).select("incident_id", "service").distinct().withColumn("_srv", F.lit(True))
    kept = store(timed.where(F.col("self_ms") >= min_self_ms).select(
        "incident_id", "service", kind_is("server").alias("is_server"), (F.col("time") >= F.col("onset_second")).alias("after"),
        "self_ms", *SPAN_ORDER), "self-times")
    keys = ["incident_id", "service", "is_server"]
    p95 = exact_p95(kept, [*keys, "after"], "self_ms")
    p95 = p95.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(~F.col("after"), F.col("p95"))), F.lit(0.0)).alias("pre_p95"),
        F.max(F.when(F.col("after"), F.col("p95"))).alias("post_p95"),
    ).where(F.col("post_p95").isNotNull())
    post = kept.where(F.col("after")).groupBy(*keys).agg(
        F.max("self_ms").alias("max_ms"), F.min(span_order()).alias("first_seen")
    )
    return (
        p95.join(post, keys).withColumn("shift", F.col("post_p95") - F.col("pre_p95"))
        .join(serving, ["incident_id", "service"], "left")
        .withColumn("serving", F.coalesce("_srv", F.lit(False))).drop("_srv")
        .where(F.col("is_server") | ~F.col("serving"))
    )


def latency_origin(spans: DataFrame, incidents: DataFrame, min_self_ms: float = 50.0) -> DataFrame:
    """Service whose own work slowed most per incident; null when none shifted enough."""
    shifts = checkpoint(latency_shifts(spans, incidents, min_self_ms))
    order = [F.col("shift").desc(), F.col("first_seen")]
    ranked = top_per_group(shifts.where("is_server"), ["incident_id"], order, 4, rank="_r")
    best = ranked.groupBy("incident_id").agg(
        *[F.max(F.when(F.col("_r") == 1, F.col(c))).alias(c) for c in ("service", "pre_p95", "post_p95", "max_ms", "shift")],
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_r") > 1, F.struct("_r", "service", "shift")))),
            lambda s: F.concat(s["service"], F.lit(":+"), _ms(s["shift"]), F.lit("ms"))), ", ").alias("_next"),
    )
    others = top_per_group(shifts.where(~F.col("is_server")), ["incident_id"], order, 3, rank="_r").where(
        F.col("shift") > min_self_ms
    )
    line = F.concat(
        F.lit("non-serving emitter "), "service", F.lit(" self-time p95 shifted "), _ms("pre_p95"),
        F.lit("ms -> "), _ms("post_p95"), F.lit("ms; suspect inbound load or a consumer-side change"),
    )
    emitters = others.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))), lambda s: s["line"]).alias("_em")
    )
    joined = incidents.select("incident_id").join(best, "incident_id", "left").join(emitters, "incident_id", "left")
    found = F.coalesce(F.col("shift") >= min_self_ms, F.lit(False))
    head = F.when(found, F.array(
        F.concat("service", F.lit(" own self-time p95 shifted from "), _ms("pre_p95"), F.lit("ms pre-onset to "),
                 _ms("post_p95"), F.lit("ms post-onset (max "), _ms("max_ms"), F.lit("ms)")),
        F.when(F.col("_next") != "", F.concat(F.lit("next largest shifts: "), "_next"))
        .otherwise(F.lit("no other serving service's self-time shifted meaningfully")),
    )).otherwise(F.array(F.lit("no request-serving service's self-time degraded meaningfully after onset")))
    return joined.select(
        "incident_id", F.when(found, F.col("service")).alias("service"),
        F.when(found, F.col("post_p95")).alias("self_latency_p95_ms"),
        F.when(found, F.col("pre_p95")).alias("baseline_p95_ms"),
        F.when(found, F.col("max_ms")).alias("self_latency_max_ms"),
        F.concat(head, F.coalesce("_em", F.array().cast("array<string>"))).alias("evidence"),
    )


def edge_shifts(resolved: DataFrame, incidents: DataFrame) -> DataFrame:
    """Client-span p95 per call edge before and after onset; a missing side counts as 0."""
    calls = with_onset(resolved, incidents).where(
        kind_is("client") & (F.col("callee") != "") & (F.col("callee") != F.col("service"))
    ).select("incident_id", F.col("service").alias("caller"), "callee", "duration_ms",
             (F.col("time") >= F.col("onset_second")).alias("after"))
    sides = exact_p95(store(calls, "calls"), ["incident_id", "caller", "callee", "after"])
    return sides.groupBy("incident_id", "caller", "callee").agg(
        F.coalesce(F.max(F.when(~F.col("after"), F.col("p95"))), F.lit(0.0)).alias("pre_p95_ms"),
        F.coalesce(F.max(F.when(F.col("after"), F.col("p95"))), F.lit(0.0)).alias("post_p95_ms"),
        F.coalesce(F.max(F.when(F.col("after"), F.col("n"))), F.lit(0)).alias("post_samples"),
    ).withColumn("shift_ms", F.col("post_p95_ms") - F.col("pre_p95_ms"))


def _explanations(shifts: DataFrame, min_shift_ms: float) -> tuple[DataFrame, DataFrame]:
    """The degraded edges, and per incident the service that explains most of them.

    An edge is explained by X when it enters X, leaves X, or its callee reaches X
    over degraded edges. Reachability is an equi join against the closure of the
    degraded edges, never a product of edges and candidates.
    """
    from faultline.operators.graph import transitive_closure

    degraded = shifts.where((F.col("shift_ms") >= min_shift_ms) & (F.col("post_samples") > 0))
    reach = transitive_closure(degraded.select("incident_id", "caller", "callee"), keep_self=True)
    into = degraded.groupBy("incident_id", F.col("callee").alias("x")).agg(
        F.count(F.lit(1)).alias("inbound"), F.max("shift_ms").alias("_loudest"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("shift_ms")).alias("k"), "caller", "shift_ms"))),
            lambda s: F.concat(s["caller"], F.lit(" +"), _ms(s["shift_ms"]), F.lit("ms"))), ", ").alias("_callers"),
    )
    enters = degraded.select("incident_id", "caller", "callee", "shift_ms", F.col("callee").alias("x"))
    leaves = degraded.select("incident_id", "caller", "callee", "shift_ms", F.col("caller").alias("x"))
    chains = degraded.join(
        reach.select("incident_id", F.col("node").alias("callee"), F.col("reached").alias("x")), ["incident_id", "callee"]
    ).select("incident_id", "caller", "callee", "shift_ms", "x")
    explained = (
        enters.union(leaves).union(chains).distinct()
        .groupBy("incident_id", "x").agg(F.sum("shift_ms").alias("explained_ms"))
    )
    totals = degraded.groupBy("incident_id").agg(F.sum("shift_ms").alias("total_ms"), F.count(F.lit(1)).alias("degraded_edges"))
    callers = shifts.groupBy("incident_id", F.col("callee").alias("x")).agg(F.count(F.lit(1)).alias("all_callers"))
    scored = (
        into.join(explained, ["incident_id", "x"]).join(callers, ["incident_id", "x"]).join(totals, "incident_id")
        .withColumn("explained_ratio", F.round(F.col("explained_ms") / F.col("total_ms"), 9))
        .withColumn("coverage", F.col("inbound") / F.col("all_callers"))
    )
    order = [F.col(c).desc() for c in ("explained_ratio", "coverage", "inbound", "_loudest")] + [F.col("x")]
    return degraded, checkpoint(top_per_group(scored, ["incident_id"], order, 1))


def edge_latency_origin(
    spans: DataFrame, incidents: DataFrame, min_shift_ms: float = 50.0, resolved: DataFrame | None = None
) -> DataFrame:
    """Service that best explains slower call edges, and whether the slowdown is in its code.

    Only the chosen services' server spans are ranked, one service per incident.
    """
    shifts = checkpoint(edge_shifts(resolved if resolved is not None else resolve_callees(spans), incidents))
    _, best = _explanations(shifts, min_shift_ms)
    chosen = best.select("incident_id", F.col("x").alias("service"))
    servers = spans.where(kind_is("server")).join(chosen, ["incident_id", "service"], "left_semi")
    servers = with_onset(servers, incidents).select("incident_id", "service", "duration_ms", (F.col("time") >= F.col("onset_second")).alias("after"))
    own = exact_p95(servers, ["incident_id", "service", "after"]).groupBy("incident_id", F.col("service").alias("x")).agg(
        (F.coalesce(F.max(F.when(F.col("after"), F.col("p95"))), F.lit(0.0))
         - F.coalesce(F.max(F.when(~F.col("after"), F.col("p95"))), F.lit(0.0))).alias("own_shift_ms")
    )
    out = (
        incidents.select("incident_id").join(best, "incident_id", "left").join(own, ["incident_id", "x"], "left")
        .withColumn("own_shift_ms", F.when(F.col("x").isNotNull(), F.coalesce("own_shift_ms", F.lit(0.0))))
    )
    network = F.col("own_shift_ms") < min_shift_ms
    lines = F.when(F.col("x").isNull(), F.array(
        F.lit("no caller->callee edge's client-span p95 shifted enough after onset")
    )).otherwise(F.array(
        F.concat(F.col("inbound").cast("string"), F.lit(" of "), F.col("all_callers").cast("string"),
                 F.lit(" known caller(s) slowed toward "), "x", F.lit(": "), "_callers", F.lit("; "), "x",
                 F.lit(" explains "), _ms(F.col("explained_ratio") * 100), F.lit("% of all edge degradation")),
        F.concat("x", F.lit(" own server-span p95 shifted "), F.format_string("%+.0f", F.bround("own_shift_ms", 0)),
                 F.when(network, F.lit("ms (flat): the delay is on the path into it"))
                 .otherwise(F.lit("ms: the slowdown is inside it"))),
    ))
    return out.select(
        "incident_id", F.col("x").alias("origin_service"),
        F.when(F.col("x").isNull(), F.lit(None)).when(network, F.lit("network_edge"))
        .otherwise(F.lit("service_internal")).alias("classification"),
        "explained_ratio", "coverage", "inbound", "own_shift_ms", "degraded_edges", lines.alias("evidence"),
    )


def edge_roles(
    spans: DataFrame, incidents: DataFrame, min_shift_ms: float = 50.0, resolved: DataFrame | None = None
) -> DataFrame:
    """What every degraded edge is to the origin of its incident: a row each.

    ``role``: ``own_outbound`` leaves the origin, ``into_origin`` enters it,
    ``victim_path`` reaches it over other degraded edges, and ``not_explained`` does
    none of these. The first that holds counts.
    """
    from faultline.operators.graph import transitive_closure

    shifts = checkpoint(edge_shifts(resolved if resolved is not None else resolve_callees(spans), incidents))
    degraded, best = _explanations(shifts, min_shift_ms)
    origin = best.select("incident_id", F.col("x").alias("origin_service"))
    upstream = transitive_closure(
        degraded.select("incident_id", "caller", "callee"), reverse=True, starts=origin.withColumnRenamed("origin_service", "node"), keep_self=True
    ).select("incident_id", F.col("reached").alias("callee"), F.lit(True).alias("_leads")).distinct()
    judged = degraded.join(origin, "incident_id").join(upstream, ["incident_id", "callee"], "left")
    role = (
        F.when(F.col("caller") == F.col("origin_service"), "own_outbound").when(F.col("callee") == F.col("origin_service"), "into_origin")
        .when(F.col("_leads"), "victim_path").otherwise("not_explained"))
    return judged.select("incident_id", "origin_service", "caller", "callee", "shift_ms", role.alias("role"))


def degraded_edges(
    spans: DataFrame, incidents: DataFrame, min_shift_ms: float = 50.0, limit: int = 20, resolved: DataFrame | None = None
) -> DataFrame:
    """The edges whose client p95 rose at least ``min_shift_ms``, loudest first."""
    shifts = edge_shifts(resolved if resolved is not None else resolve_callees(spans), incidents)
    slow = shifts.where((F.col("shift_ms") >= min_shift_ms) & (F.col("post_samples") > 0))
    return top_per_group(slow, ["incident_id"], [F.col("shift_ms").desc(), F.col("caller"), F.col("callee")], limit, "position")


def emission_gaps(spans: DataFrame, incidents: DataFrame, bucket: int = 30, limit: int = 30) -> DataFrame:
    """Stretches without spans from a service that was active before, longest first."""
    active = spans.select("incident_id", "service", F.floor(F.col("time") / bucket).alias("b")).distinct()
    order = Window.partitionBy("incident_id", "service").orderBy("b")
    whole = Window.partitionBy("incident_id", "service")
    seen = active.select("*", F.lead("b").over(order).alias("nxt"), F.count(F.lit(1)).over(whole).alias("_n")).where("_n >= 2")
    bounded = seen.join(incidents.select("incident_id", "window_end"), "incident_id")
    last = F.floor(F.col("window_end") / bucket)
    gaps = bounded.where(
        (F.col("nxt") - F.col("b") > 1) | (F.col("nxt").isNull() & (F.col("b") < last - 1))
    ).select(
        "incident_id", "service", ((F.col("b") + 1) * bucket).alias("gap_start_second"),
        F.coalesce(F.col("nxt") * bucket, F.col("window_end")).alias("gap_end_second"),
        F.col("nxt").isNotNull().alias("resumed"),
    )
    length = (F.col("gap_end_second") - F.col("gap_start_second")).desc()
    return top_per_group(gaps, ["incident_id"], [length, F.col("service"), F.col("gap_start_second")], limit, "position")


def slowest_operations(
    spans: DataFrame, limit: int = 10, start: int | None = None, status: str | None = None
) -> DataFrame:
    picked = search_spans(spans, status=status, start=start).withColumn("span_kind", F.lower("span_kind"))
    keys = ["incident_id", "service", "operation", "span_kind"]
    p95 = exact_p95(picked, keys, name="p95_ms").withColumnRenamed("n", "count")
    rest = picked.groupBy(*keys).agg(F.max("duration_ms").alias("max_ms"), F.min(span_order()).alias("_first"))
    same = F.lit(True)
    renamed = rest.select(*[F.col(k).alias(f"_{k}") for k in keys], "max_ms", "_first")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = p95.join(renamed, same).select(*keys, "count", "p95_ms", "max_ms", "_first")
    return top_per_group(joined, ["incident_id"], [F.col("p95_ms").desc(), F.col("_first")], limit, "position").drop("_first")


# ---- errors -------------------------------------------------------------------------------

def error_summary(spans: DataFrame, start: int | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """Error spans per service and role; client rows name the callee."""
    base = resolved if resolved is not None else resolve_callees(spans)
    picked = search_spans(base, status="ERROR", start=start).where(kind_is("server") | kind_is("client"))
    role = F.lower("span_kind")
    return picked.groupBy(
        "incident_id", "service", role.alias("role"), F.when(role == "client", F.col("callee")).alias("callee")
    ).agg(F.count(F.lit(1)).alias("error_count"), F.min(span_order()).alias("first_seen"))


def resolve_picked(picked: DataFrame, spans: DataFrame) -> DataFrame:
    """:func:`resolve_callees` for a few spans: only their own children are read from ``spans``."""
    asked = picked.select("incident_id", F.col("span_id").alias("parent_span_id")).distinct()
    children = spans.where(kind_is("server")).join(asked, ["incident_id", "parent_span_id"], "left_semi")
    first = children.groupBy("incident_id", F.col("parent_span_id").alias("span_id")).agg(F.min_by("service", span_order()).alias("_child"))
    named = F.col("operation")
    if "rpc_method" in picked.columns:
        named = F.coalesce(F.nullif(F.col("rpc_method"), F.lit("")), named)
    return picked.join(first, ["incident_id", "span_id"], "left").withColumn("callee", F.coalesce("_child", rpc_callee(named))).drop("_child")


def error_origin(spans: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Vote of the deepest error spans without an erroring child: a service or an edge.

    Depths come from climbing from these spans alone, and only the spans that vote have
    their callees looked up.
    """
    errors = store((resolved if resolved is not None else spans).where(is_error()), "errors")
    parents = errors.where(F.col("parent_span_id").isNotNull()).select(
        "incident_id", F.col("parent_span_id").alias("span_id")
    ).distinct()
    frontier = errors.join(parents, ["incident_id", "span_id"], "left_anti")
    covered = frontier.select("incident_id").distinct()
    leaves = store(frontier.unionByName(errors.join(covered, "incident_id", "left_anti")), "leaves")
    deep = leaves.join(paths.leaf_depths(leaves, spans), ["incident_id", "span_id"])
    deepest = deep.groupBy("incident_id").agg(F.max("depth").alias("depth"))
    picked = checkpoint(deep.join(deepest, ["incident_id", "depth"]))
    if resolved is None:
        picked = checkpoint(resolve_picked(picked, spans))
    servers = (
        errors.where(kind_is("server"))
        .select("incident_id", F.col("service").alias("callee"), F.lit(True).alias("_fails")).distinct()
    )
    is_client = kind_is("client")
    voted = (
        picked.withColumn("callee", F.coalesce("callee", F.lit("unknown"))).join(servers, ["incident_id", "callee"], "left")
        .withColumn("_edge", is_client & F.col("_fails").isNull())
        .groupBy(
            "incident_id", "depth",
            F.when(F.col("_edge"), "edge").otherwise("service").alias("classification"),
            F.when(F.col("_edge"), F.lit(None)).when(is_client, F.col("callee")).otherwise(F.col("service")).alias("service"),
            F.when(F.col("_edge"), F.col("service")).alias("caller"),
            F.when(F.col("_edge"), F.col("callee")).alias("callee"),
        )
        .agg(F.count(F.lit(1)).alias("votes"), F.min(span_order()).alias("_first"))
    )
    winner = top_per_group(voted, ["incident_id"], [F.col("votes").desc(), F.col("_first")], 1).drop("_first")
    opening = errors.groupBy("incident_id").agg(F.min("time").alias("first_error_second"))
    example = picked.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("frontier_spans"),
        F.min_by("trace_id", span_order()).alias("trace_id"), F.min_by(F.lower("span_kind"), span_order()).alias("span_kind"),
    )
    everyone = spans.select("incident_id").distinct()
    return (
        everyone.join(winner, "incident_id", "left").join(opening, "incident_id", "left").join(example, "incident_id", "left")
        .withColumn("classification", F.coalesce("classification", F.lit("unknown")))
    )


# ---- single traces and services -----------------------------------------------------------

def span_tree(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Depth-first listing of traces: position, depth and the span's fields; see :func:`paths.tour`."""
    wanted = traces.select("incident_id", "trace_id").distinct()
    picked = spans.join(wanted, ["incident_id", "trace_id"], "left_semi")
    return paths.tour(picked, ["incident_id", "trace_id"]).select(
        "incident_id", "trace_id", "position", "depth", "span_id", "service", "operation",
        F.lower("span_kind").alias("span_kind"), "status", "duration_ms",
    )


def latency_breakdown(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Share of the root duration taken by every span of the listed traces."""
    keys = ["incident_id", "trace_id"]
    picked = spans.join(traces.select(*keys).distinct(), keys, "left_semi")
    ids = picked.select(*keys, F.col("span_id").alias("parent_span_id"))
    roots = picked.join(ids, [*keys, "parent_span_id"], "left_anti").groupBy(*keys).agg(F.max("duration_ms").alias("_root"))
    longest = picked.groupBy(*keys).agg(F.max("duration_ms").alias("_any"))
    root = longest.join(roots, keys, "left").select(*keys, F.coalesce("_root", "_any").alias("root_duration_ms"))
    share = F.when(F.col("root_duration_ms") != 0, F.col("duration_ms") / F.col("root_duration_ms")).otherwise(F.lit(0.0))
    return picked.join(root, keys).select(
        *keys, "span_id", "service", "operation", "duration_ms", "root_duration_ms", share.alias("pct_of_root")
    )


def compare_pre_post(spans: DataFrame, incidents: DataFrame, operation_contains: str) -> DataFrame:
    """First healthy trace before onset and first failing trace after it."""
    picked = with_onset(spans.where(F.col("operation").contains(operation_contains)), incidents)
    healthy = (F.upper("status") == "OK") & (F.col("time") <= F.col("onset_second") - 1)
    failing = is_error() & (F.col("time") >= F.col("onset_second"))
    pairs = picked.groupBy("incident_id").agg(
        F.min_by("trace_id", F.when(healthy, span_order())).alias("healthy_trace_id"),
        F.min_by("trace_id", F.when(failing, span_order())).alias("failing_trace_id"),
    )
    return incidents.select("incident_id").join(pairs, "incident_id", "left").withColumn(
        "note",
        F.when(F.col("healthy_trace_id").isNull(), "no healthy pre-onset trace for that operation")
        .when(F.col("failing_trace_id").isNull(), "no failing post-onset trace for that operation"),
    )


def service_summary(spans: DataFrame) -> DataFrame:
    counts = spans.groupBy("incident_id", "service").agg(
        F.count(F.lit(1)).alias("total_spans"), F.count_if(is_error()).alias("error_spans"),
        F.count_if(is_error() & kind_is("server")).alias("server_error_spans"),
    )
    p95 = exact_p95(spans, ["incident_id", "service"], name="p95_ms").drop("n")
    return counts.join(p95, ["incident_id", "service"]).withColumn(
        "error_rate", F.col("error_spans") / F.col("total_spans")
    )
