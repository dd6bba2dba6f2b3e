"""Service graph operators over distinct call edges (incident_id, caller, callee)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.expr import is_error, kind_is
from faultline.operators.spans import call_edges, with_onset
from faultline.session import checkpoint


def transitive_closure(
    edges: DataFrame, reverse: bool = False, starts: DataFrame | None = None, keep_self: bool = False
) -> DataFrame:
    """(incident_id, node, reached) over one or more hops, by semi-naive rounds.

    Only the pairs found in the last round are extended, and a round ends the loop
    when it finds none. ``starts`` (incident_id, node) narrows the sources.
    """
    src, dst = ("callee", "caller") if reverse else ("caller", "callee")
    links = checkpoint(edges.select("incident_id", F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    frontier = links.select("incident_id", F.col("src").alias("node"), F.col("dst").alias("reached"))
    if starts is not None:
        frontier = frontier.join(starts.select("incident_id", "node").distinct(), ["incident_id", "node"], "left_semi")
    frontier = checkpoint(frontier)
    seen = frontier  # grows as a union of stored rounds; none is written twice
    while not frontier.isEmpty():
        step = frontier.join(
            links.select("incident_id", F.col("src").alias("reached"), "dst"), ["incident_id", "reached"]
        ).select("incident_id", "node", F.col("dst").alias("reached")).distinct()
        frontier = checkpoint(step.join(seen, ["incident_id", "node", "reached"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen if keep_self else seen.where(F.col("node") != F.col("reached"))


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(incident_id, source, target, path): the least of the shortest paths by name order."""
    links = checkpoint(edges.select("incident_id", "caller", "callee").distinct())
    frontier = checkpoint(sources.select(
        "incident_id", F.col("source"), F.col("source").alias("target"), F.array("source").alias("path")
    ).distinct())
    seen = frontier
    while not frontier.isEmpty():
        hop = links.select("incident_id", F.col("caller").alias("target"), F.col("callee").alias("_to"))
        step = (
            frontier.join(hop, ["incident_id", "target"])
            .select("incident_id", "source", F.col("_to").alias("target"), F.concat("path", F.array("_to")).alias("path"))
            .groupBy("incident_id", "source", "target").agg(F.min("path").alias("path"))
        )
        frontier = checkpoint(step.join(seen, ["incident_id", "source", "target"], "left_anti"))
        seen = checkpoint(seen.unionByName(frontier)) if not frontier.isEmpty() else seen
    return seen


def dependencies(edges: DataFrame, services: DataFrame) -> DataFrame:
    """Direct callers and callees of each listed (incident_id, service)."""
    callers = edges.groupBy("incident_id", F.col("callee").alias("service")).agg(
        F.sort_array(F.collect_set("caller")).alias("callers"))
    callees = edges.groupBy("incident_id", F.col("caller").alias("service")).agg(
        F.sort_array(F.collect_set("callee")).alias("callees"))
    none = F.array().cast("array<string>")
    both = callers.join(callees, ["incident_id", "service"], "full_outer")
    return services.select("incident_id", "service").join(both, ["incident_id", "service"], "left").select(
        "incident_id", "service", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def blast_radius(edges: DataFrame, services: DataFrame) -> DataFrame:
    """Everything each listed service can affect (upstream) or be affected by (downstream)."""
    starts = services.select("incident_id", F.col("service").alias("node"))

    def side(reverse: bool, name: str) -> DataFrame:
        reach = transitive_closure(edges, reverse=reverse, starts=starts)
        return reach.groupBy("incident_id", F.col("node").alias("service")).agg(
            F.sort_array(F.collect_set("reached")).alias(name))

    none = F.array().cast("array<string>")
    keys = ["incident_id", "service"]
    return (
        services.select(*keys).join(side(True, "upstream"), keys, "left").join(side(False, "downstream"), keys, "left")
        .select(*keys, F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream"))
    )


def critical_path(edges: DataFrame, targets: DataFrame, source: str = "frontend") -> DataFrame:
    """Call chain from ``source`` to each listed (incident_id, target)."""
    starts = targets.select("incident_id", F.lit(source).alias("source")).distinct()
    paths = shortest_paths(edges, starts)
    none = F.array().cast("array<string>")
    return (
        targets.select("incident_id", "target", F.lit(source).alias("source"))
        .join(paths, ["incident_id", "source", "target"], "left")
        .select("incident_id", "source", "target", F.coalesce("path", none).alias("path"),
                F.col("path").isNotNull().alias("found"))
    )


def propagation_origin(spans: DataFrame) -> DataFrame:
    """Where the error edges end: a service fault there, or an edge fault on the last hop."""
    errors = checkpoint(call_edges(spans, error_only=True))
    callers = errors.select("incident_id", F.col("caller").alias("service")).distinct()
    callees = errors.select("incident_id", F.col("callee").alias("service")).distinct()
    ends = callees.join(callers, ["incident_id", "service"], "left_anti").groupBy("incident_id").agg(
        F.min("service").alias("_end"))
    anyend = callees.groupBy("incident_id").agg(F.min("service").alias("_any"))
    entry = callers.join(callees, ["incident_id", "service"], "left_anti").groupBy("incident_id").agg(
        F.min("service").alias("source"))
    picked = anyend.join(ends, "incident_id", "left").join(entry, "incident_id", "left").select(
        "incident_id", F.coalesce("_end", "_any").alias("target"), "source")
    paths = shortest_paths(errors, entry)
    failing = (
        spans.where(is_error() & kind_is("server")).select("incident_id", F.col("service").alias("target"),
                                                           F.lit(True).alias("_fails")).distinct()
    )
    found = picked.join(paths, ["incident_id", "source", "target"], "left").join(failing, ["incident_id", "target"], "left")
    own = F.coalesce("_fails", F.lit(False))
    none = F.array().cast("array<string>")
    out = found.select(
        "incident_id", F.when(own, "service").otherwise("edge").alias("classification"),
        F.when(own, F.col("target")).alias("origin_service"), F.col("target").alias("terminal"),
        F.when(F.col("source").isNull(), F.array("target")).otherwise(F.coalesce("path", none)).alias("path"),
        own.alias("terminal_has_server_error"),
    )
    return (
        spans.select("incident_id").distinct().join(out, "incident_id", "left")
        .withColumn("classification", F.coalesce("classification", F.lit("unknown")))
        .withColumn("path", F.coalesce("path", none))
        .withColumn("terminal_has_server_error", F.coalesce("terminal_has_server_error", F.lit(False)))
    )


def new_error_edges(spans: DataFrame, incidents: DataFrame) -> DataFrame:
    """Edges that fail at or after onset and never before."""
    onset = F.col("onset_second")
    staged = with_onset(spans, incidents)
    return call_edges(staged, error_only=True, since=onset).subtract(
        call_edges(staged, error_only=True, before=onset))


def resolve_topology(static_edges: DataFrame, trace_edges: DataFrame, prefer_trace: bool = False) -> DataFrame:
    """Edges of the preferred source that has any for the incident, with the source name."""
    first, second = ("trace", "static") if prefer_trace else ("static", "trace")
    named = static_edges.select("incident_id", "caller", "callee", F.lit("static").alias("source")).unionByName(
        trace_edges.select("incident_id", "caller", "callee", F.lit("trace").alias("source")))
    chosen = named.groupBy("incident_id").agg(
        F.when(F.max(F.col("source") == first), F.lit(first)).otherwise(F.lit(second)).alias("source"))
    return named.join(chosen, ["incident_id", "source"]).distinct()
