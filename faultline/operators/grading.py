"""Grading of diagnoses, reliability and run analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.expr import tokens
from faultline.operators import paths

DIMENSIONS = ["location_correct", "culprit_correct", "decoys_ruled_out", "type_match"]


def type_match(reported: str | Column, truth: str | Column) -> Column:
    """All but one of the truth's words, and at least one, occur in the reported type."""
    want = tokens(truth)
    shared = F.size(F.array_intersect(tokens(reported), want))
    return (F.size(tokens(reported)) > 0) & (shared >= F.greatest(F.lit(1), F.size(want) - 1))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def grade_reports(truth: DataFrame, reports: DataFrame) -> DataFrame:
    """Every graded dimension per incident; an incident without a report fails all.

    ``truth``: incident_id, kind, type, service, caller, callee, culprit_change_id,
    decoy_change_ids, accepted_services. ``reports``: incident_id, kind, type,
    service, caller, callee, culprit_change_id, ruled_out_change_ids.
    """
    mine = reports.select("incident_id", *[F.col(c).alias(f"r_{c}") for c in reports.columns if c != "incident_id"],
                          F.lit(True).alias("_sent"))
    joined = truth.join(mine, "incident_id", "left")
    kind_ok = F.col("r_kind") == F.col("kind")
    listed = F.coalesce(F.size("accepted_services"), F.lit(0)) > 0
    accepted = F.when(listed, F.col("accepted_services")).otherwise(F.array("service"))
    by_service = kind_ok & F.array_contains(accepted, F.col("r_service"))
    by_edge = listed & (F.col("r_kind") == "edge") & F.array_contains("accepted_services", F.col("r_caller")) & F.array_contains(
        "accepted_services", F.col("r_callee"))
    location = (
        F.when(F.col("kind") == "service", _flag(by_service) | _flag(by_edge))
        .when(F.col("kind") == "edge", kind_ok & (F.col("r_caller") == F.col("caller")) & (F.col("r_callee") == F.col("callee")))
        .otherwise(kind_ok))
    sent = F.col("_sent").isNotNull()
    ruled = F.coalesce("r_ruled_out_change_ids", F.array().cast("array<string>"))
    graded = joined.select(
        "incident_id", (sent & _flag(location)).alias("location_correct"),
        (sent & F.col("r_culprit_change_id").eqNullSafe(F.col("culprit_change_id"))).alias("culprit_correct"),
        (sent & (F.size(F.array_except("decoy_change_ids", ruled)) == 0)).alias("decoys_ruled_out"),
        (sent & type_match("r_type", "type")).alias("type_match"), (~sent).alias("missing_report"))
    return graded.withColumn("correct", F.col("location_correct") & F.col("culprit_correct"))


def grade_localisation(truth: DataFrame, reports: DataFrame) -> DataFrame:
    """Location-only grade with the indicator looked up in the evidence text.

    ``truth``: incident_id, service, type, accepted_services, indicator.
    ``reports``: incident_id, kind, type, service, caller, callee, evidence.
    """
    mine = reports.select("incident_id", *[F.col(c).alias(f"r_{c}") for c in reports.columns if c != "incident_id"],
                          F.lit(True).alias("_sent"))
    joined = truth.join(mine, "incident_id", "left")
    listed = F.coalesce(F.size("accepted_services"), F.lit(0)) > 0
    accepted = F.when(listed, F.col("accepted_services")).otherwise(F.array("service"))
    hit = _flag(F.array_contains(accepted, F.col("r_service"))) | _flag(
        (F.col("r_kind") == "edge") & F.array_contains(accepted, F.col("r_caller")) & F.array_contains(accepted, F.col("r_callee")))
    sent = F.col("_sent").isNotNull()
    named = F.array_join("r_evidence", " ").contains(F.col("indicator"))
    return joined.select(
        "incident_id", (sent & hit).alias("location_correct"), (sent & type_match("r_type", "type")).alias("type_match"),
        (sent & _flag(named) & (F.coalesce("indicator", F.lit("")) != "")).alias("indicator_correct"))


def scenario_reliability(runs: DataFrame) -> DataFrame:
    """Passes per scenario; flaky means some but not all runs pass."""
    passes = F.count_if(_flag(F.col("correct")))
    n = F.count(F.lit(1))
    return runs.groupBy("scenario_id").agg(
        n.alias("runs"), passes.alias("passes"), *[F.count_if(_flag(F.col(d))).alias(f"{d}_passes") for d in DIMENSIONS],
        (passes / n).alias("pass_rate"), (passes > 0).alias("passed_any"), (passes == n).alias("passed_all"),
        ((passes > 0) & (passes < n)).alias("flaky"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"),
        F.sum(F.coalesce("calls", F.lit(0))).alias("total_calls"))


def suite_reliability(runs: DataFrame) -> DataFrame:
    """pass@k, pass^k, per-run accuracy, dimension rates and mean cost, one row."""
    per = scenario_reliability(runs)
    total = F.sum("runs")
    return per.agg(
        F.count(F.lit(1)).alias("scenarios"), total.alias("total_runs"), F.sum("passes").alias("total_passes"),
        (F.sum("passes") / total).alias("micro_pass_rate"), (F.count_if("passed_any") / F.count(F.lit(1))).alias("pass_at_k"),
        (F.count_if("passed_all") / F.count(F.lit(1))).alias("pass_hat_k"),
        *[(F.sum(f"{d}_passes") / total).alias(f"{d}_rate") for d in DIMENSIONS],
        (F.sum("total_cost") / total).alias("mean_cost"), (F.sum("total_calls") / total).alias("mean_calls"))


def scorecard(grades: DataFrame) -> DataFrame:
    """Hits and accuracy overall and by system, fault and category in one pass.

    ``grades``: system, fault, category, correct.
    """
    rows = grades.groupingSets([[], ["system"], ["fault"], ["category"]], "system", "fault", "category").agg(
        F.grouping_id("system", "fault", "category").alias("_g"), F.count(F.lit(1)).alias("n"),
        F.count_if(_flag(F.col("correct"))).alias("hits"))
    level = F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 3, "system").when(F.col("_g") == 5, "fault").otherwise("category")
    name = F.when(F.col("_g") == 7, "all").otherwise(F.coalesce("system", "fault", "category"))
    return rows.select(level.alias("level"), name.alias("name"), "n", "hits", (F.col("hits") / F.col("n")).alias("ac1"))


def ranked_accuracy(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """AC@k for each k and Avg@k over the best rank of an accepted service.

    ``ranked``: incident_id, service, rank. ``truth``: incident_id, accepted_services.
    """
    accepted = truth.select("incident_id", F.explode("accepted_services").alias("service"))
    best = ranked.join(accepted, ["incident_id", "service"]).groupBy("incident_id").agg(F.min("rank").alias("best_rank"))
    joined = truth.select("incident_id").distinct().join(best, "incident_id", "left")
    top = max(ks)
    hit = lambda k: F.avg(F.when(F.col("best_rank") <= k, 1.0).otherwise(0.0))
    average = sum((hit(k) for k in range(2, top + 1)), hit(1)) / top
    return joined.agg(F.count(F.lit(1)).alias("incidents"), *[hit(k).alias(f"ac_at_{k}") for k in ks], average.alias(f"avg_at_{top}"))


TOKEN_KINDS = ["input", "output", "cache_read", "cache_write"]


def run_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """USD per run from token counts by role and per-million prices.

    ``usage``: run_id, role and the four token kinds; ``prices``: role, kind, per_million.
    """
    long = usage.unpivot(["run_id", "role"], TOKEN_KINDS, "kind", "tokens")
    return long.join(prices, ["role", "kind"]).groupBy("run_id").agg(
        (F.sum(F.coalesce("tokens", F.lit(0)) * F.col("per_million")) / 1e6).alias("cost_usd"))


def tool_call_counts(calls: DataFrame) -> DataFrame:
    """Calls, errors and denials per run, role and tool. ``calls``: run_id, role, tool, error, denied."""
    return calls.groupBy("run_id", "role", "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(_flag(F.col("error"))).alias("errors"),
        F.count_if(_flag(F.col("denied"))).alias("denials"))


def run_scorecards(runs: DataFrame, calls: DataFrame, query_log: DataFrame, costs: DataFrame) -> DataFrame:
    """Speed, cost, backend and reliability of each run.

    ``runs``: run_id, scenario_id, wall_s, iterations, stop, subagents, retries, hydration_pages, hydrated_spans.
    ``query_log``: run_id, ms, cached, rows.
    """
    tools = calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tool_calls"), F.count_if(F.col("role") == "manager").alias("manager_calls"),
        F.count_if(F.col("role") == "worker").alias("worker_calls"), F.count_if(_flag(F.col("error"))).alias("tool_errors"),
        F.count_if(_flag(F.col("denied"))).alias("hook_denials"))
    backend = query_log.groupBy("run_id").agg(
        F.count_if(~_flag(F.col("cached"))).alias("backend_queries"), F.count_if(_flag(F.col("cached"))).alias("cache_hits"),
        F.sum("rows").alias("rows_read"), F.sum("ms").alias("query_ms"))
    joined = runs.join(tools, "run_id", "left").join(backend, "run_id", "left").join(costs, "run_id", "left")
    zero = ["tool_calls", "manager_calls", "worker_calls", "tool_errors", "hook_denials", "backend_queries", "cache_hits", "rows_read"]
    return joined.na.fill(0, zero).withColumn("completed", F.col("stop") == "reported").withColumn(
        "wall_s", F.round("wall_s", 1)).withColumn("cost_usd", F.round("cost_usd", 4))


def run_tree(records: DataFrame) -> DataFrame:
    """Agents of each run with parent, depth and record counts; a crash is told from a wrong answer.

    ``records``: run_id, agent_id, parent_id, seq, kind, traceback.
    """
    crashed = F.col("traceback").isNotNull() | (F.col("kind") == "harness_fail")
    agents = records.groupBy("run_id", "agent_id").agg(
        F.max("parent_id").alias("parent_id"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("records"),
        F.count_if(crashed).alias("failures"))
    nodes = agents.select(F.col("run_id").alias("incident_id"), F.col("agent_id").alias("span_id"), F.col("parent_id").alias("parent_span_id"))
    depths = paths.span_depths(nodes).select(F.col("incident_id").alias("run_id"), F.col("span_id").alias("agent_id"), "depth")
    return agents.join(depths, ["run_id", "agent_id"])
