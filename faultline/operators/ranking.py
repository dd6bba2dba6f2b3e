"""Root-cause ranking over the service graph and the onset effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.ordered import top_per_group
from faultline.functions.robust import FAMILIES, Z_MIN, family
from faultline.operators.metrics import onset_shifts
from faultline.session import checkpoint

# fixed values: roles that generate or relay load and are seldom the origin
SYNTHETIC_ROLES = ("load-generator", "loadgenerator", "frontend-proxy", "frontendproxy", "frontend-web")
# fixed values: family to fault wording
FAULT_WORDING = {"resource": "resource saturation", "latency": "latency/slowdown", "error": "errors"}
KEYS = ["incident_id", "service"]


def onset_effects(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Largest effect size per service in each family, 0 where a family has no series."""
    shifts = onset_shifts(metrics, incidents).withColumn("family", family())
    return shifts.groupBy(*KEYS).agg(*[
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("family") == f, F.col("effect_z"))), F.lit(0.0))).alias(f"z_{f}")
        for f in FAMILIES])


def effects_long(effects: DataFrame) -> DataFrame:
    """Service effects as (incident_id, service, family, z) rows."""
    wide = effects.select(*KEYS, *[F.col(f"z_{f}").alias(f) for f in FAMILIES])
    return wide.unpivot(KEYS, list(FAMILIES), "family", "z")


def signatures(effects: DataFrame) -> DataFrame:
    return effects.select(*KEYS, *[(F.col(f"z_{f}") >= Z_MIN).alias(f) for f in FAMILIES])


def z_max() -> Column:
    return F.greatest(*[F.col(f"z_{f}") for f in FAMILIES])


def dominant_family() -> Column:
    """The family with the largest effect; ties go resource, latency, error."""
    best = z_max()
    return F.when(F.col("z_resource") == best, "resource").when(F.col("z_latency") == best, "latency").otherwise("error")


def anomalous(effects: DataFrame) -> DataFrame:
    return effects.where(z_max() >= Z_MIN).select(*KEYS)


def _graph_effects(edges: DataFrame, effects: DataFrame) -> DataFrame:
    """One row per service of the graph with its effects and whether it is an entry."""
    ends = edges.select("incident_id", F.explode(F.array(
        F.struct(F.col("caller").alias("service"), F.lit(0).alias("inbound")),
        F.struct(F.col("callee").alias("service"), F.lit(1).alias("inbound")))).alias("e"))
    nodes = ends.groupBy("incident_id", F.col("e.service").alias("service")).agg(F.sum("e.inbound").alias("in_degree"))
    zero = [F.coalesce(f"z_{f}", F.lit(0.0)).alias(f"z_{f}") for f in FAMILIES]
    synthetic = F.col("service").isin(*SYNTHETIC_ROLES)
    return nodes.join(effects, KEYS, "left").select(
        *KEYS, *zero, synthetic.alias("synthetic"), ((F.col("in_degree") == 0) | synthetic).alias("demoted"))


def rank_services(edges: DataFrame, effects: DataFrame) -> DataFrame:
    """Rank of every graph service by the structure its dominant family propagates in.

    resource: own effect size. latency: the centre whose neighbourhood holds most
    of the anomalous effect. error: the deepest failing service, or a callee of it
    that slowed without failing itself. Neighbourhood sums are joins of the
    service edges; a window only ever orders the services of one incident.
    """
    # Service-level tables, small next to the telemetry: stored once, read by every regime.
    edges = checkpoint(edges.select("incident_id", "caller", "callee").distinct())
    nodes = checkpoint(_graph_effects(edges, effects))
    regime = nodes.groupBy("incident_id").agg(
        *[F.max(f"z_{f}").alias(f"m_{f}") for f in FAMILIES]).withColumn("m", F.greatest(*[F.col(f"m_{f}") for f in FAMILIES]))
    regime = regime.select("incident_id", F.when(F.col("m") < Z_MIN, "none").when(F.col("m_resource") == F.col("m"), "resource")
                           .when(F.col("m_latency") == F.col("m"), "latency").otherwise("error").alias("regime"))

    # latency: share of the anomalous effect inside the closed neighbourhood
    slow = nodes.where(F.col("z_latency") >= Z_MIN).select(*KEYS, F.col("z_latency").alias("_mass"))
    both_ways = edges.select("incident_id", F.col("caller").alias("service"), F.col("callee").alias("near")).union(
        edges.select("incident_id", F.col("callee").alias("service"), F.col("caller").alias("near")))
    itself = slow.select("incident_id", "service", F.col("service").alias("near"))
    hood = both_ways.union(itself).distinct().join(slow.select(*KEYS), KEYS, "left_semi")
    masses = slow.select("incident_id", F.col("service").alias("near"), "_mass")
    covered = hood.join(masses, ["incident_id", "near"]).groupBy(*KEYS).agg(F.sum("_mass").alias("_near"))
    whole = slow.groupBy("incident_id").agg(F.sum("_mass").alias("_all"))
    coverage = covered.join(whole, "incident_id").select(
        *KEYS, F.round(F.col("_near") / F.when(F.col("_all") == 0, 1.0).otherwise(F.col("_all")), 9).alias("coverage"))
    best = coverage.groupBy("incident_id").agg(F.max("coverage").alias("best_coverage"))

    # error: does an anomalous service call another one
    failing = nodes.where(F.col("z_error") >= Z_MIN).select(*KEYS)
    blames = edges.join(failing.select("incident_id", F.col("service").alias("callee")), ["incident_id", "callee"], "left_semi")
    blames = blames.select("incident_id", F.col("caller").alias("service"), F.lit(True).alias("blames_callee")).distinct()

    scored = (
        nodes.join(regime, "incident_id").join(coverage, KEYS, "left").join(best, "incident_id", "left").join(blames, KEYS, "left")
        .withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
        .withColumn("blames_callee", F.coalesce("blames_callee", F.lit(False))))

    def when(regime: str, value: Column) -> Column:
        return F.when(F.col("regime") == regime, value.cast("double"))

    def flag(c: Column) -> Column:
        return c.cast("int")

    total = -F.round(z_max(), 9)
    quiet = F.col("z_latency") < Z_MIN
    calm = F.col("z_error") < Z_MIN
    near_best = F.col("coverage") >= F.col("best_coverage") - 0.05
    levels = [
        F.coalesce(when("none", total), when("resource", -F.round("z_resource", 9)), when("latency", flag(quiet)), when("error", flag(calm))),
        F.coalesce(when("none", flag(F.col("demoted"))), when("resource", flag(F.col("synthetic"))),
                   when("latency", flag(~F.coalesce(near_best, F.lit(True)))), when("error", flag(calm | F.col("blames_callee")))),
        F.coalesce(when("resource", total), when("latency", flag(F.col("demoted"))), when("error", flag(F.col("demoted"))), F.lit(0.0)),
        F.coalesce(when("latency", -F.col("coverage")), when("error", -F.round("z_error", 9)), F.lit(0.0)),
        F.coalesce(when("latency", total), F.lit(0.0)),
    ]
    by_rank = Window.partitionBy("incident_id").orderBy(*levels, "service")
    ordered = checkpoint(scored.withColumn("_r", F.row_number().over(by_rank)))

    # error: one hop down to a callee that slowed but did not fail
    deepest = ordered.where((F.col("regime") == "error") & (F.col("_r") == 1) & ~calm)
    transit = F.greatest("z_latency", "z_resource")
    below = deepest.select("incident_id", F.col("service").alias("caller")).join(edges, ["incident_id", "caller"]).select(
        "incident_id", F.col("callee").alias("service"))
    moved = below.join(nodes, KEYS).where((transit >= Z_MIN) & calm)
    origin = moved.groupBy("incident_id").agg(
        F.min_by("service", F.struct((-F.round(transit, 9)).alias("z"), "service")).alias("_origin"))
    final = ordered.join(origin, "incident_id", "left")
    lifted = F.coalesce(F.col("service") == F.col("_origin"), F.lit(False))
    place = Window.partitionBy("incident_id").orderBy(F.when(lifted, 0).otherwise(1), "_r")
    return final.select(
        *KEYS, F.row_number().over(place).alias("rank"), "regime", *[f"z_{f}" for f in FAMILIES],
        F.round("coverage", 9).alias("coverage"), "demoted", (z_max() >= Z_MIN).alias("anomalous"))


def localise(ranked: DataFrame) -> DataFrame:
    """Root service, top five, fault wording, evidence and victims, one row per incident."""
    ranked = checkpoint(ranked)
    root = ranked.where(F.col("rank") == 1)
    sized = ranked.withColumn("z", z_max())
    per = sized.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("services"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "service")))), lambda s: s["service"]).alias("ranked_services"),
        F.max(F.when(F.col("rank") == 2, F.col("z"))).alias("_next"))
    others = top_per_group(sized.where(F.col("anomalous") & (F.col("rank") > 1)), ["incident_id"], [F.col("service")], 3, "_v")
    text = F.concat("service", F.lit(" (z="), F.format_string("%.0f", F.bround("z", 0)), F.lit(")"))
    victims = others.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_v", text.alias("t"), "service"))), lambda s: s["t"]).alias("_victims"))
    wording = F.create_map(*[x for k, v in FAULT_WORDING.items() for x in (F.lit(k), F.lit(v))])
    joined = root.join(per, "incident_id").join(victims, "incident_id", "left").withColumn("z", z_max())
    signature = F.when(F.col("z") > 0, dominant_family())
    shown = F.format_string("%.0f", F.bround("z", 0))
    # fixed values: the wording of the evidence
    head = F.concat("service", F.lit(" shows a "), F.coalesce(signature, F.lit("anomalous")), F.lit(" step at onset (z="), shown,
                    F.lit("); ranked #1 of "), F.col("services").cast("string"), F.lit(" live services by effect size"))
    tail = F.concat(F.lit("downstream victims inheriting the symptom: "), F.array_join("_victims", ", "))
    evidence = F.when(F.col("_victims").isNull(), F.array(head)).otherwise(F.array(head, tail))
    return joined.select(
        "incident_id", F.col("service").alias("root_cause_service"), signature.alias("signature"),
        F.try_element_at(wording, signature).alias("fault_type"), F.round("z", 6).alias("effect_z"),
        F.round(F.col("z") - F.coalesce("_next", F.lit(0.0)), 6).alias("rank_margin"), "regime",
        F.array_join("ranked_services", ",").alias("ranked_services"), F.array_join(evidence, "; ").alias("evidence"))


def reconcile_verdicts(verdicts: DataFrame, effects: DataFrame) -> DataFrame:
    """Verdicts on candidates that measurably stepped follow the measurement.

    ``verdicts``: incident_id, candidate_service, supported, signature.
    """
    sized = effects.select("incident_id", F.col("service").alias("candidate_service"), *[f"z_{f}" for f in FAMILIES])
    joined = verdicts.join(sized, ["incident_id", "candidate_service"], "left")
    stepped = F.coalesce(z_max() >= Z_MIN, F.lit(False))
    observed = [F.when(stepped, F.col(f"z_{f}") >= Z_MIN).alias(f"observed_{f}") for f in FAMILIES]
    return joined.select(
        *[c for c in verdicts.columns if c not in ("supported", "signature")],
        F.when(stepped, True).otherwise(F.col("supported")).alias("supported"),
        F.when(stepped, dominant_family()).otherwise(F.col("signature")).alias("signature"),
        F.when(stepped | F.col("supported"), F.col("candidate_service")).alias("root_cause_service"), *observed)


def missed_origins(ranked: DataFrame, planned: DataFrame) -> DataFrame:
    """Top three anomalous services that no planned hypothesis covers."""
    known = planned.select("incident_id", F.col("candidate_service").alias("service")).distinct()
    return ranked.where((F.col("rank") <= 3) & F.col("anomalous")).join(known, KEYS, "left_anti").select(
        *KEYS, "rank", dominant_family().alias("signature"))


def final_pick(ranked: DataFrame, verdicts: DataFrame, limit: int = 5) -> DataFrame:
    """Ranked services without the refuted quiet ones; all of them if none is left."""
    refuted = verdicts.where(~F.col("supported")).select(
        "incident_id", F.col("candidate_service").alias("service"), F.lit(True).alias("_ref")).distinct()
    marked = ranked.join(refuted, KEYS, "left").withColumn("_out", F.col("_ref").isNotNull() & ~F.col("anomalous"))
    left = marked.groupBy("incident_id").agg(F.min("_out").alias("_none_left"))
    kept = marked.join(left, "incident_id").where(~F.col("_out") | F.col("_none_left"))
    top = top_per_group(kept, ["incident_id"], [F.col("rank")], limit, "final_rank")
    wording = F.create_map(*[x for k, v in FAULT_WORDING.items() for x in (F.lit(k), F.lit(v))])
    return top.select(*KEYS, "final_rank", F.when(F.col("anomalous"), F.try_element_at(wording, dominant_family())).alias("fault_type"))
