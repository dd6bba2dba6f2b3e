"""Trace operators on hand-built spans with known answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions.expr import rpc_callee
from faultline.operators import graph, paths, spans

ONSET = 1000


def test_rpc_callee_parsing(spark):
    cases = {"oteldemo.PaymentService/Charge": "payment", "pkg.v1.ProductCatalogService/List": "product-catalog", "GET": None,
             "a.b/c": None, "Service/x": None, "x.cartservice/Get": "cart", "AdService.v2/Get": "ad"}
    df = spark.createDataFrame([(k,) for k in cases], "op string").select("op", rpc_callee("op").alias("c"))
    assert {r.op: r.c for r in df.collect()} == cases


def test_first_server_child_names_the_callee(make_spans):
    df = make_spans([
        ("a", None, 1, "web", "client", 1, "OK", "x.OtherService/Y"), ("b", "a", 5, "late", "server", 1, "OK", "op"),
        ("c", "a", 2, "early", "SERVER", 1, "OK", "op"), ("d", "a", 0, "web", "internal", 1, "OK", "op")])
    assert spans.resolve_callees(df).where("span_id = 'a'").first().callee == "early"


def test_duplicates_do_not_change_the_edges(make_spans):
    df = make_spans([("a", None, 1, "web", "client", 1, "OK", "op"), ("b", "a", 2, "cart", "server", 1, "OK", "op")])
    doubled = spans.dedup_spans(df.union(df).union(df))
    assert doubled.count() == 2
    assert [(r.caller, r.callee) for r in spans.call_edges(doubled).collect()] == [("web", "cart")]


def edge_case(make_spans, calls):
    """calls: (caller, callee or None for a server span, before, after)."""
    rows, n = [], 0
    for rep in range(10):
        for t, side in ((rep, 2), (ONSET + rep, 3)):
            for call in calls:
                n += 1
                caller, callee, ms = call[0], call[1], call[side]
                op = f"x.{callee.capitalize()}Service/Do" if callee else "op"
                rows.append((f"s{n}", None, t, caller, "client" if callee else "server", ms, "OK", op))
    return make_spans(rows)


NETWORK = [("frontend", "mid", 20, 420), ("frontend", "leaf", 5, 205), ("mid", "leaf", 5, 205), ("mid", None, 15, 415), ("leaf", None, 2, 2)]


def test_network_fault_goes_to_the_common_callee(make_spans, one_incident):
    df = edge_case(make_spans, NETWORK)
    got = spans.edge_latency_origin(df, one_incident(ONSET)).first()
    assert (got.origin_service, got.classification, got.inbound) == ("leaf", "network_edge", 2)
    assert any("2 of 2 known caller(s) slowed toward leaf" in line for line in got.evidence)
    top = spans.degraded_edges(df, one_incident(ONSET)).where("position = 1").first()
    assert (top.caller, top.callee, top.shift_ms) == ("frontend", "mid", 400.0)


def test_own_slow_spans_make_it_internal(make_spans, one_incident):
    calls = [*NETWORK[:-1], ("leaf", None, 2, 302)]
    got = spans.edge_latency_origin(edge_case(make_spans, calls), one_incident(ONSET)).first()
    assert (got.origin_service, got.classification) == ("leaf", "service_internal")


def test_a_healthy_caller_clears_the_leaf(make_spans, one_incident):
    calls = [("frontend", "mid", 20, 420), ("frontend", "leaf", 5, 5), ("mid", "leaf", 5, 205), ("mid", None, 15, 15), ("leaf", None, 2, 2)]
    assert spans.edge_latency_origin(edge_case(make_spans, calls), one_incident(ONSET)).first().origin_service == "mid"


def test_quiet_edges_name_nobody(make_spans, one_incident):
    got = spans.edge_latency_origin(edge_case(make_spans, [("frontend", "mid", 20, 30), ("mid", None, 5, 5)]), one_incident(ONSET)).first()
    assert got.origin_service is None and got.evidence


def test_self_time_ignores_waiting_callers(make_spans, one_incident):
    rows = []
    for i in range(8):
        for t, slow in ((i, 10), (ONSET + i, 400)):
            rows += [(f"r{t}", None, t, "web", "server", slow + 60, "OK", "op"), (f"c{t}", f"r{t}", t, "db", "server", slow, "OK", "op")]
    got = spans.latency_origin(make_spans(rows), one_incident(ONSET)).first()
    assert (got.service, got.self_latency_p95_ms, got.baseline_p95_ms) == ("db", 400.0, 0.0)


def test_load_source_is_reported_not_ranked(make_spans, one_incident):
    rows = [(f"s{i}", None, i, "web", "server", 60, "OK", "op") for i in (1, ONSET + 1)]
    rows += [("l0", None, 2, "loadgen", "client", 60, "OK", "op"), ("l1", None, ONSET + 2, "loadgen", "client", 900, "OK", "op")]
    got = spans.latency_origin(make_spans(rows), one_incident(ONSET)).first()
    assert got.service is None and "loadgen" in got.evidence[1]


def test_emission_gaps(make_spans, one_incident):
    active = [("s%d" % t, None, t, "cart", "server", 1, "OK", "op") for t in (0, 30, 60, 200, 240)] + [("z", None, 5, "once", "server", 1, "OK", "op")]
    got = {(r.gap_start_second, r.gap_end_second, r.resumed) for r in spans.emission_gaps(make_spans(active), one_incident(ONSET, end=600)).collect()}
    assert got == {(90, 180, True), (210, 240, True), (270, 600, False)}


def test_depth_crosses_traces_and_survives_cycles(make_spans):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, i, "a", "server", 1, "OK", "op") for i in range(12)]
    ring = [("x", "z", 0, "a", "server", 1, "OK", "op"), ("y", "x", 0, "a", "server", 1, "OK", "op"), ("z", "y", 0, "a", "server", 1, "OK", "op")]
    tail = [("t1", "x", 0, "a", "server", 1, "OK", "op"), ("t2", "t1", 0, "a", "server", 1, "OK", "op"), ("self", "self", 0, "a", "server", 1, "OK", "op"),
            ("lost", "gone", 0, "a", "server", 1, "OK", "op")]
    df = make_spans(chain + ring + tail).withColumn("trace_id", F.concat(F.lit("t"), F.substring("span_id", -1, 1)))
    got = {r.span_id: r.depth for r in paths.span_depths(df).collect()}
    want = {f"n{i}": i for i in range(12)} | {"x": 3, "y": 3, "z": 3, "t1": 4, "t2": 5, "self": 1, "lost": 0}
    assert got == want


def test_error_origin_votes(make_spans):
    server = [("a", None, 0, "web", "server", 1, "ERROR", "op"), ("b", "a", 1, "web", "client", 1, "ERROR", "op"), ("c", "b", 2, "pay", "server", 1, "error", "op")]
    got = spans.error_origin(make_spans(server)).first()
    assert (got.classification, got.service, got.depth, got.first_error_second) == ("service", "pay", 2, 0)
    edge = [("a", None, 0, "web", "server", 1, "ERROR", "op"), ("b", "a", 1, "web", "client", 1, "ERROR", "x.PayService/Go")]
    got = spans.error_origin(make_spans(edge)).first()
    assert (got.classification, got.caller, got.callee) == ("edge", "web", "pay")
    assert spans.error_origin(make_spans([("a", None, 0, "web", "server", 1, "OK", "op")])).first().classification == "unknown"
    loop = [("a", "b", 0, "web", "server", 1, "ERROR", "op"), ("b", "a", 1, "web", "server", 1, "ERROR", "op")]
    assert spans.error_origin(make_spans(loop)).first().service == "web"


def test_span_tree_is_depth_first(spark, make_spans):
    df = make_spans([("r", None, 0, "a", "server", 9, "OK", "r"), ("k2", "r", 2, "a", "server", 1, "OK", "k2"), ("k1", "r", 1, "a", "server", 5, "OK", "k1"),
                     ("g", "k1", 3, "a", "server", 1, "OK", "g"), ("o", "gone", 5, "a", "server", 1, "OK", "o")])
    ids = spark.createDataFrame([("i", "t")], "incident_id string, trace_id string")
    got = [(r.operation, r.depth) for r in spans.span_tree(df, ids).orderBy("position").collect()]
    assert got == [("r", 0), ("k1", 1), ("g", 2), ("k2", 1), ("o", 0)]


def test_partitioning_and_order_do_not_matter(spark, make_spans, one_incident):
    df = edge_case(make_spans, NETWORK)
    answers = {tuple(spans.edge_latency_origin(d, one_incident(ONSET)).drop("evidence").first())
               for d in (df.coalesce(1), df.repartition(8), df.orderBy(F.desc("span_id")))}
    assert len(answers) == 1


@pytest.fixture
def edges(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b"), ("q", "q")]
    return spark.createDataFrame([("i", *p) for p in pairs], "incident_id string, caller string, callee string")


def test_closure_handles_cycles(edges):
    got = {}
    for r in graph.transitive_closure(edges).collect():
        got.setdefault(r.node, set()).add(r.reached)
    assert got == {"a": set("bcde"), "b": set("de"), "c": set("bde"), "d": set("be"), "e": set("bd")}


def test_shortest_path_is_least_by_name(spark, edges):
    targets = spark.createDataFrame([("i", "e"), ("i", "nowhere")], "incident_id string, target string")
    got = {r.target: (r.path, r.found) for r in graph.critical_path(edges, targets, source="a").collect()}
    assert got == {"e": (["a", "b", "d", "e"], True), "nowhere": ([], False)}


def test_leaf_depths_agree_with_the_depths_of_all_spans(spark, make_spans):
    chain = [(f"d{i}", f"d{i - 1}" if i else None, i, "web", "server", 1, "OK", "op") for i in range(40)]
    ring = [(f"r{i}", f"r{(i + 1) % 3}", i, "web", "server", 1, "OK", "op") for i in range(3)] + [("tail", "r0", 9, "web", "server", 1, "OK", "op")]
    few = [("top", None, 0, "web", "server", 1, "OK", "op"), ("mid", "top", 1, "web", "server", 1, "OK", "op"), ("low", "mid", 2, "web", "server", 1, "OK", "op"),
           ("lost", "nowhere", 3, "web", "server", 1, "OK", "op")]
    df = make_spans(chain + ring + few)
    asked = ["d39", "d16", "d17", "d3", "tail", "r1", "low", "top", "lost"]
    all_depths = {r.span_id: r.depth for r in paths.span_depths(df).collect()}
    got = {r.span_id: r.depth for r in paths.leaf_depths(df.where(F.col("span_id").isin(asked)), df).collect()}
    assert got == {i: all_depths[i] for i in asked} and got["d39"] == 39 and got["tail"] == 4


def test_only_ancestors_of_leaves_are_climbed(spark, make_spans, monkeypatch):
    written = {}
    real = paths.store
    monkeypatch.setattr(paths, "store", lambda df, label: written.setdefault(f"{label}{len(written)}", real(df, label)))
    df = make_spans([(f"a{i}", f"a{i - 1}" if i else None, i, "web", "server", 1, "OK", "op") for i in range(5)] + [(f"b{i}", "a0", i, "web", "server", 1, "OK", "op") for i in range(50)])
    assert paths.leaf_depths(df.where("span_id = 'a4'"), df).first().depth == 4
    assert all(t.count() <= 1 for label, t in written.items() if label.startswith("climb"))


def test_every_degraded_edge_has_its_role(make_spans, one_incident):
    calls = [("web", "db", 10, 200), ("api", "db", 10, 190), ("front", "web", 10, 210), ("db", "disk", 5, 120), ("other", "far", 5, 70), ("calm", "web", 5, 5)]
    roles = {(r.caller, r.callee): r.role for r in spans.edge_roles(edge_case(make_spans, calls), one_incident(ONSET)).collect()}
    assert roles == {("web", "db"): "into_origin", ("api", "db"): "into_origin", ("front", "web"): "victim_path", ("db", "disk"): "own_outbound", ("other", "far"): "not_explained"}


def walk(rows):
    """(span_id, parent, time) -> {(span_id, time): (position, depth)} by recursion; children of a repeated id hang below its first row."""
    nodes = sorted(rows, key=lambda r: (r[2], r[0]))
    first = {}
    for n, (name, _, _) in enumerate(nodes):
        if name is not None:
            first.setdefault(name, n)
    below = {}
    for n, (_, parent, _) in enumerate(nodes):
        below.setdefault(first.get(parent), []).append(n)
    out, stack = {}, [(n, 0) for n in reversed(below.get(None, []))]
    while stack:
        n, depth = stack.pop()
        out[nodes[n][0], nodes[n][2]] = (len(out), depth)
        stack += [(c, depth + 1) for c in reversed(below.get(n, []))]
    return out


def tree_of(spark, make_spans, rows):
    df = make_spans([(s, p, t, "a", "server", 1, "OK", "op") for s, p, t in rows]).repartition(5)
    return {(r.span_id, r.time): (r.position, r.depth) for r in paths.tour(df, ["incident_id", "trace_id"]).collect()}


def test_tour_of_chain_star_and_random_forests(spark, make_spans):
    chain = [(f"c{i}", f"c{i - 1}" if i else None, i) for i in range(5000)]
    assert tree_of(spark, make_spans, chain) == {(f"c{i}", i): (i, i) for i in range(5000)}
    star = [("hub", None, 0)] + [(f"s{i:03d}", "hub", 7) for i in range(300)]
    assert tree_of(spark, make_spans, star) == walk(star)
    rng = random.Random(4)
    wild = [(f"w{i}", f"w{rng.randrange(i)}" if i and rng.random() < 0.9 else rng.choice([None, "gone"]), rng.randrange(40)) for i in range(250)]
    assert tree_of(spark, make_spans, wild) == walk(wild)


def test_tour_leaves_out_rings_and_keeps_repeated_and_missing_ids(spark, make_spans):
    rows = [("a", "b", 0), ("b", "a", 1), ("t", "a", 2), ("self", "self", 3), ("r", None, 4), ("r", None, 5), ("k", "r", 6), (None, "r", 7), (None, None, 8)]
    got = tree_of(spark, make_spans, rows)
    assert got == {("r", 4): (0, 0), ("k", 6): (1, 1), (None, 7): (2, 1), ("r", 5): (3, 0), (None, 8): (4, 0)}
    assert tree_of(spark, make_spans, rows[:4]) == {}
