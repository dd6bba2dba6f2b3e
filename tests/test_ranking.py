"""Root-cause ranking in each regime."""

from __future__ import annotations

import pytest

from faultline.operators import ranking


@pytest.fixture
def rank(spark):
    def run(edges, effects):
        e = spark.createDataFrame([("i", *x) for x in edges], "incident_id string, caller string, callee string")
        f = spark.createDataFrame([("i", s, *map(float, z)) for s, z in effects.items()],
                                  "incident_id string, service string, z_resource double, z_latency double, z_error double")
        return [r.service for r in ranking.rank_services(e, f).orderBy("rank").collect()]

    return run


def test_latency_origin_is_the_centre_not_the_entry(rank):
    assert rank([("a", "b"), ("b", "c")], {"a": (0, 55, 0), "b": (0, 95, 0), "c": (0, 0, 0)}) == ["b", "a", "c"]


def test_latency_prefers_the_neighbourhood_over_the_loudest(rank):
    edges = [("front", "orders"), ("orders", "shipping"), ("orders", "pay"), ("front", "user")]
    got = rank(edges, {"orders": (0, 6.5, 0), "shipping": (0, 108, 0), "pay": (0, 40, 0), "front": (0, 9, 0)})
    assert got[0] == "orders"


def test_resource_ranks_by_size_and_demotes_generators(rank):
    assert rank([("a", "b"), ("frontend-proxy", "a")], {"a": (5.7, 0, 0), "b": (85, 0, 0), "frontend-proxy": (85, 1, 0)})[:2] == ["b", "frontend-proxy"]


def test_error_goes_deepest_then_one_hop_to_a_slowed_callee(rank):
    edges = [("web", "checkout"), ("checkout", "pay"), ("checkout", "ship")]
    assert rank(edges, {"web": (0, 0, 50), "checkout": (0, 0, 40)})[0] == "checkout"
    assert rank(edges, {"web": (0, 0, 50), "checkout": (0, 0, 40), "pay": (0, 7, 0), "ship": (4, 0, 0)})[0] == "pay"


def test_nothing_stepped_keeps_a_stable_order(rank):
    assert rank([("a", "b"), ("b", "c")], {"b": (1, 0, 0)}) == ["b", "c", "a"]


def test_final_pick_keeps_anomalous_services(spark):
    rows = [("i", "a", 1, 0.0, 9.0, 0.0, True), ("i", "b", 2, 0.0, 0.0, 0.0, False), ("i", "c", 3, 0.0, 0.0, 0.0, False)]
    ranked = spark.createDataFrame(rows, "incident_id string, service string, rank int, z_resource double, z_latency double, z_error double, anomalous boolean")
    verdicts = spark.createDataFrame([("i", "a", False), ("i", "b", False)], "incident_id string, candidate_service string, supported boolean")
    got = [(r.service, r.fault_type) for r in ranking.final_pick(ranked, verdicts).orderBy("final_rank").collect()]
    assert got == [("a", "latency/slowdown"), ("c", None)]
