"""Registered queries against their SQL on the smallest tables.

All of them run with FAULTLINE_ALL=1; by default one or two per family do.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from faultline.plans import runnable
from harness import compare, oracle_connection

SF = "/root/testdata/sf0.001"
SAMPLE = ["p6_callee_resolution", "t1_dependency_graph", "t4_edge_latency_origin", "t6_error_origin", "t9_slowest_operations", "t11_span_tree", "m2_series_sample", "m4_level_shift",
          "z1_step_effect", "l3_error_clusters", "c4_nearest_change", "k5_onset_consensus", "g7_critical_path", "r5_localise", "r9_gather_evidence", "a2_derive_alerts",
          "d7_incident_fingerprints", "e5_scorecard", "j3_gate_decisions", "s5_jaeger_traces", "s17_priority_downsample", "s18_whole_trace_sample", "w2_level_counts", "w4_stateful_alerts"]
NAMES = sorted(runnable()) if os.environ.get("FAULTLINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return oracle_connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, con, name):
    verdict, _, _ = compare(spark, SF, con, contract.queries()[name], contract.oracle_sql().get(name))
    assert verdict == "ok", verdict


def test_entry_names_a_service_per_incident(spark):
    rows = {r.incident_id: r for r in contract.entry(spark).collect()}
    assert len(rows) == 6 and all(r.root_cause_service for r in rows.values())


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
