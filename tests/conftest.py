from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from faultline.session import local_session, release

    session = local_session(8, partitions=4, folder=str(tmp_path_factory.mktemp("scratch")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


SPAN_COLUMNS = ("incident_id string, trace_id string, span_id string, parent_span_id string, time long, service string, operation string, "
                "span_kind string, duration_ms double, status string")


@pytest.fixture
def make_spans(spark):
    def make(rows):
        """Rows of (span_id, parent, time, service, kind, duration, status, operation)."""
        full = [("i", "t", s, p, t, svc, op, k, float(d), st) for s, p, t, svc, k, d, st, op in rows]
        return spark.createDataFrame(full, SPAN_COLUMNS)

    return make


@pytest.fixture
def one_incident(spark):
    def make(onset, end=10000):
        return spark.createDataFrame([("i", 0, end, onset)], "incident_id string, window_start long, window_end long, onset_second long")

    return make
