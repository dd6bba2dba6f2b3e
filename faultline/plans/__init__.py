"""Telemetry views over the test tables and the query registry."""

from faultline.plans import cause_queries, review_queries, signal_queries, source_queries, span_queries, stream_queries  # noqa: F401
from faultline.plans.registry import ORACLES, QUERIES, runnable

__all__ = ["ORACLES", "QUERIES", "runnable"]
