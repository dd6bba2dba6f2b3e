"""Analytical operators over the canonical telemetry tables."""
