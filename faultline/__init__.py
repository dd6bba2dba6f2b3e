"""Incident and root-cause analytics over microservice telemetry, as Spark jobs.

Every operator takes canonical DataFrames that carry ``incident_id`` and answers
its question for all incidents at once.
"""
