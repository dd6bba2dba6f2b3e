"""Readers, normalisers, samplers and sinks for telemetry payloads."""
