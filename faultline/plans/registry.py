"""Named queries over the telemetry views, each with its reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans.views import Telemetry

Builder = Callable[[Telemetry], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Telemetry(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
