"""Streams over several batches: silences told while they last, and windows merged from panes."""

from __future__ import annotations

import datetime
import os
import random

from pyspark.sql import functions as F

from faultline.streaming import jobs, silence

SCHEMA = "incident_id string, service string, event_ts timestamp, duration_ms double, status string"


def stream_of(spark, folder, batches):
    """One file per batch, read one at a time in this order."""
    for n, rows in enumerate(batches):
        made = [("i", s, datetime.datetime.fromtimestamp(t, datetime.timezone.utc), float(d), "OK") for s, t, d in rows]
        part = f"{folder}/in/{n:03d}.json"
        os.makedirs(os.path.dirname(part), exist_ok=True)
        with open(part, "w", encoding="utf-8") as file:
            for i, s, t, d, st in made:
                file.write(f'{{"incident_id": "{i}", "service": "{s}", "event_ts": "{t:%Y-%m-%dT%H:%M:%S.%fZ}", "duration_ms": {d}, "status": "{st}"}}\n')
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def test_silences_are_told_while_they_last_and_when_they_end(spark, tmp_path):
    batches = [[("a", 0, 1), ("b", 1000, 1)], [("b", 2000, 1)], [("a", 3000, 1), ("b", 3000, 1)], [("b", 5000, 1)]]
    found = jobs.run_available(silence.silences(stream_of(spark, tmp_path, batches), gap_seconds=600), "silences", timers=True)
    second = lambda us: None if us is None else us // 1_000_000
    got = {(r.service, second(r.silent_since), second(r.resumed_at)) for r in found.collect()}
    assert got == {("a", 0, None), ("a", 0, 3000), ("a", 3000, None), ("b", 1000, None), ("b", 1000, 2000), ("b", 2000, None), ("b", 2000, 3000), ("b", 3000, None)}
    assert found.count() == 8


def test_state_of_services_that_stay_away_is_given_up(spark, tmp_path):
    batches = [[("a", 0, 1), ("b", 100, 1)], *[[("b", 100 * n, 1)] for n in range(2, 24)]]
    stream = silence.silences(stream_of(spark, tmp_path, batches), gap_seconds=600, forget_seconds=1300)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    job = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    job.awaitTermination()
    held = [next(o.numRowsTotal for o in p.stateOperators if o.operatorName.startswith("transformWithState")) for p in job.recentProgress if p.stateOperators]
    assert max(held) > held[-1] > 0  # b is still there, a is not


def test_windows_merged_from_panes_keep_the_rank_of_p95(spark, tmp_path):
    rng = random.Random(2)
    values = [rng.expovariate(0.01) for _ in range(6000)]
    batches = [[("a", n * 0.029, d) for n, d in enumerate(values)], [("a", 1000, 1.0)]]
    rows = jobs.run_available(jobs.windowed_red(stream_of(spark, tmp_path, batches)), "red").where(F.col("requests") > 4000).collect()
    assert rows
    for r in rows:
        inside = sorted(d for n, d in enumerate(values) if r.window_start.timestamp() <= n * 0.029 < r.window_end.timestamp())
        rank = sum(d <= r.p95_ms for d in inside) / len(inside)
        assert r.requests == len(inside) and abs(rank - 0.95) <= 0.012 and r.max_ms == inside[-1]
