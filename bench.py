"""Time the headline queries over one folder and print a single JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "r5_localise", "t1_dependency_graph", "t3_latency_origin", "t4_edge_latency_origin", "t6_error_origin", "t14_service_summary", "m5_top_movers",
    "m10_red_from_spans", "l3_error_clusters", "c3_rank_culprits", "c4_nearest_change", "g6_blast_radius", "r9_gather_evidence", "a2_derive_alerts",
    "d4_signal_gates", "d7_incident_fingerprints", "e8_run_scorecards", "j1_journal_fold", "s5_jaeger_traces", "s15_span_kinds", "w1_windowed_red",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from faultline.plans import runnable
    from faultline.session import local_session, release

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), folder=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = runnable()
    # Start the executors and let the JVM compile its hot paths before the clock.
    for name in ("t14_service_summary", "t1_dependency_graph"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - start, 3)
        print(f"{name} {taken[name]}", file=sys.stderr, flush=True)
    release(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
