"""Bundles on disk, vendor payload edge cases, and multi-batch streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from faultline.sources import benchmark, bundle, case_folders, vendor
from faultline.streaming import jobs


def write_case(root, name, spans, extra=None):
    public = root / name / "public"
    public.mkdir(parents=True)
    (public / "traces.jsonl").write_text("\n".join(json.dumps(s) for s in spans) + "\n\n")
    alert = {"alertname": "UserFacingDegradation", "severity": "critical", "starts_at_second": 3, "labels": {"tier": "user_facing"}, "annotations": {}, "value": 1.0,
             "expr": "x", "fingerprint": "f"}
    manifest = {"scenario_id": name, "source": "test", "time_unit": "seconds", "window": {"start": 0, "end": 60}, "symptom": "slow", "available_signals": ["traces"],
                "notes": [], "alerts": [alert]}
    (public / "manifest.json").write_text(json.dumps(manifest, indent=1))
    for file, text in (extra or {}).items():
        (public / file).write_text(text)


def span(**over):
    return {"trace_id": "t", "span_id": "s", "parent_span_id": None, "time": 1, "service": "web", "operation": "op", "duration_ms": 2.5, "status": "OK",
            "attributes": {"span.kind": "SERVER", "n": 5}} | over


def test_bundles_are_read_by_incident(spark, tmp_path):
    write_case(tmp_path, "one", [span(), span(span_id="s2", parent_span_id="s")], {"changes.jsonl": json.dumps(
        {"id": "c", "time": 1, "service": "web", "kind": "deploy", "summary": "x", "diff_touches": ["a"]})})
    write_case(tmp_path, "two", [span()])
    tables = bundle.read_bundles(spark, str(tmp_path))
    assert {(r.incident_id, r.span_id, r.span_kind) for r in tables["spans"].collect()} == {("one", "s", "server"), ("one", "s2", "server"), ("two", "s", "server")}
    assert tables["changes"].first().diff_touches == ["a"] and tables["logs"].count() == 0
    assert {r.window_end for r in tables["incidents"].collect()} == {60} and tables["alerts"].count() == 2


def test_strict_reading_fails_and_loose_reading_rejects(spark, tmp_path):
    write_case(tmp_path, "one", [span(), span(span_id="", extra=1)])
    with pytest.raises(Exception, match="invalid traces row"):
        bundle.read_bundles(spark, str(tmp_path))["spans"].collect()
    loose = bundle.read_bundles(spark, str(tmp_path), strict=False)
    assert loose["spans"].count() == 1 and loose["rejects"].first().reject_reasons == ["span_id is empty", "unknown field extra"]


def test_lines_are_parsed_once(spark, tmp_path):
    """Valid and rejected rows come from one parse, and a filter on the reasons does not parse again for each field."""
    write_case(tmp_path, "one", [span(), span(span_id="", extra=1)])
    loose = bundle.read_bundles(spark, str(tmp_path), strict=False)
    for part in ("spans", "rejects"):
        assert "from_json" not in loose[part]._jdf.queryExecution().optimizedPlan().toString()
    assert [json.loads(r.line)["span_id"] for r in loose["rejects"].collect()] == [""]
    lines = spark.createDataFrame([('{"trace_id": "t"}',), (None,), ("[1]",)], "line string")
    valid, bad = bundle.split_valid(bundle.validate_rows(lines, "traces"))
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert valid.count() == 0 and [r.reject_reasons[0] for r in bad.orderBy("line").collect()] == ["not a JSON object", "not a JSON object", "span_id is empty"]


def test_sealed_folders_stay_closed():
    with pytest.raises(bundle.SealedPathError):
        bundle.public_pattern("/data/eval_only", "traces.jsonl")


def test_sink_refuses_leaks(spark, tmp_path):
    rows = spark.createDataFrame([("i", 1, "web", "INFO", "flag cartFailure on", None)], "incident_id string, time long, service string, severity string, message string, trace_id string")
    with pytest.raises(bundle.LeakError):
        bundle.write_bundle({"logs": rows}, None, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_prometheus_labels_and_rounding(spark):
    doc = {"result": [{"metric": {"__name__": "m", "job": "j", "zone": "a", "feature_flag.key": "x"}, "values": [[100.5, "1"], [101.5, "2"], [90, "3"], [103, "NaN"], [104, "+Inf"], [105]]},
                      {"metric": {"zone": "b"}, "values": [[100, "1"]]}]}
    docs = spark.createDataFrame([("i", 100.0, json.dumps(doc))], "incident_id string, start_s double, doc string")
    got = vendor.prometheus_matrix(docs, "m", "u").collect()
    assert [(r.time, r.value) for r in got] == [(0, 1.0), (2, 2.0), (0, 3.0)] and got[0].attributes == {"zone": "a"} and got[0].service == "j"


def test_opensearch_drops_and_defaults(spark):
    base = {"body": "hi", "resource": {"service.name": "web"}, "time": "2024-01-01T00:00:10.84349Z"}
    hits = [base, base | {"body": "see adHighCpu"}, base | {"body": ""}, base | {"resource": {}}, base | {"severity": {"text": "WARN"}, "time": "2024-01-01T00:00:05+00:00"}]
    start = 1704067200.0
    docs = spark.createDataFrame([("i", start, json.dumps({"_source": h})) for h in hits], "incident_id string, start_s double, doc string")
    assert sorted((r.time, r.severity) for r in vendor.opensearch_logs(docs).collect()) == [(5, "WARN"), (11, "INFO")]


def test_first_number_skips_booleans_and_text(spark):
    docs = ['{"a": true, "b": "7", "c": {"x": null, "y": {"z": 4}}}', '{"a": [1], "b": 2}', '{"a": "x"}', '{"b": -1.5e3}']
    rows = spark.createDataFrame([("i", "s", 0, d[:-1] + ', "beginTimeSeconds": 1}') for d in docs], "incident_id string, service string, start_ms long, doc string")
    assert sorted(r.value for r in vendor.bucketed_metrics(rows, "m", "u").collect()) == [-1500.0, 2.0, 4.0]


def test_wide_csv_names_and_scale(spark):
    wide = spark.createDataFrame([("i", "1000", "0.5", "2.0", "nan", "7"), ("i", "bad", "1", "1", "1", "1")],
                                 ["incident_id", "time", "checkout_latency-90", "cart_cpu", "cart_mem", "plain"])
    seen = spark.createDataFrame([("i", "checkoutservice"), ("i", "cart")], "incident_id string, service string")
    windows = benchmark.make_windows(spark.createDataFrame([("i", 1000)], "incident_id string, inject_time long"))
    got = {(r.service, r.metric, r.time): r.value for r in benchmark.wide_metrics(wide, windows, seen).collect()}
    assert got == {("checkoutservice", "latency_p95_ms", 180): 500.0, ("cart", "cpu_utilization", 180): 2.0}


def test_short_case_name_is_an_error(spark):
    df = spark.createDataFrame([("ob_cart_cpu",), ("ob_a_b_delay_1",)], "case_id string")
    got = {r.case_id: (r.service, r.case_error) for r in benchmark.parse_cases(df).collect()}
    assert got == {"ob_cart_cpu": (None, "unexpected case name"), "ob_a_b_delay_1": ("a_b", None)}


def stream_of(spark, folder, batches, schema):
    """One file per batch, read one file at a time in order."""
    import os
    import time

    for n, rows in enumerate(batches):
        part = str(folder / f"stage{n}")
        spark.createDataFrame(rows, schema).coalesce(1).write.json(part)
        source = next(p for p in os.listdir(part) if p.endswith(".json"))
        (folder / "in").mkdir(exist_ok=True)
        target = folder / "in" / f"{n}.json"
        target.write_text((folder / f"stage{n}" / source).read_text())
        os.utime(target, (time.time() + n, time.time() + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))


def test_alert_state_spans_batches(spark, tmp_path):
    schema = "incident_id string, metric string, ts long, value double"
    batches = [[("i", "m", 0, 0.1), ("i", "m", 15, 0.9)], [("i", "m", 30, 0.8), ("i", "m", 45, 0.9)], [("i", "m", 60, 0.9), ("i", "m", 75, 0.9), ("i", "m", 90, 0.1)]]
    rules = spark.createDataFrame([(1, "m", 0.5, ">", 60), (2, "m", 0.5, ">", 61)], "rule_id int, metric string, threshold double, comparison string, for_seconds int")
    got = jobs.run_available(jobs.sustained_alerts(stream_of(spark, tmp_path, batches, schema), rules), "t").collect()
    assert [(r.rule_id, r.fired_epoch, r.value) for r in got] == [(1, 15, 0.9)]


def test_open_proposals_expire(spark, tmp_path):
    schema = "action_id string, seq long, kind string, ok boolean, event_ts timestamp"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    batches = [[("a", 0, "proposed", None, at(0)), ("b", 1, "proposed", None, at(1))], [("b", 2, "approved", None, at(20)), ("b", 3, "execute_started", None, at(21))],
               [("c", 4, "proposed", None, at(900))], [("c", 5, "posted", None, at(905)), ("a", 6, "approved", None, at(906))]]
    moves = jobs.run_available(jobs.journal_transitions(stream_of(spark, tmp_path, batches, schema), ttl_seconds=300), "t")
    got = {r.action_id: r.status for r in moves.groupBy("action_id").agg(F.max_by("status", F.struct("seq", F.col("status") == "expired")).alias("status")).collect()}
    assert got == {"a": "expired", "b": "executing", "c": "posted"}


def rows_of_state(stream, folder):
    job = stream.writeStream.format("noop").option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return job.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_closed_actions_leave_no_state(spark, tmp_path):
    schema = "action_id string, seq long, kind string, ok boolean, event_ts timestamp"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    batches = [[("a", 0, "proposed", None, at(0)), ("b", 1, "proposed", None, at(1))], [("a", 2, "denied", None, at(2)), ("b", 3, "approved", None, at(3))],
               [("b", 4, "execute_started", None, at(4)), ("b", 5, "execute_result", True, at(5))]]
    assert rows_of_state(jobs.journal_transitions(stream_of(spark, tmp_path, batches, schema)), tmp_path) == 0


def test_quiet_rules_leave_no_state(spark, tmp_path):
    schema = "incident_id string, metric string, ts long, value double"
    batches = [[("i", "m", 0, 0.9), ("i", "m", 15, 0.9)], [("i", "m", 30, 0.1)]]
    rules = spark.createDataFrame([(1, "m", 0.5, ">", 60)], "rule_id int, metric string, threshold double, comparison string, for_seconds int")
    assert rows_of_state(jobs.sustained_alerts(stream_of(spark, tmp_path, batches, schema), rules), tmp_path) == 0


def test_bundles_fail_on_a_broken_row_and_stay_out_of_sealed_folders(spark, tmp_path):
    public = tmp_path / "root" / "inc_a" / "public"
    public.mkdir(parents=True)
    (tmp_path / "root" / "inc_a" / "eval_only").mkdir()
    (tmp_path / "root" / "inc_a" / "eval_only" / "traces.jsonl").write_text("sealed\n")
    good = '{"id": "c1", "time": 5, "service": "a", "kind": "deploy", "summary": "s"}'
    (public / "changes.jsonl").write_text(good + "\n\n" + good.replace('"a"', '""') + "\n")
    (public / "manifest.json").write_text('{"scenario_id": "x", "window": {"start": 1, "end": 9}, "alerts": [{"alertname": "A", "starts_at_second": 4}]}')
    root = str(tmp_path / "root")
    found = bundle.read_bundles(spark, root, strict=False)
    assert [(r.incident_id, r.id) for r in found["changes"].collect()] == [("inc_a", "c1")]
    assert [(r.signal, r.reject_reasons) for r in found["rejects"].collect()] == [("changes", ["service is empty"])]
    assert [(r.incident_id, r.window_end) for r in found["incidents"].collect()] == [("inc_a", 9)]
    assert [(r.alertname, r.starts_at_second) for r in found["alerts"].collect()] == [("A", 4)]
    assert found["spans"].count() == found["runbooks"].count() == 0
    with pytest.raises(Exception, match="invalid changes row: service is empty"):
        bundle.read_bundles(spark, root)["changes"].collect()
    with pytest.raises(bundle.SealedPathError):
        bundle.read_bundles(spark, f"{root}/inc_a/eval_only")


def test_case_files_with_different_headings(spark, tmp_path):
    def put(folder, name, text):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    put("cart_svc_cpu/1", "logs.csv", 'timestamp,level,message\n5,info,"a, ""b"""\n6,,later\n')
    put("pay_mem/2", "logs.csv", "level,timestamp,level\nfirst,7,last\n\n")
    put("pay_nofault/1", "logs.csv", "timestamp,level\n1,x\n")
    put("pay_mem/2", "inject_time.txt", "1000.0\n")
    put("cart_svc_cpu/1", "inject_time.txt", "soon\n")
    read = case_folders.read_case_csv(spark, str(tmp_path), "re2", "logs.csv")
    got = [(r.incident_id, r.timestamp, r.level, r.message) for r in read.orderBy("incident_id", "_place").collect()]
    assert got == [("re2_cart_svc_cpu_1", "5", "info", 'a, "b"'), ("re2_cart_svc_cpu_1", "6", None, "later"), ("re2_pay_mem_2", "7", "last", None)]
    cut = case_folders.read_case_windows(spark, str(tmp_path), "re2").collect()
    assert [(r.incident_id, r.start_abs, r.end_abs) for r in cut] == [("re2_pay_mem_2", 820, 1300)]
    assert case_folders.read_case_csv(spark, str(tmp_path), "re2", "traces.csv").count() == 0
