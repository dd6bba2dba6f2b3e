"""Alerts, coverage, journals, grading and samplers against known answers."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import alerts, audit, grading, quality
from faultline.sources import sampling

RULE = "rule_id int, metric string, threshold double, comparison string, for_seconds int"


def breach(spark, values, hold=60):
    series = spark.createDataFrame([("i", "m", 15 * n, v) for n, v in enumerate(values)], "incident_id string, metric string, time long, value double")
    rules = spark.createDataFrame([(1, "m", 0.5, ">", hold)], RULE)
    return [(r.starts_at_second, r.value) for r in alerts.sustained_breaches(series, rules).collect()]


def test_breach_must_last(spark):
    hi, lo = 0.9, 0.1
    assert breach(spark, [lo, hi, hi, hi, hi, lo]) == []
    assert breach(spark, [lo, 0.8, hi, hi, hi, hi]) == [(15, 0.8)]
    assert breach(spark, [hi, hi, float("nan"), 0.7, hi, hi, hi, hi]) == [(45, 0.7)]
    assert breach(spark, [hi, hi, float("inf"), hi]) == []
    assert breach(spark, [lo, 0.6, lo], hold=0) == [(15, 0.6)]


def test_breach_chunks_do_not_matter(spark):
    rng = random.Random(5)
    rows = [("i", "m", 15 * n, rng.choice([0.1, 0.9, 0.9, 0.9])) for n in range(400)]
    series = spark.createDataFrame(rows, "incident_id string, metric string, time long, value double")
    rules = spark.createDataFrame([(1, "m", 0.5, ">", 120)], RULE)
    answers = {tuple(alerts.sustained_breaches(series.repartition(n), rules).first()) for n in (1, 3, 8)}
    assert len(answers) == 1


def test_firing_set_of_one_scenario_is_a_violation(spark):
    rows = [("a", ["X", "Y"]), ("b", ["X"]), ("c", ["X"]), ("d", ["Y", "Z"]), ("e", [])]
    got = {(r.invariant, r.subject) for r in alerts.coverage_violations(spark.createDataFrame(rows, "scenario_id string, alertnames array<string>")).collect()}
    assert got == {("E1", ""), ("E2", "Z"), ("E3", "X,Y"), ("E3", "Y,Z"), ("E3", "")}


LIFE = {
    "happy": ["proposed", "posted", "approved", "execute_started", "execute_result"], "failed": ["proposed", "approved", "execute_started", "bad_result"],
    "denied": ["proposed", "posted", "denied", "approved", "execute_started"], "late": ["proposed", "approved", "expired", "execute_started"],
    "loose": ["proposed", "execute_started", "execute_result"], "again": ["proposed", "approved", "execute_started", "proposed", "posted"],
    "unknown": ["approved", "execute_result"], "miss": ["proposed", "near_miss", "posted", "proposed", "near_miss"],
}
STATUS = {"happy": "done", "failed": "failed", "denied": "denied", "late": "expired", "loose": "proposed", "again": "posted", "miss": "proposed"}


def journal(spark):
    rows = [(a, n, "execute_result" if k == "bad_result" else k, k != "bad_result") for a, kinds in LIFE.items() for n, k in enumerate(kinds)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "action_id string, seq long, kind string, ok boolean")


def test_journal_fold(spark):
    assert {r.action_id: r.status for r in audit.fold_journal(journal(spark)).collect()} == STATUS


def test_journal_fold_matches_a_state_machine(spark):
    rng = random.Random(9)
    kinds = ["proposed", "posted", "approved", "denied", "expired", "execute_started", "execute_result", "near_miss"]
    rows = [(f"a{rng.randrange(40)}", n, rng.choice(kinds), rng.random() < 0.5) for n in range(1500)]
    moves = {"posted": ("proposed",), "approved": ("proposed", "posted"), "denied": ("proposed", "posted"),
             "expired": ("proposed", "posted", "approved"), "execute_started": ("approved",)}
    want = {}
    for a, _, k, ok in rows:
        if k == "proposed":
            want[a] = k
        elif k == "execute_result" and want.get(a) == "executing":
            want[a] = "done" if ok else "failed"
        elif k in moves and want.get(a) in moves[k]:
            want[a] = "executing" if k == "execute_started" else k
    df = spark.createDataFrame(rows, "action_id string, seq long, kind string, ok boolean").repartition(6)
    assert {r.action_id: r.status for r in audit.fold_journal(df).collect()} == want


def test_audit_report_flags_unapproved_execution(spark):
    got = audit.audit_report(journal(spark)).first()
    assert (got.considered, got.executed, got.near_miss_count, got.unapproved_executions, got.safe) == (7, 2, 2, 1, False)


def test_content_hash_equals_key_sorted_json(spark):
    payload = json.dumps({"kind": "scale", "target_service": "cart", "params": {"replicas": 2, "zone": "b"}}, sort_keys=True)
    params = F.create_map(F.lit("zone"), F.lit('"b"'), F.lit("replicas"), F.lit("2"))
    got = spark.range(1).select(audit.content_hash(F.lit("scale"), F.lit("cart"), params).alias("h")).first().h
    assert got == hashlib.sha256(payload.encode()).hexdigest()


def test_recovery(spark):
    rows = [(9.0, 2.0, None, True), (9.0, 3.0, None, False), (None, 1.0, None, False), (9.0, None, 5.0, False), (None, 4.0, 5.0, True)]
    df = spark.createDataFrame(rows, "b double, a double, t double, want boolean").select("want", audit.is_recovered("b", "a", "t").alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_frame_look_up_falls_back_to_the_first(spark):
    frames = spark.createDataFrame([("s", 100, "a"), ("s", 5000, "b"), ("s", 5100, "c")], "stream_id string, fetched_at long, payload string")
    probes = spark.createDataFrame([("s", str(t), t) for t in (5, 100, 4999, 5050, 90000)], "stream_id string, probe_id string, at long")
    got = {int(r.probe_id): r.payload for r in audit.frame_at(frames, probes).collect()}
    assert got == {5: "a", 100: "a", 4999: "a", 5050: "b", 90000: "c"}


def test_pass_at_k(spark):
    rows = [("s1", True), ("s1", True), ("s2", True), ("s2", False), ("s3", False), ("s3", None)]
    df = spark.createDataFrame(rows, "scenario_id string, correct boolean").select(
        "*", *[F.col("correct").alias(d) for d in grading.DIMENSIONS], F.lit(1.5).alias("cost"), F.lit(4).alias("calls"))
    got = grading.suite_reliability(df).first()
    assert got.pass_at_k == pytest.approx(2 / 3) and got.pass_hat_k == pytest.approx(1 / 3) and got.micro_pass_rate == 0.5
    assert {r.scenario_id: r.flaky for r in grading.scenario_reliability(df).collect()} == {"s1": False, "s2": True, "s3": False}


def test_type_match(spark):
    cases = [("network packet loss", "packet loss", True), ("loss", "packet loss", True), ("cpu", "packet loss", False), (None, "cpu", False), ("CPU-exhaustion!", "cpu exhaustion", True)]
    df = spark.createDataFrame(cases, "r string, t string, want boolean").select("want", grading.type_match("r", "t").alias("got"))
    assert all(r.got == r.want for r in df.collect())


def greedy(sizes, cap):
    """sizes: (trace, n, calm) -> traces kept, the plain way."""
    if sum(n for _, n, _ in sizes) <= cap:
        return {t for t, _, _ in sizes}
    used, kept = 0, set()
    for t, n, _ in sorted(sizes, key=lambda x: (x[2], x[0])):
        if used and used + n > cap:
            continue
        kept.add(t)
        used += n
    return kept


@pytest.mark.parametrize("cap", [1, 7, 40, 150, 10_000])
def test_whole_trace_sample_equals_the_greedy_fill(spark, cap):
    rng = random.Random(cap)
    sizes = [(f"t{i:03d}", rng.choice([1, 1, 2, 3, 5, 8, 30]), rng.choice([0, 1, 1, 1])) for i in range(80)]
    rows = [("i", t, f"{t}-{k}", "ERROR" if not calm and k == 0 else "OK") for t, n, calm in sizes for k in range(n)]
    df = spark.createDataFrame(rows, "incident_id string, trace_id string, span_id string, status string").repartition(5)
    got = sampling.whole_trace_sample(df, cap)
    assert {r.trace_id for r in got.select("trace_id").distinct().collect()} == greedy(sizes, cap)


def test_whole_trace_sample_with_nulls_and_one_oversized_trace(spark):
    columns = "incident_id string, trace_id string, span_id string, status string"
    rows = [("i", None, "n1", None), ("i", None, "n2", "OK"), ("i", "a", "a1", None), ("i", "b", "b1", "unset"), (None, "x", "x1", "OK")]
    got = {r.span_id for r in sampling.whole_trace_sample(spark.createDataFrame(rows, columns), 3).collect()}
    assert got == {"n1", "n2", "a1", "x1"}
    big = [("i", "big", f"s{k}", "ERROR") for k in range(9)] + [("i", "one", "o", "OK")]
    assert sampling.whole_trace_sample(spark.createDataFrame(big, columns), 4).count() == 9
    assert sampling.whole_trace_sample(spark.createDataFrame([], columns), 4).count() == 0


@pytest.mark.parametrize("cap", [5, 30, 77, 500])
def test_priority_downsample_equals_the_list_version(spark, cap):
    rng = random.Random(cap)
    rows = [("i", rng.randrange(900), n, rng.random() < 0.2) for n in range(200)]
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    top, rest = [r for r in ordered if r[3]], [r for r in ordered if not r[3]]
    if len(rows) <= cap:
        want = set(rows)
    elif len(top) >= cap:
        want = set(top[:cap])
    else:
        step = len(rest) / (cap - len(top))
        want = set(top) | {rest[min(len(rest) - 1, int(i * step))] for i in range(cap - len(top))}
    df = spark.createDataFrame(rows, "incident_id string, time long, n long, pri boolean").repartition(4)
    got = {tuple(r) for r in sampling.priority_downsample(df, F.col("pri"), cap, ["n"]).collect()}
    assert got == want


def test_text_lines_are_numbered_and_scanned(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine\nhas paymentFailure here\n\nfeature_flag.key\n")
    lines = quality.read_lines(spark, str(tmp_path))
    got = {(r.line_number, r.token) for r in quality.banned_token_findings(lines).collect()}
    assert got == {(2, "paymentFailure"), (4, "feature_flag.key"), (4, "feature_flag.")}


@pytest.mark.parametrize("hot", [1, 6, 1000])
def test_sharing_pairs_equal_all_against_all(spark, hot):
    """One value is held by half of the incidents; pairs and classes together hold every link."""
    rng = random.Random(hot)
    lists = {f"i{n:02d}": [[f"v{rng.randrange(60)}" for _ in range(rng.randrange(3))] + (["common"] if c == 0 and n % 2 else []) for c in range(5)] for n in range(40)}
    lists["i39"][1] = None
    lists["i38"][2] = [None, "v1", "v1"]
    schema = "incident_id string, " + ", ".join(f"{c} array<string>" for c in quality.COMPARED)
    df = spark.createDataFrame([(k, *v) for k, v in lists.items()] + [(None, *lists["i01"])], schema).repartition(5)
    pairs, classes = quality.sharing_pairs(df, hot)
    got = {(r.left_id, r.right_id): (r.shared_features, r.shared_values) for r in pairs.collect()}
    held = {(r.incident_id, r.feature, r.value): r.holders for r in classes.collect()}
    sets = {k: [{x for x in v or [] if x is not None} for v in vs] for k, vs in lists.items()}
    size = lambda c, v: sum(v in s[c] for s in sets.values())
    assert held == {(k, quality.COMPARED[c], v): size(c, v) for k, s in sets.items() for c in range(5) for v in s[c] if size(c, v) > max(hot, 1)}
    for a, b in ((a, b) for a in sets for b in sets if a < b):
        both = [sets[a][c] & sets[b][c] for c in range(5)]
        want = (sum(map(bool, both)), sum(map(len, both)))
        if any(size(c, v) <= hot for c in range(5) for v in both[c]):
            assert got.pop((a, b)) == want
        elif want[1]:
            assert any((a, quality.COMPARED[c], v) in held and (b, quality.COMPARED[c], v) in held for c in range(5) for v in both[c])
    assert not got
