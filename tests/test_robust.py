"""Step effect size: both execution paths against a plain list implementation."""

from __future__ import annotations

import random
from statistics import median

import pytest

from faultline.functions.robust import FAMILY_FLOORS, METRIC_FLOORS, effect_sizes


def level(pre, post, eps, d_abs, d_rel):
    if len(pre) < 4 or not post:
        return 0.0
    sigma = lambda v: 1.4826 * median([abs(x - median(v)) for x in v])
    noise = lambda v: max(sigma(v), eps, 0.01 * abs(median(v)))
    rise = median(post) - median(pre)
    if rise <= 0 or not (rise >= d_abs or (median(pre) > 0 and rise >= d_rel * median(pre))):
        return 0.0
    z = rise / noise(pre)
    n, worst = len(pre), 0.0
    for at in (n // 3, 2 * (n // 3)):
        if 4 <= at <= n - 4:
            worst = max(worst, abs(median(pre[at:]) - median(pre[:at])) / noise(pre[:at]))
    return z * 0.25 if worst and z <= 1.25 * worst else z


def effect(pre, post, metric):
    kind = "latency" if "latency" in metric else "error" if "error" in metric else "resource"
    eps, d_abs, d_rel = METRIC_FLOORS.get(metric) or FAMILY_FLOORS[kind]
    z = level(pre, post, eps, d_abs, d_rel)
    if len(pre) >= 6 and len(post) >= 3:
        steps = lambda v: [b - a for a, b in zip(v, v[1:])]
        z = max(z, level(steps(pre), steps(post), eps / 10, 0.0, 0.0))
    return z


@pytest.fixture(scope="module")
def series():
    rng = random.Random(11)
    out = {}
    for i in range(40):
        metric = rng.choice(["request_error_rate", "latency_p95_ms", "cpu_utilization", "memory_mb", "queue", "error_count"])
        n, m = rng.choice([0, 3, 4, 5, 7, 12, 20, 31]), rng.choice([0, 1, 2, 3, 10, 25])
        base, step, slope = rng.choice([0.0, 0.01, 20.0, 400.0]), rng.choice([0.0, 0.05, 30.0, 500.0]), rng.choice([0.0, 0.0, 2.0])
        pre = [base + rng.gauss(0, base * 0.05 + 0.001) + (slope * t if i % 7 == 0 else 0) for t in range(n)]
        post = [base + step + rng.gauss(0, base * 0.05 + 0.001) + slope * t * 3 for t in range(m)]
        out[(f"s{i}", metric)] = (pre, post)
    return out


@pytest.mark.parametrize("array_max", [200_000, 25, 0])
def test_effect_size_matches_brute_force(spark, series, array_max):
    rows = []
    for (s, metric), (pre, post) in series.items():
        rows += [("i", s, metric, t, v, "pre") for t, v in enumerate(pre)] + [("i", s, metric, 1000 + t, v, "post") for t, v in enumerate(post)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "incident_id string, service string, metric string, time long, value double, side string").repartition(5)
    got = {(r.service, r.metric): r for r in effect_sizes(df, ["incident_id", "service", "metric"], array_max=array_max).collect()}
    for key, (pre, post) in series.items():
        if not pre and not post:
            continue
        assert got[key].effect_z == pytest.approx(effect(pre, post, key[1]), rel=1e-9, abs=1e-9), key
        assert (got[key].n_pre, got[key].n_post) == (len(pre), len(post))
        assert got[key].pre_mean == pytest.approx(sum(pre) / len(pre) if pre else 0.0)


@pytest.mark.parametrize("array_max", [200_000, 0])
def test_one_infinite_point_is_no_failure(spark, array_max):
    rows = [("m", t, float(t % 3), "pre") for t in range(12)] + [("m", 100 + t, 50.0 + t, "post") for t in range(8)] + [("m", 200, float("inf"), "post")]
    df = spark.createDataFrame(rows, "metric string, time long, value double, side string")
    got = effect_sizes(df, ["metric"], array_max=array_max).first()
    assert (got.n_pre, got.n_post) == (12, 9) and 30 < got.effect_z < float("inf")
