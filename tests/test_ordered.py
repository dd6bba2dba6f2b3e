"""Distributed order statistics against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions.ordered import exact_median, exact_p95, exact_ranks, latest_before, low_median_rank, ordered_index, p95_rank, previous_value, range_parts, running_sums, top_per_group


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [("hot", rng.choice([0.0, 1.5, 1.5, rng.random() * 1e6])) for _ in range(3000)]
    out += [(rng.choice("abc"), rng.gauss(0, 50)) for _ in range(400)]
    out += [("one", 3.25), (None, 2.0), (None, 9.0), ("neg", -5.0), ("neg", -0.001), ("neg", 0.0), ("tiny", 1e-300), ("tiny", 5e-324)]
    return out


def groups(rows):
    found = {}
    for k, v in rows:
        found.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in found.items()}


def test_p95_is_the_ranked_value(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.n, r.p95) for r in exact_p95(df, ["k"], "v").collect()}
    want = {k: (len(v), v[min(len(v) - 1, int(0.95 * len(v)))]) for k, v in groups(rows).items()}
    assert got == want


def test_median_averages_the_middle(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    for k, v in groups(rows).items():
        n = len(v)
        assert got[k] == (v[(n - 1) // 2] + v[n // 2]) / 2


def test_p95_when_the_rank_is_whole(spark):
    df = spark.range(20).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    assert exact_p95(df, ["k"], "v").first().p95 == 19.0


def test_ranks_inside_a_gauge_that_hardly_moves(spark):
    """Many distinct values share one bin; nested clusters ask for several cuts."""
    rng = random.Random(11)
    flat = [1000.0 + i * 1e-9 for i in range(4000)] + [1000.0 + 2e-6 + i * 1.2e-13 for i in range(4000)] + [-7.0 - i * 1e-12 for i in range(3)]
    edge = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, 1e-323]
    rng.shuffle(flat)
    df = spark.createDataFrame([("flat", v) for v in flat] + [("edge", v) for v in edge], "k string, v double").repartition(6)
    ranks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in (1, 3, 4, 6, 7)}
    got = {r.k: r.asDict() for r in exact_ranks(df, ["k"], "v", ranks | {"mid": low_median_rank, "p95": p95_rank}).collect()}
    want = sorted(flat)
    assert [got["flat"][f"r{i}"] for i in (1, 3, 4, 6, 7)] == [want[i - 1] for i in (1, 3, 4, 6, 7)]
    assert got["flat"]["mid"] == want[(len(want) + 1) // 2 - 1] and got["flat"]["p95"] == want[int(0.95 * len(want))]
    assert [got["edge"][f"r{i}"] for i in (1, 3, 4, 6)] == [float("-inf"), 0.0, 5e-324, float("inf")] and str(got["edge"]["r7"]) == "nan"


def test_index_and_running_sums_match_a_sort(spark):
    rng = random.Random(3)
    data = [("k", rng.randrange(50), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(data, "k string, b int, i int, v double").repartition(5)
    order = sorted(data, key=lambda r: (r[1], r[2]))
    got = {r.i: r.idx for r in ordered_index(df, ["k"], ["b", "i"]).collect()}
    assert got == {r[2]: n for n, r in enumerate(order)}
    total, want = 0.0, {}
    for r in order:
        total += r[3]
        want[r[2]] = total
    sums = {r.i: r.s for r in running_sums(df, ["k"], ["b", "i"], {"s": F.col("v")}).collect()}
    assert all(abs(sums[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_group_is_exact_for_small_and_large_limits(spark, k):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v")).repartition(7)
    got = sorted(r.v for r in top_per_group(df, ["g"], [F.col("v").desc()], k).collect())
    assert got == sorted(range(5000 - 2 * k, 5000))


def test_infinities_and_nan_are_values(spark):
    inf = float("inf")
    rows = [("a", inf), ("a", 1.0), ("a", 2.0), ("b", -inf), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 2.0), ("c", float("nan")), ("d", None), ("d", 5.0)]
    got = {r.k: (r.n, r.p95) for r in exact_p95(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["a"] == (3, inf) and got["b"] == (3, 2.0) and got["d"] == (1, 5.0)
    assert got["c"][0] == 3 and got["c"][1] != got["c"][1]
    low = {r.k: r.m for r in exact_median(spark.createDataFrame([("b", -inf), ("b", -inf), ("b", 1.0)], "k string, v double"), ["k"], "v", "m").collect()}
    assert low == {"b": -inf}


NULLS = [("k", 1, 1, 10.0), ("k", None, 2, 20.0), (None, 1, 3, 30.0), (None, None, 4, 40.0), ("k", 2, 5, 50.0), (None, 1, 6, 60.0)]


def test_helpers_keep_rows_with_null_keys_and_buckets(spark):
    df = spark.createDataFrame(NULLS, "k string, b int, i int, v double")
    assert {r.i: r.idx for r in ordered_index(df, ["k"], ["b", "i"]).collect()} == {2: 0, 1: 1, 5: 2, 4: 0, 3: 1, 6: 2}
    assert {r.i: r.s for r in running_sums(df, ["k"], ["b", "i"], {"s": F.col("v")}).collect()} == {2: 20.0, 1: 30.0, 5: 80.0, 4: 40.0, 3: 70.0, 6: 130.0}
    assert {r.i: r.prev_v for r in previous_value(df, ["k"], ["b", "i"], ["v"]).collect()} == {2: None, 1: 20.0, 5: 10.0, 4: None, 3: 40.0, 6: 30.0}


def test_probes_with_nulls_come_back_without_a_find(spark):
    events = spark.createDataFrame([("a", 5, "x"), ("a", None, "y"), (None, 1, "z")], "k string, t long, id string")
    probes = spark.createDataFrame([(1, "a", 9), (2, None, 9), (3, "a", None), (4, "b", 9), (5, "a", 4), (6, "a", 999_999)], "p int, k string, at long")
    got = {r.p: r.found and r.found.id for r in latest_before(probes, events, ["k"], "at", "t", ["id"]).collect()}
    assert got == {1: "x", 2: None, 3: None, 4: None, 5: None, 6: "x"}


@pytest.fixture
def small_parts(spark):
    """Parts of a few kilobytes, so that a small table has many."""
    names = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield 8
    for n, v in old.items():
        spark.conf.set(n, v)


def test_one_key_and_one_second_are_spread_over_all_parts(spark, small_parts):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), (F.col("id") % 7).alias("v"), F.col("id").alias("i"))
    laid = range_parts(df, ["k"], ["t", "v"])
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert len(sizes) == small_parts and max(sizes) <= 2 * 20_000 / small_parts
    bounds = sorted((r.lo, r.hi) for r in laid.groupBy("_part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_helpers_carry_over_parts_of_one_second(spark, small_parts):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "cold", None]), 5 if n % 3 else n % 50, n, float(n % 11)) for n in range(3000)]
    df = spark.createDataFrame(data, "k string, t int, i int, v double").withColumn("m", F.create_map(F.lit("a"), F.col("i")))
    want = {}
    for key in {d[0] for d in data}:
        total, before = 0.0, None
        for n, d in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]))):
            total += d[3]
            want[d[2]] = (n, total, before)
            before = d[3]
    order = ["t", "i"]
    assert {r.i: r.idx for r in ordered_index(df, ["k"], order).collect()} == {i: w[0] for i, w in want.items()}
    assert {r.i: r.s for r in running_sums(df, ["k"], order, {"s": F.col("v")}).collect()} == {i: w[1] for i, w in want.items()}
    assert {r.i: r.prev_v for r in previous_value(df, ["k"], order, ["v"]).collect()} == {i: w[2] for i, w in want.items()}
    top = top_per_group(df, ["k"], [F.col("t"), F.col("i")], F.lit(700), rank="r")
    assert {r.i: r.r for r in top.collect()} == {i: w[0] + 1 for i, w in want.items() if w[0] < 700}


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_over_parts_of_one_second(spark, small_parts, strict):
    rng = random.Random(6)
    events = [("hot" if n % 4 else "cold", 5 if n % 2 else rng.randrange(40), n) for n in range(1500)]
    probes = [(n, rng.choice(["hot", "cold", "none"]), rng.choice([5, 6, rng.randrange(45)])) for n in range(1500)]
    found = latest_before(
        spark.createDataFrame(probes, "p int, k string, at int"), spark.createDataFrame(events, "k string, t int, id int"), ["k"], "at", "t", ["t", "id"], strict=strict, tie="id")
    got = {r.p: r.found and tuple(r.found) for r in found.collect()}
    for p, k, at in probes:
        known = [(t, i) for key, t, i in events if key == k and (t < at if strict else t <= at)]
        assert got[p] == (max(known, key=lambda e: (e[0], -e[1])) if known else None)
