"""Robust step detection: how far a series moved at onset, in noise units.

The effect size is the larger of a level step (medians of the values) and a slope
step (medians of the first differences), each scaled by the MAD of the baseline
and tested against placebo splits inside the baseline.

Ordinary series are short (one incident, one metric), so one shuffle by series
brings each together. Series above ``ARRAY_MAX`` points never meet in one task:
their medians come from :mod:`faultline.functions.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.ordered import exact_median, ordered_index
from faultline.session import checkpoint

Z_MIN = 3.0  # fixed value
ARRAY_MAX = 200_000

# fixed values: noise floor, absolute and relative step floors
METRIC_FLOORS = {
    "request_error_rate": (0.002, 0.01, 0.5),
    "latency_p95_ms": (2.0, 15.0, 0.15),
    "latency_p50_ms": (1.0, 10.0, 0.15),
    "cpu_utilization": (0.01, 0.03, 0.15),
    "memory_mb": (5.0, 20.0, 0.10),
}
FAMILY_FLOORS = {
    "error": (0.002, 0.01, 0.5),
    "latency": (2.0, 15.0, 0.15),
    "resource": (1e-9, 0.0, 0.15),
}
# fixed values: scale of the deviation, and how far a step must exceed its placebo
MAD_TO_SIGMA = 1.4826
ALIGN_RATIO = 1.25
ALIGN_DEMOTE = 0.25
FAMILIES = ("resource", "latency", "error")


def family(metric: str | Column = "metric") -> Column:
    m = F.lower(F.col(metric) if isinstance(metric, str) else metric)
    return (
        F.when(m.contains("latency") | m.contains("duration"), "latency")
        .when(m.contains("error"), "error")
        .otherwise("resource")
    )


def floors(metric: str = "metric") -> Column:
    """Struct (eps, abs, rel) for a metric: named metrics first, then the family."""
    def entry(triple: tuple[float, float, float]) -> Column:
        return F.struct(*[F.lit(x).alias(n) for n, x in zip(("eps", "abs", "rel"), triple)])

    named = F.create_map(*[x for m, t in METRIC_FLOORS.items() for x in (F.lit(m), entry(t))])
    by_family = F.create_map(*[x for m, t in FAMILY_FLOORS.items() for x in (F.lit(m), entry(t))])
    return F.coalesce(F.try_element_at(named, F.col(metric)), F.try_element_at(by_family, family(metric)))


def _median_of_sorted(values: Column) -> Column:
    n = F.size(values)
    mid = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, mid).otherwise(F.lit(0.0))


def _level_z(prefix: str, eps: Column, d_abs: Column, d_rel: Column) -> Column:
    """Step size from the staged statistics of one (level or slope) series."""
    def c(name: str) -> Column:
        return F.col(f"{prefix}_{name}")

    def noise(sigma: Column, median: Column) -> Column:
        return F.greatest(sigma, eps, F.lit(0.01) * F.abs(median))

    delta = c("post_med") - c("pre_med")
    z = delta / noise(c("pre_sigma"), c("pre_med"))
    placebo = F.lit(0.0)
    for cut in ("1", "2"):
        shift = F.abs(c(f"b{cut}_med") - c(f"a{cut}_med")) / noise(c(f"a{cut}_sigma"), c(f"a{cut}_med"))
        placebo = F.greatest(placebo, F.coalesce(shift, F.lit(0.0)))
    aligned = F.when((placebo > 0) & (z <= ALIGN_RATIO * placebo), z * ALIGN_DEMOTE).otherwise(z)
    big_enough = (delta >= d_abs) | ((c("pre_med") > 0) & (delta >= d_rel * c("pre_med")))
    usable = (c("pre_n") >= 4) & (c("post_n") > 0) & (delta > 0) & big_enough
    return F.when(usable, aligned).otherwise(F.lit(0.0))


def _combine(stats: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    staged = stats.withColumn("_f", floors(metric))
    level = _level_z("l", F.col("_f.eps"), F.col("_f.abs"), F.col("_f.rel"))
    slope = _level_z("d", F.col("_f.eps") / 10, F.lit(0.0), F.lit(0.0))
    long_enough = (F.col("l_pre_n") >= 6) & (F.col("l_post_n") >= 3)
    return staged.select(
        *keys,
        F.col("l_pre_n").alias("n_pre"), F.col("l_post_n").alias("n_post"), F.col("l_pre_mean").alias("pre_mean"), F.col("l_post_mean").alias("post_mean"),
        F.when(long_enough, F.greatest(level, slope)).otherwise(level).alias("effect_z"),
    )


SEGMENTS = ("pre", "post", "a1", "b1", "a2", "b2")


def _segments(both: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tag every value with the segments it belongs to: its side and the placebo halves.

    ``both`` holds levels (``_p`` = l) and first differences (``_p`` = d) with their
    position ``idx``; a placebo cut counts only with four points on each side.
    """
    third = F.floor(F.col("pre_n") / 3)
    tags = [F.col("side")]
    for cut, at in (("1", third), ("2", 2 * third)):
        valid = (F.col("side") == "pre") & (at >= 4) & (at <= F.col("pre_n") - 4)
        tags.append(F.when(valid, F.when(F.col("idx") < at, f"a{cut}").otherwise(f"b{cut}")))
    return (
        both.join(sizes, [*keys, "_p"]) if sizes is not None else both
    ).select(*keys, "_p", "value", F.explode(F.array(*tags)).alias("seg")).where(F.col("seg").isNotNull())


def _wide(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series from rows (keys, _p, seg, n, mean, med, mad)."""
    out = []
    for p in ("l", "d"):
        for seg in SEGMENTS:
            here = (F.col("_p") == p) & (F.col("seg") == seg)
            out.append(F.max(F.when(here, F.col("med"))).alias(f"{p}_{seg}_med"))
            if seg in ("pre", "a1", "a2"):
                out.append((MAD_TO_SIGMA * F.max(F.when(here, F.col("mad")))).alias(f"{p}_{seg}_sigma"))
            if seg in ("pre", "post"):
                out.append(F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"{p}_{seg}_n"))
            if p == "l" and seg in ("pre", "post"):
                out.append(F.coalesce(F.max(F.when(here, F.col("mean"))), F.lit(0.0)).alias(f"{p}_{seg}_mean"))
    return stats.groupBy(*keys).agg(*out)


def _array_stats(points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Segment statistics of ordinary series: one shuffle by series, then all local."""
    keys = list(keys)
    placed = points.repartition(*keys)
    in_time = Window.partitionBy(*keys, "side").orderBy(*order, "value")
    whole = Window.partitionBy(*keys, "side")
    n = F.count(F.lit(1)).over(whole)
    rows = placed.select(
        *keys, "side", "value", (F.row_number().over(in_time) - 1).alias("idx"), n.alias("_n"),
        (F.col("value") - F.lag("value").over(in_time)).alias("_diff"))
    pair = F.array(
        F.struct(F.lit("l").alias("p"), "value", "idx", F.col("_n").alias("n")),
        F.struct(F.lit("d").alias("p"), F.col("_diff").alias("value"), (F.col("idx") - 1).alias("idx"), (F.col("_n") - 1).alias("n")))
    both = rows.select(*keys, "side", F.explode(pair).alias("x")).select(
        *keys, "side", F.col("x.p").alias("_p"), "x.value", "x.idx", F.col("x.n").alias("pre_n")).where(F.col("value").isNotNull())
    arrays = _segments(both, None, keys).groupBy(*keys, "_p", "seg").agg(F.sort_array(F.collect_list("value")).alias("v"), F.avg("value").alias("mean"))
    medians = arrays.withColumn("med", _median_of_sorted(F.col("v")))
    deviations = F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("med"))))
    stats = medians.select(*keys, "_p", "seg", "mean", "med", F.size("v").alias("n"), deviations.alias("dev"))
    return _wide(stats.withColumn("mad", _median_of_sorted(F.col("dev"))).drop("dev"), keys)


def _spread_stats(points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same statistics without arrays: positions, equi joins and exact ranks."""
    keys = list(keys)
    level = ordered_index(points.select(*keys, "side", *order, "value"), [*keys, "side"], [*order, "value"])
    level = level.select(*keys, "side", "idx", "value")
    shifted = level.select(*keys, "side", (F.col("idx") + 1).alias("idx"), F.col("value").alias("_prev"))
    slope = level.join(shifted, [*keys, "side", "idx"]).select(
        *keys, "side", (F.col("idx") - 1).alias("idx"), (F.col("value") - F.col("_prev")).alias("value"))
    both = level.withColumn("_p", F.lit("l")).unionByName(slope.withColumn("_p", F.lit("d")))
    both = checkpoint(both)
    sizes = both.groupBy(*keys, "_p").agg(F.count_if(F.col("side") == "pre").alias("pre_n"))
    tagged = checkpoint(_segments(both, sizes, keys))
    group = [*keys, "_p", "seg"]
    medians = exact_median(tagged, group, "value", "med")
    deviations = (
        tagged.where(F.col("seg").isin("pre", "a1", "a2")).join(medians, group)
        .select(*group, F.abs(F.col("value") - F.col("med")).alias("dev")))
    deviations = checkpoint(deviations)
    mads = exact_median(deviations, group, "dev", "mad").select(*group, "mad")
    means = tagged.groupBy(*group).agg(F.avg("value").alias("mean"))
    return _wide(medians.join(mads, group, "left").join(means, group), keys)


def effect_sizes(
    points: DataFrame, keys: Sequence[str], metric: str = "metric", order: Sequence[str] = ("time",),
    array_max: int = ARRAY_MAX,
) -> DataFrame:
    """``keys``, n_pre, n_post, pre_mean, post_mean, effect_z for points marked ``side`` = pre or post.

    ``metric`` must be one of ``keys``. Series larger than ``array_max`` take the
    spread path; both paths give the same numbers.
    """
    keys = list(keys)
    points = points.where(F.col("side").isNotNull() & F.col("value").isNotNull())
    points = points.withColumn("value", F.col("value").cast("double"))
    large = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > array_max).select(*keys)
    if array_max > 0 and large.isEmpty():
        return _combine(_array_stats(points, keys, order), keys, metric)
    large = checkpoint(large)
    small_stats = _array_stats(points.join(large, keys, "left_anti"), keys, order)
    large_stats = _spread_stats(points.join(large, keys, "left_semi"), keys, order)
    return _combine(small_stats, keys, metric).unionByName(_combine(large_stats, keys, metric))
