"""Order statistics, running sums and top-k that never sort a hot group in one task.

A plain window over ``incident_id`` sends every row of one incident to one task.
Ranks reduce each group to counts per bin with a map-side combine, order the bins,
and touch only the rows of one bin per target. Whatever follows an order (positions,
running sums, previous values, as-of look-ups) lays the rows out in range partitions
over (keys, order), which Spark balances by rows: each partition's part of a group is
swept alone, and totals per group and partition, which are few, carry over to the next
ones. A key that holds a third of the table, or one second of it, is spread over the
whole cluster all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from faultline.functions.expr import as_col
from faultline.session import checkpoint, store

# Bins per e-fold of the value. A bin spans a relative width of 1.5e-5, so the
# rows left to order exactly within one bin share almost five leading digits.
_BINS_PER_EFOLD = 65536
BROADCAST_ROWS = 200_000
SUBBINS = 65536  # steps a located bin is cut into
_SHIFT = 746 * _BINS_PER_EFOLD  # ln of the smallest double is above -746


_EDGE = 4 * _SHIFT  # beyond the bin of any finite double


def value_bin(value: Column) -> Column:
    """A monotone integer bin of a double; equal values share a bin.

    The infinities and NaN have bins of their own, in Spark's order: NaN comes last.
    """
    finite = F.when(F.abs(value) < float("inf"), value)
    scaled = F.floor(F.ln(F.abs(finite)) * _BINS_PER_EFOLD) + F.lit(_SHIFT)
    return (
        F.when(F.isnan(value), F.lit(_EDGE + 1)).when(value == float("inf"), F.lit(_EDGE)).when(value == float("-inf"), F.lit(-_EDGE))
        .when(value == 0, F.lit(0).cast("long")).when(value > 0, scaled).otherwise(-scaled))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a null key meets a null key; the keys are the left side's."""
    renamed = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(renamed[f"_r{i}"])
    return left.join(renamed, same).drop(*[f"_r{i}" for i in range(len(keys))])


def p95_rank(n: Column) -> Column:
    """1-based rank of the 95th percentile: index ``min(n-1, int(0.95 n))``."""
    return F.least(n, (F.floor(F.lit(0.95) * n) + 1).cast("long"))


def low_median_rank(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("long")


def high_median_rank(n: Column) -> Column:
    return (F.floor(n / 2) + 1).cast("long")


def _located(hist: DataFrame, group: Sequence[str], rank: Column) -> DataFrame:
    """The bin of ``hist`` (group, _b, _c, _lo, _hi) that holds the ``rank``-th row, with the rank inside it."""
    running = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_cum") - F.col("_c")
    return hist.withColumn("_cum", F.sum("_c").over(running)).where((rank <= F.col("_cum")) & (rank > before)).withColumn("_rank", rank - before)


def exact_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Exact order statistics per group: ``keys``, ``n`` and one column per rank.

    Counts of rows per (group, bin), with each bin's least and largest value, locate every
    target. A bin of one value answers at once. For the others one more pass writes the
    distinct values inside the located bins with their counts, and the bin is cut into
    ``SUBBINS`` equal steps between its ends until the step that holds the target is a
    single value; a bin always falls into two at least. No task orders more than the
    bins of one target. Few targets are broadcast, so the second pass shuffles next to nothing; above ``BROADCAST_ROWS`` the distinct values are counted first and joined
    by (group, bin), which no single group can overload; the result is the same either way.
    Group keys may be null. Null values are left out; infinities and NaN are values, NaN
    the largest.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_bin", value_bin(F.col("_v")))
    hist = rows.groupBy(*keys, F.col("_bin").alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()])
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = hist.withColumns({"_cum": F.sum("_c").over(running), "n": F.sum("_c").over(Window.partitionBy(*keys))})
    asked = F.col("_t.rank")
    targets = checkpoint(
        placed.withColumn("_t", F.explode(wanted)).where((asked <= F.col("_cum")) & (asked > F.col("_cum") - F.col("_c"))).select(
            *[F.col(k).alias(a) for k, a in zip(keys, names)], F.col("_b").alias("_tbin"), "n", F.col("_t.name").alias("_name"),
            (asked - (F.col("_cum") - F.col("_c"))).alias("_rank"), "_lo", "_hi"))
    spot = [*names, "_tbin", "n", "_name"]
    found, near = [], None
    while True:
        found.append(targets.where(F.col("_lo") == F.col("_hi")))
        open_ = targets.where(F.col("_lo") != F.col("_hi"))
        left = open_.count()
        if not left:
            break
        bounds = open_.select(*spot, F.col("_rank").alias("_want"), F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        few = F.broadcast if left <= BROADCAST_ROWS else (lambda frame: frame)
        if near is None:
            same = F.col("_bin") == F.col("_tbin")
            for k, a in zip(keys, names):
                same = same & F.col(k).eqNullSafe(F.col(a))
            counted = rows.withColumn("_c", F.lit(1).cast("long"))
            if left > BROADCAST_ROWS:
                counted = rows.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
            met = counted.join(few(bounds), same)
            near = store(met.groupBy(*names, "_name", "_v").agg(F.sum("_c").alias("_c")), "near")
        met = null_safe_join(near, few(bounds), [*names, "_name"]).where(F.col("_v").between(F.col("_from"), F.col("_to")))
        sub = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * SUBBINS)
        cut = met.select(*spot, "_want", "_c", "_v", sub.alias("_b")).groupBy(*spot, "_want", "_b").agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        targets = checkpoint(_located(cut, [*names, "_name"], F.col("_want")).select(*spot, "_rank", "_lo", "_hi"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy(*names).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in ranks],
    ).withColumnsRenamed(dict(zip(names, keys)))


def exact_p95(df: DataFrame, keys: Sequence[str], value: str = "duration_ms", name: str = "p95") -> DataFrame:
    return exact_ranks(df, keys, value, {name: p95_rank})


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    both = exact_ranks(df, keys, value, {"_lo": low_median_rank, "_hi": high_median_rank})
    return both.withColumn(name, (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows with ``_part``, the range partition over (keys, order) they fall in; lower parts come first.

    Parts are balanced by rows wherever their keys or times lie. Rows that are equal in
    the order are told apart by a hash of the whole row, so only rows equal in every
    column cannot be split. Nulls come first. The boundaries are sampled, so the result
    is written once and every later step reads the same parts.
    """
    whole = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *[as_col(o) for o in order], F.xxhash64(*whole))
    return store(spread.withColumn("_part", F.spark_partition_id()), "parts")


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "idx") -> DataFrame:
    """0-based position of each row in its group, in ``order``.

    Offsets come from counts per group and part; only one part of a group is sorted at a
    time. Keys and order may be null: a null key is a key like any other.
    """
    keys = list(keys)
    laid = range_parts(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*[as_col(o) for o in order])
    return (
        null_safe_join(laid, offsets, [*keys, "_part"])
        .withColumn(out, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_off", "_part")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in ``order``, by totals of parts plus a local window. Keys and order may be null."""
    keys = list(keys)
    laid = range_parts(df.select("*", *[c.alias(f"_x_{name}") for name, c in sums.items()]), keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(*keys, "_part").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    carried = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(*[as_col(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = null_safe_join(laid, carried, [*keys, "_part"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.sum(f"_x_{n}").over(inside)).alias(n) for n in sums],
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str | None = None,
    salt: Sequence[str] = (),
) -> DataFrame:
    """First ``k`` rows of each group.

    A small constant ``k`` lets Spark limit each group before the shuffle. Any
    other ``k`` is a bound on the position in the group, which :func:`ordered_index`
    finds in parts, so that no task orders a hot group.
    """
    name = rank or "_rn"
    if not isinstance(k, int) or k > 1000:
        placed = ordered_index(df, keys, order, name).withColumn(name, F.col(name) + 1).where(F.col(name) <= k)
        return placed.withColumn(name, F.col(name).cast("int")) if rank else placed.drop(name)
    full = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(name, F.row_number().over(full)).where(F.col(name) <= k)
    return top if rank else top.drop(name)


def latest_before(
    probes: DataFrame, events: DataFrame, keys: Sequence[str], at: str, time: str, payload: Sequence[str],
    strict: bool = False, tie: str | None = None,
) -> DataFrame:
    """As-of look-up: ``probes`` plus ``found`` (struct of ``payload``), the latest event at or before ``at``.

    Events and probes are laid out together in range parts and swept once, so no
    pairs are formed; a part takes over the last event of the parts before it.
    Of events at the same time the smallest ``tie`` wins. ``strict`` excludes
    events at exactly ``at``. Every probe comes back: with a null key or a null ``at`` it
    finds nothing. Events with a null time are before no probe.
    """
    keys = list(keys)
    events = events.where(F.col(time).isNotNull())
    tied = F.col(tie) if tie else F.lit(0)
    item = F.struct(*payload)
    moments = events.select(*keys, F.col(time).alias("_at"), tied.alias("_tie"), item.alias("_item"), F.lit(None).alias("_row"))
    asked = probes.select(
        *keys, F.col(at).alias("_at"), F.lit(None).cast(moments.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(moments.schema["_item"].dataType).alias("_item"), F.struct(*probes.columns).alias("_row"))
    both = moments.withColumn("_row", F.col("_row").cast(asked.schema["_row"].dataType)).unionByName(asked)
    both = both.withColumn("_probe", F.col("_row").isNotNull())
    place = F.when(F.col("_probe"), 0 if strict else 2).otherwise(1)
    order = ["_at", place, F.col("_tie").desc()]
    laid = range_parts(both, keys, order)
    sweep = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.min_by("_item", F.when(~F.col("_probe"), F.struct((-F.col("_at")).alias("a"), "_tie")))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = laid.groupBy(*keys, "_part").agg(newest.alias("_new")).select(
        *keys, "_part", F.last("_new", ignorenulls=True).over(earlier).alias("_carried"))
    swept = laid.select(*keys, "_part", "_probe", "_row", F.last("_item", ignorenulls=True).over(sweep).alias("_here")).where("_probe")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    met = null_safe_join(swept, carried, [*keys, "_part"])
    return met.select("_row.*", F.when(known, F.coalesce("_here", "_carried")).alias("found"))


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``prev_<column>``: the value on the row before, in ``order``.

    Windows stay inside one part; the first row of a group's part takes the last row of
    its part before. Keys and order may be null.
    """
    keys = list(keys)
    laid = range_parts(df, keys, order)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    between = Window.partitionBy(*keys).orderBy("_part")
    ends = laid.groupBy(*keys, "_part").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_end")).select(
        *keys, "_part", F.lag("_end").over(between).alias("_end"))
    marked = laid.withColumns({"_before": F.lag(F.struct(*columns)).over(inside), "_lead": F.row_number().over(inside) == 1})
    staged = null_safe_join(marked, ends, [*keys, "_part"])
    prev = F.when(F.col("_lead"), F.col("_end")).otherwise(F.col("_before"))
    return staged.withColumn("_prev", prev).select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])
