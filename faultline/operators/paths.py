"""Depth and place of spans in the parent forest, by pointer doubling.

Each round joins the pointer table with itself and doubles the distance every
pointer covers, so a forest of depth d needs about log2(d) rounds. Rounds are
checkpointed; only two counters per round reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from faultline.functions.ordered import ordered_index, previous_value
from faultline.session import checkpoint, store


def _climb(nodes: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Lift pointers until every acyclic node knows its top.

    ``nodes`` holds one row per node that has a parent in the forest:
    keys, id, anc (ancestor so far, null when finished), hops, and top (the root
    reached) if ``carry`` names it.
    Returns the table and whether unfinished (cyclic) nodes remain.
    """
    keys, carry = list(keys), list(carry)
    table = checkpoint(nodes.select(*keys, "id", "anc", "hops", *carry))
    live = table.where(F.col("anc").isNotNull()).count()
    while live:
        ahead = table.select(
            *keys, F.col("id").alias("anc"), F.lit(True).alias("_hit"), F.col("anc").alias("_anc"), F.col("hops").alias("_hops"),
            *[F.col(c).alias(f"_{c}") for c in carry])
        reached = F.when(F.col("_hit").isNull(), F.col("anc")).otherwise(F.col("_top")) if carry else None
        moved = table.where(F.col("anc").isNotNull()).join(ahead, [*keys, "anc"], "left").select(
            *keys, "id", F.col("_anc").alias("anc_next"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            *[reached.alias(c) for c in carry]).withColumnRenamed("anc_next", "anc")
        table = checkpoint(table.where(F.col("anc").isNull()).unionByName(moved))
        left = table.where(F.col("anc").isNotNull()).count()
        if left == live:
            return table, True
        live = left
    return table, False


def _pointers(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of spans whose parent exists in the same key group."""
    ids = spans.select(*keys, F.col("span_id").alias("parent_span_id")).distinct()
    linked = spans.where(F.col("parent_span_id").isNotNull()).join(ids, [*keys, "parent_span_id"], "left_semi")
    return linked.select(
        *keys, F.col("span_id").alias("id"), F.col("parent_span_id").alias("anc"),
        F.lit(1).cast("long").alias("hops"), F.lit(None).cast("string").alias("top"),
    )


def _cycle_depths(live: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth of nodes that run into a parent cycle: steps to the cycle plus its length."""
    keys = list(keys)
    ids = [*keys, "id"]
    base = checkpoint(links.join(live.select(*ids), ids, "left_semi").select(*ids, "anc"))
    jump, size = base, -1
    while True:
        image = jump.select(*keys, F.col("anc").alias("id")).distinct().count()
        if image == size:
            break
        size = image
        ahead = jump.select(*keys, F.col("id").alias("anc"), F.col("anc").alias("_next"))
        jump = checkpoint(jump.join(ahead, [*keys, "anc"]).select(*ids, F.col("_next").alias("anc")))
    ring = checkpoint(jump.select(*keys, F.col("anc").alias("id")).distinct())
    labels = base.join(ring, ids, "left_semi").withColumn("label", F.least("id", "anc"))
    for _ in range(max(1, size.bit_length())):
        ahead = labels.select(*keys, F.col("id").alias("anc"), F.col("anc").alias("_next"), F.col("label").alias("_label"))
        labels = checkpoint(labels.join(ahead, [*keys, "anc"]).select(
            *ids, F.col("_next").alias("anc"), F.least("label", "_label").alias("label")
        ))
    lengths = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("length"))
    on_ring = labels.select(*ids, "label").join(lengths, [*keys, "label"]).select(*ids, F.col("length").alias("depth"))
    tails = base.join(ring, ids, "left_anti").select(
        *ids, "anc", F.lit(1).cast("long").alias("hops"), F.lit(None).cast("string").alias("top"),
    )
    climbed, _ = _climb(tails, keys, carry=("top",))
    ring_depth = on_ring.select(*keys, F.col("id").alias("top"), F.col("depth").alias("_ring"))
    tail_depths = climbed.join(ring_depth, [*keys, "top"]).select(*ids, (F.col("hops") + F.col("_ring")).alias("depth"))
    return on_ring.unionByName(tail_depths)


def span_depths(spans: DataFrame) -> DataFrame:
    """(incident_id, span_id, depth): parent hops inside the incident, cycle safe."""
    keys = ["incident_id"]
    links = _pointers(spans, keys)
    climbed, cyclic = _climb(links, keys, carry=())
    depths = climbed.where(F.col("anc").isNull()).select(*keys, F.col("id").alias("span_id"), F.col("hops").alias("depth"))
    if cyclic:
        rest = _cycle_depths(climbed.where(F.col("anc").isNotNull()), links, keys)
        depths = depths.unionByName(rest.select(*keys, F.col("id").alias("span_id"), "depth"))
    ids = spans.select(*keys, "span_id")
    return ids.join(depths, [*keys, "span_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def leaf_depths(leaves: DataFrame, spans: DataFrame, climbs: int = 16) -> DataFrame:
    """(incident_id, span_id, depth) of ``leaves``: parent hops inside the incident, by climbing from the leaves.

    Each round joins the leaves that still climb to their ancestors' parents, so no span
    is read into a result that is not an ancestor of a leaf, and a round's rows are
    written once. Leaves that still climb after ``climbs`` rounds are very deep or run
    into a cycle; pointer doubling over their incidents tells their depths.
    """
    keys = ["incident_id"]
    start = leaves.select(*keys, "span_id", "parent_span_id").distinct()
    touched = leaves.select(*keys).distinct()
    links = store(spans.join(touched, keys, "left_semi").select(*keys, F.col("span_id").alias("anc"), F.col("parent_span_id").alias("_next")).distinct(), "links")
    climbed = start.select(*keys, "span_id", F.lit(0).cast("long").alias("depth"))
    live = start.select(*keys, "span_id", F.col("parent_span_id").alias("anc")).where(F.col("anc").isNotNull())
    for hop in range(1, climbs + 1):
        step = store(live.join(links, [*keys, "anc"]).select(*keys, "span_id", F.col("_next").alias("anc")).distinct(), "climb")
        climbed = climbed.unionByName(step.select(*keys, "span_id", F.lit(hop).cast("long").alias("depth")))
        live = step.where(F.col("anc").isNotNull())
        if live.isEmpty():
            return climbed.groupBy(*keys, "span_id").agg(F.max("depth").alias("depth"))
    rest = live.select(*keys, "span_id").distinct()
    known = climbed.join(rest, [*keys, "span_id"], "left_anti").groupBy(*keys, "span_id").agg(F.max("depth").alias("depth"))
    doubled = span_depths(spans.join(rest.select(*keys).distinct(), keys, "left_semi"))
    return known.unionByName(doubled.join(rest, [*keys, "span_id"], "left_semi").distinct())


def list_sums(cells: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(keys, cell, sums) of linked lists: each cell's sums from the head of its list up to itself.

    ``cells``: keys, cell, prev (the cell before, null at a head) and the columns to add
    up. Every round doubles the stretch that a cell has added up, so a list of n cells
    takes log2(n) rounds; a cell that has reached its head is written once and only
    looked up after that. Cells of a ring have no head and are left out.
    """
    keys, sums = list(keys), list(sums)
    columns = [*keys, "cell", "prev", *sums]
    table = store(cells.select(*columns), "cells")
    done, live = [table.where(F.col("prev").isNull())], table.where(F.col("prev").isNotNull())
    left = live.count()
    while left:
        known = live
        for part in done:
            known = known.unionByName(part)
        ahead = known.select(
            *keys, F.col("cell").alias("prev"), F.col("prev").alias("_prev"), *[F.col(c).alias(f"_{c}") for c in sums])
        step = store(live.join(ahead, [*keys, "prev"]).select(
            *keys, "cell", F.col("_prev").alias("prev"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]), "cells")
        done.append(step.where(F.col("prev").isNull()))
        live = step.where(F.col("prev").isNotNull())
        before, left = left, live.count()
        if left == before:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("prev")


def tour(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``spans`` with ``position`` (from 0) and ``depth`` in a depth-first walk of each group's forest.

    Siblings and roots stand in order of (time, span_id). The walk is an Euler tour: a
    list that enters and leaves every span once, linked from siblings, last children and
    parents. Counting the entries along the list gives the position, entries less exits
    the depth, so a row stays the same size however deep its tree is. A span whose parent
    is unknown is a root. Where an id repeats, children hang below its first row, and
    each row is listed. Spans caught in a parent cycle hang below no root and are left
    out. Keys must not be null.
    """
    keys = list(keys)
    rows = store(ordered_index(spans, keys, ["time", "span_id"], "_node"), "nodes")
    owners = store(
        rows.where(F.col("span_id").isNotNull()).groupBy(*keys, F.col("span_id").alias("parent_span_id")).agg(F.min("_node").alias("_up")), "owners")
    linked = rows.select(*keys, "_node", "parent_span_id").join(owners, [*keys, "parent_span_id"], "left").select(*keys, "_node", "_up")
    placed = previous_value(linked, [*keys, "_up"], ["_node"], ["_node"])
    last = linked.where(F.col("_up").isNotNull()).groupBy(*keys, F.col("_up").alias("_node")).agg(F.max("_node").alias("_last"))
    enter, leave = 2 * F.col("_node"), 2 * F.col("_node") + 1
    entry = F.struct(
        enter.alias("cell"), F.coalesce(2 * F.col("prev__node") + 1, 2 * F.col("_up")).alias("prev"),
        F.lit(1).cast("long").alias("position"), F.lit(1).cast("long").alias("depth"))
    way_out = F.struct(
        leave.alias("cell"), F.coalesce(2 * F.col("_last") + 1, enter).alias("prev"),
        F.lit(0).cast("long").alias("position"), F.lit(-1).cast("long").alias("depth"))
    cells = placed.join(last, [*keys, "_node"], "left").select(*keys, F.explode(F.array(entry, way_out)).alias("c")).select(*keys, "c.*")
    walked = list_sums(cells, keys, ["position", "depth"]).where(F.col("cell") % 2 == 0).select(
        *keys, F.shiftright("cell", 1).alias("_node"), (F.col("position") - 1).alias("position"), (F.col("depth") - 1).alias("depth"))
    return rows.join(walked, [*keys, "_node"]).drop("_node")
