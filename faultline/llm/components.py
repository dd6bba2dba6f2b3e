"""Connected components of a graph given as pairs: local forests, then alternating stars.

Every task first turns each portion of its pairs, of bounded size, into stars with the
same components. If there was one portion that is the answer; else rounds follow that hang
every node's larger neighbours, then its smaller ones, on the least neighbour, until
nothing changes. Only least values are aggregated and joined back, so a node with very
many neighbours is one partial minimum per task, and its rows are split in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import store


PORTION = 100_000


def _forest(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each node but the roots to the least node of its component."""
    up: dict[int, int] = {}

    def find(node: int) -> int:
        path = []
        while (parent := up.get(node, node)) != node:
            path.append(node)
            node = parent
        for p in path:
            up[p] = node
        return node

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {node: find(node) for node in list(up)}


def _stars(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        found = _forest(held)
        held.clear()
        return pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["u", "v"])

    for batch in batches:
        for at in range(0, batch.num_rows, portion):
            part = batch.slice(at, portion)
            if len(held) + part.num_rows > portion:
                yield flush()
            held += zip(part.column("u").to_pylist(), part.column("v").to_pylist())
    if held:
        yield flush()


def _hang(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with the least v of each u, which is also the least of u itself where smaller."""
    least = arcs.groupBy("u").agg(F.min("v").alias("least"))
    return arcs.join(least, "u").withColumn("least", F.least("least", "u"))


def _larger(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hang(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")


def _smaller(pairs: DataFrame) -> DataFrame:
    hung = _hang(pairs)
    moved = hung.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(hung.select("u", F.col("least").alias("v"))).distinct()


def _mark(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def components(pairs: DataFrame, portion: int = PORTION, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that some pair (a, b) names; the root is the least node of its component.

    Pairs may repeat, come either way round, or join a node to itself (left out). Pairs
    with a null are left out. Without pairs the result is empty.
    """
    now = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v and a is not null and b is not null").distinct()
    now = store(now, "pairs")
    n = now.count()
    now = store(now.coalesce(n // portion + 1).mapInArrow(lambda batches: _stars(batches, portion), "u long, v long"), "stars")
    mark = _mark(now)
    for _ in range(most_rounds):
        if n <= portion:
            break
        now = store(_smaller(_larger(now)), "stars")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
