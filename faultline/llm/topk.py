"""Exact top-k inner products of whole-number vectors by columnar branch and bound.

Vectors lie in blocks, dimension by dimension. For a chunk of queries a block is read a
few dimensions at a time; what the dimensions still to come can add is at most the
product of the two remaining norms. Candidates whose bound falls below the query's
k-th best score so far leave, and the rest are compacted before the next dimensions.
A first k-th best comes from a bounded set of seed vectors; being scores of real
candidates it can only be too low, so results are exact.

Each chunk of queries meets each block once, in a product of chunks and parts of blocks
that copies neither side: every task reads its part of the blocks again. Nothing is
broadcast, and what a task finds is merged before it leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.vectors import matrix, once, packed, ranked, sound
from faultline.session import store

STEP = 16  # dimensions read at a time
PART_BYTES = 32 << 20  # blocks that a task holds
LONG = 1 << 63


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as floating numbers, exact as long as the product is finite; an overflowing one saturates."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -np.finfo(float).max, np.finfo(float).max)


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products too large for exact floating sums, in Python's whole numbers, cut to the range of a long."""
    as_int = np.frompyfunc(int, 1, 1)
    return np.clip(as_int(q) @ as_int(x), -LONG, LONG - 1).astype(np.int64)


def best_in_block(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query, candidate and score of each query's ``k`` best in a block that reach ``floor``; ties to the smaller id."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    picked: list[tuple[int, np.ndarray, np.ndarray]] = []
    if size >= 2**53:
        scores = _exact_scores(q, x.T)
        for i in range(len(q)):
            picked.append((i, np.flatnonzero(x_ids != q_ids[i]), scores[i]))
        picked = [(i, at, s[at]) for i, at, s in picked]
    else:
        kind = np.float32 if size < 2**24 else np.float64
        columns, wanted = np.ascontiguousarray(x.T, kind), q.astype(kind)
        cuts = [*range(0, q.shape[1], STEP), q.shape[1]]
        left = [(np.sqrt((q[:, c:] ** 2).sum(1)), np.sqrt((x[:, c:] ** 2).sum(1)) * (1 + 1e-9)) for c in cuts[1:]]
        first = wanted[:, : cuts[1]] @ columns[: cuts[1]]
        for i in range(len(q)):
            alive = np.flatnonzero((first[i] + left[0][0][i] * left[0][1] >= floor[i]) & (x_ids != q_ids[i]))
            score, limit = first[i][alive], floor[i]
            for b in range(1, len(cuts) - 1):
                if not len(alive):
                    break
                block = columns[cuts[b] : cuts[b + 1]]
                score = score + wanted[i, cuts[b] : cuts[b + 1]] @ (block if len(alive) == len(x_ids) else block[:, alive])
                reach = left[b][0][i] * left[b][1][alive]
                if len(alive) > k:  # the k-th best of what is certain also bounds
                    limit = max(limit, np.partition(score - reach, len(alive) - k)[len(alive) - k])
                keep = score + reach >= limit - 1e-6 * abs(limit)
                alive, score = alive[keep], score[keep]
            picked.append((i, alive, score))
    rows, cols, values = [], [], []
    for i, at, score in picked:
        order = np.lexsort((x_ids[at], -score.astype(np.int64) if size < 2**53 else [-int(s) for s in score]))[:k]
        rows.append(np.full(len(order), i))
        cols.append(at[order])
        values.append(score[order].astype(np.int64))
    return np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64), np.concatenate(values)


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers row by row, in two bytes each where all fit, else as doubles."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<f8").tobytes()


def _matrix(data: bytes, n: int, width: int) -> np.ndarray:
    """The ``n`` rows of ``_bytes`` again, as doubles."""
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * width else "<f8").reshape(n, width).astype(float)


def _merged(k: int, *found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query in several results of ``best_in_block``, each candidate and score once."""
    at, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, ~score, at))  # ~ falls as scores rise, and cannot overflow
    at, ids, score = at[order], ids[order], score[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(ids) != 0) | (score[1:] != score[:-1])
    at, ids, score = at[new], ids[new], score[new]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], score[keep]


def _raised(floor: np.ndarray, k: int, at: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Floors after these ``k`` best: a query that has ``k`` needs no score below its last one."""
    full = np.bincount(at, minlength=len(floor)) == k
    lowest = np.where(full, np.inf, -np.inf)
    np.minimum.at(lowest, at, score.astype(float))
    return np.maximum(floor, lowest - 1e-9 * np.where(full, np.abs(lowest), 0))


def top_k(table: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding",
          block: int = 4096, chunk: int = 1024, seeds: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): each query's ``k`` largest inner products of floor(scale * component).

    Candidates are all rows of ``table`` with another id; fewer than ``k`` give as many
    rows. Ties go to the smaller vec_id. Vectors that are null, empty or hold a null or
    non-finite component, and rows without an id, take no part on either side; zero
    vectors do. A shorter vector counts as filled with zeros. Repeated rows count once;
    of several queries with one id the least vector is taken. A score beyond a long is
    cut to its range. Other columns are not read. Empty tables give an empty result.
    ``seeds`` bounds the rows that first thresholds come from.
    """
    base = store(sound(table, id_col, vec_col, zero=True), "vectors")
    asked = store(once(sound(queries, id_col, vec_col, zero=True)), "queries")
    width = max(1, base.agg(F.max(F.size("v"))).first()[0] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ids in zip(batch.column("data"), batch.column("ids")):
                x = whole(np.frombuffer(data.as_buffer()), scale)
                yield pa.record_batch([pa.array([ids.as_py()], pa.binary()), pa.array([_bytes(x)], pa.binary())], ["ids", "data"])

    blocks = store(packed(base, width, block).mapInArrow(numbers, "ids binary, data binary"), "blocks")
    shape = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes")).first()
    if not shape.n:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    some = base.orderBy(F.xxhash64("id")).limit(seeds).toArrow()
    seed_ids = some.column("id").to_numpy()
    seed = whole(matrix(some.column("v").combine_chunks(), width), scale)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                q = whole(np.frombuffer(batch.column("data")[i].as_py()).reshape(len(ids), width), scale)
                floor = np.full(len(ids), -np.inf)
                if len(seed_ids) > k:
                    at, of, score = best_in_block(ids, q, floor, seed_ids, seed, k)
                    at, _, score = _merged(k, (at, seed_ids[of], score))
                    floor = _raised(floor, k, at, score)
                yield pa.record_batch([pa.array([x], pa.binary()) for x in (ids.tobytes(), _bytes(q), floor.astype("<f8").tobytes())], ["q_ids", "q", "floor"])

    chunks = store(packed(asked, width, chunk).mapInArrow(floors, "q_ids binary, q binary, floor binary"), "chunks")
    n_chunks = max(1, chunks.count())
    spread = -(-2 * table.sparkSession.sparkContext.defaultParallelism // n_chunks)  # parts that give every core two tasks
    parts = max(-(-shape.bytes // PART_BYTES), min(shape.n, spread))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None  # of the chunk at hand; its rows follow each other

        def found() -> pa.RecordBatch:
            at, ids, score = best
            return pa.record_batch([pa.array(q_ids[at]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if r["q_ids"] != key:
                    if key is not None:
                        yield found()
                    key = r["q_ids"]
                    q_ids, floor = np.frombuffer(key, "<i8"), np.frombuffer(r["floor"])
                    q = _matrix(r["q"], len(q_ids), width)
                    best = tuple(np.zeros(0, np.int64) for _ in range(3))
                ids = np.frombuffer(r["ids"], "<i8")
                at, of, score = best_in_block(q_ids, q, floor, ids, _matrix(r["data"], len(ids), width), k)
                best = _merged(k, best, (at, ids[of], score))
                floor = _raised(floor, k, best[0], best[2])
        if key is not None:
            yield found()

    met = chunks.repartition(n_chunks).crossJoin(blocks.repartition(parts).hint("shuffle_replicate_nl"))
    return ranked(met.mapInArrow(scan, "query_id long, vec_id long, score long"), k)
