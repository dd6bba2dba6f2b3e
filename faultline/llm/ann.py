"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

* Every vector gets one more dimension that fills its norm up to the largest one; then the
  nearest in distance is the largest in inner product, whatever the norms.
* Centroids of the lists are fitted on a bounded sample of rows; every row is indexed, and
  lists are kept in blocks of bounded size, so that a list with very many rows is many rows
  of the index.
* Vectors are rotated at random and stored in column blocks. Within a probed list the
  distances to a query grow column block by column block. A partial distance, scaled to all
  dimensions, is tested against the hypothesis that the full one still reaches the query's
  k-th best; candidates for which that is rejected are abandoned. What survives is scored on
  the original vectors in double precision.
* A query's nearest list is scanned first, for the k-th best that the tests in its other
  lists need. How many lists are probed is measured: enough for ``recall`` of the true
  neighbours of a bounded set of calibration queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.vectors import matrix, once, ranked, sound
from faultline.session import store

COLUMNS = 16  # dimensions of a column block
DENSE = 0.05  # below this share of survivors only they are read on


@dataclass(frozen=True)
class Space:
    """What every task knows: bounded by the number of lists and dimensions."""

    width: int
    top: float  # largest squared norm
    turn: np.ndarray
    centroids: np.ndarray

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """The extra dimension: what is missing to the largest norm, or 0 for a query."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.column_stack([x, more])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of lifted rows to all centroids, but for a constant per row."""
        return (self.centroids**2).sum(1)[None, :] - 2 * x @ self.centroids.T


def fit_space(base: DataFrame, width: int, lists: int, sample: int, rounds: int = 12) -> Space:
    """Centroids by k-means over at most ``sample`` rows, those of the smallest hash; a fixed random rotation."""
    top = base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.standard_normal((width + 1, width + 1)))[0]
    space = Space(width, top, turn, np.zeros((1, width + 1)))
    rows = base.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = space.lift(matrix(rows.column("v").combine_chunks(), width), False) if rows.num_rows else np.zeros((1, width + 1))
    centres = x[rng.permutation(len(x))[: max(1, min(lists, len(x)))]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return Space(width, top, turn, centres)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed from the first dimension to the last."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out = out + q[:, d] * x[:, d]
    return out


def adaptive_scan(space: Space, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, x_ids: np.ndarray, x: np.ndarray, turned: np.ndarray, k: int, doubt: float) -> tuple[np.ndarray, ...]:
    """(query row, candidate row, score) of each query's ``k`` best in a block with a score of ``floor`` or more."""
    wanted = (space.lift(q, True) @ space.turn).astype(np.float32)
    full = space.width + 1
    reach = (q * q).sum(1) + space.top - 2 * floor  # squared distance of the k-th best so far
    alive = x_ids[None, :] != q_ids[:, None]
    partial = np.zeros(alive.shape, np.float32)
    at = of = got = None
    for lo in range(0, full, COLUMNS):
        hi = min(lo + COLUMNS, full)
        a, b = wanted[:, lo:hi], turned[:, lo:hi]
        factor = (1 + doubt / np.sqrt(hi)) ** 2 * hi / full if hi < full else 1 + 1e-4
        limit = np.maximum(reach, 0) * factor + 1e-5 * (1 + space.top)
        if at is None:
            partial += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            alive &= partial <= limit[:, None]
            if alive.mean() < DENSE or hi == full:
                at, of = np.nonzero(alive)
                got = partial[at, of]
        else:
            got = got + ((a[at] - b[of]) ** 2).sum(1)
            stay = got <= limit[at]
            at, of, got = at[stay], of[stay], got[stay]
    score = np.zeros(len(at))
    for s in range(0, len(at), 1 << 15):
        score[s : s + (1 << 15)] = exact(q[at[s : s + (1 << 15)]], x[of[s : s + (1 << 15)]])
    good = score >= floor[at]
    at, of, score = at[good], of[good], score[good]
    order = np.lexsort((x_ids[of], -score, at))
    at, of, score = at[order], of[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], of[keep], score[keep]


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return matrix(column if isinstance(column, pa.ListArray) else column.combine_chunks(), width)


def build_index(base: DataFrame, space: Space, block: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """Stored blocks (list, sub, ids, vectors and their rotated column blocks), and the number of blocks and of rows of each list."""
    width = space.width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = space.distances(space.lift(_floats(batch.column("v"), width), False)).argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(near, pa.int32())], ["id", "v", "list"])

    rows = store(base.mapInArrow(assign, "id long, v array<double>, list int"), "assigned")
    sizes = {r.list: r.n for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
    blocks = {x: -(-n // block) for x, n in sizes.items()}
    parts = base.sparkSession.createDataFrame(list(blocks.items()) or [(0, 1)], "list int, parts int")
    subs = rows.join(F.broadcast(parts), "list").withColumn("sub", F.pmod(F.xxhash64("id"), "parts").cast("int"))  # parts: a row per list
    grouped = subs.groupBy("list", "sub").agg(F.collect_list(F.struct("id", "v")).alias("rows"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = batch.column("rows")[i].values
                x = _floats(values.field("v"), width)
                turned = (space.lift(x, False) @ space.turn).astype("<f4")
                columns = [turned[:, lo : lo + COLUMNS].tobytes() for lo in range(0, width + 1, COLUMNS)]
                yield pa.record_batch([
                    batch.column("list").slice(i, 1), batch.column("sub").slice(i, 1), pa.array([values.field("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                    pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([columns], pa.list_(pa.binary())),
                ], ["list", "sub", "ids", "data", "columns"])

    index = grouped.mapInArrow(turn, "list int, sub int, ids binary, data binary, columns array<binary>")
    return store(index, "index"), blocks, sizes


def _scan(index: DataFrame, blocks: dict[int, int], probes: DataFrame, space: Space, k: int, doubt: float, chunk: int = 256) -> DataFrame:
    """Each probing query (list, id, v, floor) against all blocks of the list; both sides come in bounded packs."""
    spark, width = index.sparkSession, space.width
    asked = {r.list: r.n for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
    known = spark.createDataFrame([(x, b, -(-asked.get(x, 0) // chunk) or 1) for x, b in blocks.items()] or [(0, 1, 1)], "list int, parts int, chunks int")
    split = probes.join(F.broadcast(known), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
    packs = split.groupBy("list", "chunk", "parts").agg(F.collect_list(F.struct("id", "v", "floor")).alias("asked"))
    sent = packs.select("list", "asked", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                x = np.frombuffer(batch.column("data")[i].as_py()).reshape(len(ids), width)
                turned = np.concatenate([np.frombuffer(c, "<f4").reshape(len(ids), -1) for c in batch.column("columns")[i].as_py()], axis=1)
                wanted = batch.column("asked")[i].values
                q_ids, floor = wanted.field("id").to_numpy(), wanted.field("floor").to_numpy()
                at, of, score = adaptive_scan(space, q_ids, _floats(wanted.field("v"), width), floor, ids, x, turned, k, doubt)
                yield pa.record_batch([pa.array(q_ids[at]), pa.array(ids[of]), pa.array(score)], ["query_id", "vec_id", "score"])

    met = index.join(sent, ["list", "sub"]).select("ids", "data", "columns", "asked")
    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def probes_needed(base: DataFrame, asked: DataFrame, space: Space, k: int, recall: float, calibration: int) -> int:
    """Lists to probe so that ``recall`` of the true neighbours of ``calibration`` queries lie in them."""
    rows = asked.orderBy(F.xxhash64("id"), "id").limit(calibration).toArrow()
    if not rows.num_rows:
        return 1
    ids, q, width = rows.column("id").to_numpy(), _floats(rows.column("v"), space.width), space.width

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, x_ids = _floats(batch.column("v"), width), batch.column("id").to_numpy()
            near = space.distances(space.lift(x, False)).argmin(1)
            scores = np.where(x_ids[None, :] == ids[:, None], -np.inf, q @ x.T)
            for i in range(len(ids)):
                top = np.argpartition(-scores[i], min(k, len(x) - 1))[:k]
                top = top[np.isfinite(scores[i][top])]
                yield pa.record_batch([pa.array(np.full(len(top), ids[i])), pa.array(near[top].astype(np.int64)), pa.array(x_ids[top]), pa.array(scores[i][top])], ["query_id", "list", "vec_id", "score"])

    found = base.mapInArrow(brute, "query_id long, list long, vec_id long, score double")
    best = ranked(found.select("query_id", "vec_id", "score"), k).join(found.select("query_id", "vec_id", "list").distinct(), ["query_id", "vec_id"]).collect()
    order = space.distances(space.lift(q, True)).argsort(1).argsort(1)
    row = {int(i): n for n, i in enumerate(ids)}
    places = np.sort([order[row[r.query_id], r.list] for r in best])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1 if len(places) else 1


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.97, doubt: float = 2.1,
           sample: int = 20_000, calibration: int = 128, block: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (double): ``k`` rows of ``table`` with about the largest inner products per query.

    Candidates are all rows with another id than the query's; scores are exact, ties go
    to the smaller vec_id; only with fewer than ``k`` candidates there are fewer rows. ``sample``
    bounds the rows that centroids are fitted on, ``calibration`` the queries that set the
    number of probed lists for ``recall``; ``doubt`` is the width of the abandonment test.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows
    without an id, take no part on either side. A shorter vector counts as filled with
    zeros. Repeated rows count once; of several queries with one id the least vector is
    taken. Other columns are not read. Empty tables give an empty result.
    """
    base = store(sound(table, id_col, vec_col, zero=False), "vectors")
    asked = store(once(sound(queries, id_col, vec_col, zero=False)), "queries")
    width = max(1, base.agg(F.max(F.size("v"))).first()[0] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    n = base.count()
    space = fit_space(base, width, int(np.clip(np.sqrt(n) / 2, 1, 4096)), sample)
    most = probes_needed(base, asked, space, k, recall, calibration)
    index, blocks, sizes = build_index(base, space, block)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real = np.array(sorted(blocks) or [0])
        held = np.array([sizes.get(int(x), 0) for x in real])
        for batch in batches:
            far = space.distances(space.lift(_floats(batch.column("v"), width), True))[:, real]
            order = far.argsort(1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]  # rows in nearer lists
            taken = (np.arange(len(real))[None, :] < most) | (before < k + batch.column("own").to_numpy()[:, None])
            at = np.concatenate([[0], np.cumsum(taken.sum(1))])
            rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(real[order][taken].astype(np.int32)))
            yield pa.record_batch([batch.column("id"), batch.column("v"), rows], ["id", "v", "lists"])

    own = base.groupBy("id").agg(F.count("*").alias("own"))  # rows under the query's id, none of its candidates
    asked = asked.join(own, "id", "left").select("id", "v", F.coalesce("own", F.lit(0)).alias("own"))
    probed = store(asked.mapInArrow(probe, "id long, v array<double>, lists array<int>"), "probes")
    never = F.lit(float("-inf"))
    home = store(_scan(index, blocks, probed.select("id", "v", F.col("lists")[0].alias("list"), never.alias("floor")), space, k, doubt), "home")
    floor = ranked(home, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = probed.filter(F.size("lists") > 1).join(floor, "id", "left").withColumn("floor", F.coalesce("floor", never))
    rest = rest.select("id", "v", F.explode(F.slice("lists", F.lit(2), F.size("lists"))).alias("list"), "floor")
    return ranked(home.union(_scan(index, blocks, rest, space, k, doubt)), k)
