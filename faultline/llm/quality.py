"""A quality classifier trained without gold labels.

1. Heuristic labellers vote good (+1), junk (-1) or abstain (0) on every document.
2. Votes are counted per vote pattern over the whole corpus: at most 3 to the number
   of labellers rows, whatever the corpus holds. Expectation-maximisation over those
   counts estimates how often each labeller votes which way on good and on junk
   documents, and the share of junk. The two sides are kept apart because junk comes
   in kinds: a labeller that sees one kind only is right when it says junk and says
   little when it says good.
3. A bounded sample of documents with the posterior as soft label fits a linear scorer
   over hashed byte trigrams and repeated words, and the scorer decides on every document.

All byte work is vectorised over Arrow batches, piece by piece; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.frames import others, pieces, text_bytes, with_columns
from faultline.session import store

LABELLERS = ("symbols", "capitals", "bare_marks", "word_length", "marked_words", "sentences", "function_words", "repeats", "runs")
BUCKETS = 4096
SPACE, LETTER, CAPITAL, DIGIT, STOP, MARK = range(6)
ADDED = "quality_score double, quality_keep boolean"
#: Frequent short words of the languages that the pipeline expects; any of them counts as a sign of running text.
FUNCTION_WORDS = ("the of and to in is that it for was on with as be by this are from at or an a de la le et les des en un une que qui dans du pour par sur avec est el los las y del se con para su es una al der die und das den von zu mit sich auf für ist im dem nicht als").split()


def _classes() -> np.ndarray:
    table = np.full(256, MARK, np.uint8)
    table[128:] = LETTER
    for low, high, kind in (("a", "z", LETTER), ("A", "Z", CAPITAL), ("0", "9", DIGIT)):
        table[ord(low) : ord(high) + 1] = kind
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[[ord(c) for c in ".,;:?'-"]] = STOP
    return table


CLASSES = _classes()
FINAL = np.isin(np.arange(256), [ord(c) for c in ".?!"])
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
WORD_HASHES = np.sort(np.array([int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "little") for w in FUNCTION_WORDS if len(w.encode()) <= 8], np.uint64))


def votes(texts: pa.Array) -> np.ndarray:
    """Votes of every labeller, one row per text; a text without a word gets junk from all that can tell."""
    out = np.zeros((len(texts), len(LABELLERS)), np.int8)
    for lo, hi in pieces(texts):
        out[lo:hi] = _votes(*text_bytes(texts.slice(lo, hi - lo)))
    return out


def _votes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    kind = CLASSES[data] if len(data) else np.zeros(0, np.uint8)

    def per_text(mask: np.ndarray, bounds: np.ndarray = at) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return run[bounds[1:]] - run[bounds[:-1]]

    solid = kind != SPACE
    first = solid.copy()
    opens = at[:-1][at[:-1] < len(data)]
    first[1:] &= ~solid[:-1]
    first[opens] = solid[opens]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    words = per_text(first)
    letters, capitals, marks = per_text((kind == LETTER) | (kind == CAPITAL)), per_text(kind == CAPITAL), per_text(kind == MARK)
    solids = per_text(solid)
    wordish = np.concatenate([[0], np.cumsum((kind == LETTER) | (kind == CAPITAL) | (kind == DIGIT), dtype=np.int64)])
    marked = np.concatenate([[0], np.cumsum(kind == MARK, dtype=np.int64)])
    of = np.searchsorted(at, starts, side="right") - 1  # empty texts share a start; the last of them holds the word
    bare = np.bincount(of, (wordish[ends] == wordish[starts]) & (marked[ends] > marked[starts]), minlength=n)
    tailed = np.bincount(of, marked[ends] - marked[np.maximum(starts, ends - 2)] >= np.minimum(2, ends - starts), minlength=n)
    final = np.bincount(of, FINAL[data[ends - 1]], minlength=n)
    code, size = _codes(data, kind, starts, ends)
    common = np.bincount(of, _function_words(code, size), minlength=n)
    same = _repeats(data, kind, starts, code, size) & (of[1:] == of[:-1])
    again = np.bincount(of[1:], same, minlength=n)
    runs = np.bincount(of[2:], same[1:] & same[:-1], minlength=n)
    some = np.maximum(words, 1)

    def vote(value: np.ndarray, good: tuple[float, float], junk: tuple[float, float]) -> np.ndarray:
        """+1 inside good, -1 outside junk, else no vote."""
        return np.where((value >= good[0]) & (value <= good[1]), 1, np.where((value < junk[0]) | (value > junk[1]), -1, 0))

    far = 1e18
    ruled = np.stack([
        vote(marks / np.maximum(solids, 1), (0, 0.06), (0, 0.15)),
        vote(capitals / np.maximum(letters, 1), (0, 0.25), (0, 0.5)),
        vote(bare / some, (0, 0.05), (0, 0.2)),
        vote(letters / some, (2.5, 11), (1.5, 14)),
        vote(tailed / some, (0, 0.05), (0, 0.2)),
        np.where(words < 8, 0, vote(final / some, (0.02, 0.5), (0.008, 0.75))),
        np.where(words < 8, 0, vote(common / some, (0.08, far), (0.03, far))),
        np.where(words < 8, 0, vote(again / some, (0, 0.02), (0, 0.06))),
        np.where(words < 8, 0, vote(runs / some, (0, 0.01), (0, 0.04))),
    ], axis=1)
    return np.where((letters == 0)[:, None], -1, ruled).astype(np.int8)


def _codes(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's first eight bytes in lower case as a number, and its length, without one trailing mark."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = ends - ((kind[ends - 1] == STOP) & (ends - starts > 1))
    size = ends - starts
    lower = np.concatenate([np.where(kind == CAPITAL, data | 32, data), np.zeros(8, np.uint8)])
    code = np.lib.stride_tricks.sliding_window_view(lower, 8)[starts].copy().view("<u8").ravel()
    return code & MASKS[np.minimum(size, 8)], size


def _repeats(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each word but the first is the one before it, in lower case: all its bytes count."""
    same = (code[1:] == code[:-1]) & (size[1:] == size[:-1])
    long = np.flatnonzero(same & (size[1:] > 8))
    lower = lambda at: np.where(kind[at] == CAPITAL, data[at] | 32, data[at])
    for part in np.split(long, np.flatnonzero(np.diff(np.cumsum(size[long]) >> 20)) + 1) if len(long) else []:
        rest = size[part] - 8
        begin = np.cumsum(rest) - rest
        step = np.arange(rest.sum()) - np.repeat(begin, rest)
        one, two = (np.repeat(starts[x] + 8, rest) + step for x in (part, part + 1))
        same[part] = np.logical_and.reduceat(lower(one) == lower(two), begin)
    return same


def _function_words(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(WORD_HASHES, code), len(WORD_HASHES) - 1)
    return (WORD_HASHES[at] == code) & (size <= 8)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and per labeller how often its votes are junk, then good, on good and on junk documents."""

    good: float
    on_good: np.ndarray
    on_junk: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of votes."""
        ratio = np.log(self.on_good / self.on_junk)
        logit = np.log(self.good / (1 - self.good)) + (pattern < 0) @ ratio[:, 0] + (pattern > 0) @ ratio[:, 1]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right where it votes."""
        return self.good * self.on_good[:, 1] + (1 - self.good) * self.on_junk[:, 0]


#: How a labeller is taken to vote before any document is seen (junk, good): it seldom calls a good document junk, and it
#: knows one kind of junk in several. This also tells the two classes apart. Not to vote says nothing.
PRIOR_GOOD, PRIOR_JUNK = np.array([0.005, 0.995]), np.array([0.18, 0.82])


def fit_labels(pattern: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.1) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, labellers independent given the class.

    Every rate has a prior worth ``prior`` of all documents, and 20 more, so that it
    weighs the same at every size. Without rows the prior is the answer.
    """
    prior = 20 + prior * float(np.sum(counts))
    model = LabelModel(0.8, np.tile(PRIOR_GOOD, (len(LABELLERS), 1)), np.tile(PRIOR_JUNK, (len(LABELLERS), 1)))
    if not len(counts):
        return model
    hot = np.stack([pattern == v for v in (-1, 1)], axis=2)
    for _ in range(rounds):
        p = model.posterior(pattern)
        on_good = np.einsum("i,ijk->jk", counts * p, hot) + prior * PRIOR_GOOD
        on_junk = np.einsum("i,ijk->jk", counts * (1 - p), hot) + prior * PRIOR_JUNK
        good = float((counts @ p + 16) / (counts.sum() + 20))
        new = LabelModel(good, on_good / on_good.sum(1, keepdims=True), on_junk / on_junk.sum(1, keepdims=True))
        done = abs(new.good - model.good) < 1e-9
        model = new
        if done:
            break
    return model


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Hash bucket of the three bytes that begin at each byte but the last two."""
    x = data.astype(np.uint32)
    code = x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.intp)


def features(texts: pa.Array) -> np.ndarray:
    """Hashed features: the square root of each bucket's share of a text's trigrams, then of words that repeat the one before.

    A text with fewer than 200 trigrams counts as having 200: little text is little evidence.
    """
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    for i in range(len(texts)):
        data, at = text_bytes(texts.slice(i, 1))
        for lo in range(0, max(0, len(data) - 2), 1 << 20):
            out[i, :BUCKETS] += np.bincount(trigram_buckets(data[lo : lo + (1 << 20) + 2]), minlength=BUCKETS)
        out[i] /= max(200, len(data) - 2)
        kind = CLASSES[data]
        solid = np.flatnonzero(np.diff((kind != SPACE).astype(np.int8), prepend=0, append=0))
        code, size = _codes(data, kind, solid[::2], solid[1::2])
        out[i, BUCKETS] = np.count_nonzero(_repeats(data, kind, solid[::2], code, size)) / max(40, len(code))
    return np.sqrt(out)


@dataclass(frozen=True)
class Scorer:
    """Weights over hashed trigrams."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of a good document; 0 for a text without a letter or digit."""
        out = np.zeros(len(texts))
        for lo in range(0, len(texts), 256):
            for start, stop in pieces(part := texts.slice(lo, 256)):
                data, at = text_bytes(part.slice(start, stop - start))
                some = np.concatenate([[0], np.cumsum((CLASSES[data] >= LETTER) & (CLASSES[data] <= DIGIT))])
                out[lo + start : lo + stop] = some[at[1:]] > some[at[:-1]]
            logit = features(part) @ self.weights.astype(np.float32) + self.bias
            out[lo : lo + 256] *= 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out


def fit_scorer(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by Adam; deterministic.

    The bias is the classes' log odds and stays: without evidence the prior decides.
    Without examples every document scores one half.
    """
    w = np.zeros(BUCKETS + 1)
    if not len(x):
        return Scorer(w, 0.0)
    weight, x = weight / weight.sum(), x.astype(np.float32)
    share = np.clip(weight @ soft, 0.05, 0.95)
    bias = float(np.log(share / (1 - share)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + bias, -40, 40)))
        g = (weight * (p - soft)).astype(np.float32) @ x + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.3 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Scorer(w, bias)


def _texts(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    return batch.column(text_col).fill_null("")


def vote_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: a hash that names it, and its votes."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = votes(_texts(batch, "text"))
            flat = pa.array(found.ravel(), pa.int8())
            yield pa.record_batch([batch.column("h"), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(LABELLERS), pa.int32()), flat)], ["h", "votes"])

    hashed = docs.select(_name(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    return hashed.mapInArrow(cast, "h long, votes array<tinyint>")


def _name(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def pattern_counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns and how many documents have each: at most 3 ** len(LABELLERS) rows come to the driver."""
    found = sorted((r.votes, r.n) for r in table.groupBy("votes").agg(F.count("*").alias("n")).collect())
    return np.array([v for v, _ in found], float).reshape(-1, len(LABELLERS)), np.array([n for _, n in found], float)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> tuple[LabelModel, Scorer]:
    """Fit both models. The scorer sees at most ``sample`` documents of each weak class: those of the smallest hash.

    The two samples are weighted back to the classes' shares in the corpus.
    """
    spark = docs.sparkSession
    table = store(vote_table(docs, id_col, text_col), "votes")
    pattern, counts = pattern_counts(table)
    labels = fit_labels(pattern, counts)
    soft = labels.posterior(pattern)
    chosen: dict[int, float] = {}
    weight: dict[int, float] = {}
    for good in (False, True):
        of_class = [[int(x) for x in v] for v, s in zip(pattern, soft) if (s >= 0.5) == good]
        if not of_class:
            continue
        known = spark.createDataFrame([(v, float(labels.posterior(np.array([v]))[0])) for v in of_class], "votes array<tinyint>, soft double")
        rows = table.join(F.broadcast(known), "votes").select("h", "soft").distinct().orderBy("h").limit(sample).collect()  # known: at most one row per pattern
        share = counts[(soft >= 0.5) == good].sum() / len(rows)
        chosen |= {r.h: r.soft for r in rows}
        weight |= {r.h: share for r in rows}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                x = features(_texts(part, "text")).astype(np.float16)
                yield pa.record_batch([part.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["h", "x"])

    wanted = spark.createDataFrame([(h,) for h in chosen], "h long")
    drawn = docs.select(_name(id_col, text_col).alias("h"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "h")  # wanted: 2 * sample rows
    rows = {r.h: r.x for r in drawn.mapInArrow(draw, "h long, x binary").collect()}
    order = sorted(rows)
    x = np.stack([np.frombuffer(rows[h], np.float16) for h in order]).astype(np.float32) if order else np.zeros((0, BUCKETS + 1), np.float32)
    return labels, fit_scorer(x, np.array([chosen[h] for h in order]), np.array([weight[h] for h in order]))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> DataFrame:
    """All rows and columns of ``docs`` with ``quality_score`` and ``quality_keep`` (score of one half or more).

    Null and empty texts, and texts without a letter or digit, score 0 and are not kept.
    Repeated rows get the same score. Nulls in other columns play no part. Input columns
    named as the new ones are replaced. An empty table gives an empty one.
    """
    docs = others(docs, "quality_score", "quality_keep")
    _, scorer = train(docs, id_col, text_col, sample)
    schema = with_columns(docs.schema, ADDED)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(_texts(batch, text_col), 2 << 20):  # small batches back, so that little is held twice
                part = batch.slice(lo, hi - lo)
                score = scorer.score(_texts(part, text_col))
                yield pa.record_batch([*part.columns, pa.array(score), pa.array(score >= 0.5)], schema.names)

    return docs.mapInArrow(apply, schema)
