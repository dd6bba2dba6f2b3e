"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words in lower case, and the first three to seven
bytes of each, so that a stem is known with endings never met before. Terms are 64-bit
codes. From a bounded sample of labelled documents Spark counts in how many toxic and
clean ones each term stands; the terms that depend most on the label become the model's
columns. The machine has a weight per column and a short vector per column; two terms
that stand in one document add the inner product of their vectors. That is how an insult
weighs differently with the mention of a group than alone, which a sum of weights cannot
say. All of a document's text is read, and a document of any length has each column once
at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.frames import others, pieces, text_bytes, with_columns
from faultline.session import store

ADDED = "held_out boolean, score double, predicted int"
PREFIXES = (3, 4, 5, 6, 7)
#: The model's columns at most, and how many documents a term must stand in to become one.
COLUMNS, LEAST_DOCS = 4096, 3
FACTORS = 8
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's place, code) of all terms, one pair of arrays per kind of term: whole words, then the starts of each length.

    A word is a run of letters, digits and characters from U+0080 on, in lower case.
    """
    data, at = text_bytes(pc.utf8_lower(texts))
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    of = np.searchsorted(at, starts, side="right") - 1
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    head = words[starts].copy().view("<u8").ravel()
    yield of, _whole(words, starts, sizes, head)
    for k in PREFIXES:
        there = sizes > k
        yield of[there], _mix((head[there] & MASKS[k]) + np.uint64(k << 56))


def _whole(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A code of all bytes of each word."""
    code = _mix((head & MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64))
    longer, done = np.flatnonzero(sizes > 8), 8
    while len(longer):
        part = words[starts[longer] + done].copy().view("<u8").ravel() & MASKS[np.minimum(sizes[longer] - done, 8)]
        code[longer] = _mix(code[longer] * GOLDEN + part)
        done += 8
        longer = longer[sizes[longer] > done]
    return code


@dataclass(frozen=True)
class Machine:
    """Known term codes in order, a bias, a weight and a vector for each."""

    codes: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text's place, column), each pair once, in order."""
        some = np.zeros(1 << 16, bool)
        some[self.codes >> np.uint64(48)] = True
        held = [np.zeros(0, np.int64)]
        for of, code in terms(texts) if len(self.codes) else ():
            may = np.flatnonzero(some[code >> np.uint64(48)])
            column = np.minimum(np.searchsorted(self.codes, code[may]), len(self.codes) - 1)
            hit = self.codes[column] == code[may]
            held.append(of[may][hit] * len(self.codes) + column[hit])
        return np.divmod(np.unique(np.concatenate(held)), max(len(self.codes), 1))

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        out = np.zeros(len(texts))
        for lo, hi in pieces(texts, 1 << 20):
            row, column = self.found(texts.slice(lo, hi - lo))
            logit = self.bias + np.bincount(row, self.weights[column], minlength=hi - lo)
            for v in self.vectors.T:  # half of (sum of entries)^2 less their squares is the sum over pairs
                total = np.bincount(row, v[column], minlength=hi - lo)
                logit += (total * total - np.bincount(row, v[column] ** 2, minlength=hi - lo)) / 2
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out


def fit(x: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 300, ridge: tuple[float, float] = (1e-5, 1e-4), rate: float = 0.05) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors of a factorization machine on rows of zeros and ones; full-batch Adam, deterministic.

    ``ridge`` holds weights and vectors down: the vectors more, since a long document has
    many pairs. The bias stays at the log odds of the label (kept from certainty), which is the
    score of a document without a known term.
    """
    x = x.astype(np.float32)
    n, many = x.shape
    weight = weight / weight.sum()
    share = float(np.clip(weight @ label, 1e-3, 1 - 1e-3))
    bias = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros((many, 1)), np.random.default_rng(7).normal(0, 0.03, (many, FACTORS))], axis=1).astype(np.float32)
    pull = np.array([ridge[0], *[ridge[1]] * FACTORS], np.float32)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, v = theta[:, 0], theta[:, 1:]
        both = x @ np.concatenate([theta, (v * v).sum(1, keepdims=True)], axis=1)
        total = both[:, 1:-1]
        logit = bias + both[:, 0] + ((total * total).sum(1) - both[:, -1]) / 2
        gap = (weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label)).astype(np.float32)
        g = x.T @ np.concatenate([gap[:, None], gap[:, None] * total], axis=1)
        g[:, 1:] -= v * g[:, :1]
        g += pull * theta
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return float(bias), theta[:, 0].astype(float), theta[:, 1:].astype(float)


def held_out(id_col: Column) -> Column:
    """Whether an id's row is kept from learning: crc32 of the id as text leaves 1 when divided by 3. A null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _dependence(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """The likelihood ratio statistic of a term and the label; documents with the term by label, and documents by label."""

    def part(seen: Column, row: Column, column: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * float(n_toxic + n_clean) / (row * float(column)))).otherwise(0.0)

    row = toxic + clean
    rest = float(n_toxic + n_clean) - row
    return 2 * (part(toxic, row, n_toxic) + part(clean, row, n_clean) + part(n_toxic - toxic, rest, n_toxic) + part(n_clean - clean, rest, n_clean))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, strength: float) -> Machine:
    """Fit on at most ``sample`` labelled documents of each class, those whose ids hash lowest; classes are weighted back to their shares."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("doc").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc"))).groupBy("doc").agg(F.max("label").alias("label"))
    known = store(known.join(docs.select(F.col(f"`{id_col}`").alias("doc")).distinct(), "doc", "left_semi"), "labelled")
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    none = Machine(np.zeros(0, np.uint64), float(np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 9))), np.zeros(0), np.zeros((0, FACTORS)))
    if len(shares) < 2:
        return none
    chosen = [r for label in (0, 1) for r in known.filter(F.col("label") == label).orderBy(F.xxhash64("doc"), "doc").limit(sample).collect()]
    wanted = spark.createDataFrame([(r.doc, r.label) for r in chosen], known.schema)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    drawn = store(texts.join(F.broadcast(wanted), "doc").select("doc", "label", "text"), "sample")  # wanted: 2 * sample rows

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                label = part.column("label").to_numpy(zero_copy_only=False)
                for of, code in terms(part.column("text")):
                    by = np.lexsort((of, code))
                    of, code = of[by], code[by]
                    once = np.ones(len(of), bool)
                    once[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
                    of, code = of[once], code[once]
                    names, which = np.unique(code, return_inverse=True)
                    yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(np.bincount(which, label[of]).astype(np.int64)), pa.array(np.bincount(which, 1 - label[of]).astype(np.int64))], ["code", "toxic", "clean"])

    n_drawn = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    n_toxic, n_clean = (n_drawn.get(k, 0) for k in (1, 0))
    met = drawn.mapInArrow(spell, "code long, toxic long, clean long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ranked = met.filter(F.col("toxic") + F.col("clean") >= LEAST_DOCS).withColumn("g", _dependence(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
    codes = np.sort(np.array([r.code for r in ranked.filter(F.col("g") >= strength).orderBy(F.desc("g"), "code").limit(COLUMNS).collect()], np.int64).view(np.uint64))
    if not len(codes):
        return none
    blank = Machine(codes, 0.0, np.zeros(len(codes)), np.zeros((len(codes), FACTORS)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                row, column = blank.found(part.column("text"))
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.record_batch([part.column("doc").cast(pa.string()), part.column("label"), pa.array([column[a:b].astype("<u2").tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["doc", "label", "columns"])

    rows = sorted(drawn.mapInArrow(look, "doc string, label int, columns binary").collect(), key=lambda r: (r.doc, r.columns))
    x, label = np.zeros((len(rows), len(codes)), np.float32), np.array([r.label for r in rows], float)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.columns, "<u2")] = 1
    weight = np.where(label == 1, shares[1] / max(n_toxic, 1), shares[0] / max(n_clean, 1))
    return Machine(codes, *fit(x, label, weight))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000, strength: float = 20.0, cut: float = 0.7) -> DataFrame:
    """All rows and columns of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``cut`` on).

    ``labels`` (id, ``label_col`` 0 or 1) are read where crc32 of the id as text modulo 3
    is not 1; the rest is held out. At most ``sample`` documents of each class are learned
    from; terms whose dependence on the label (likelihood ratio) is below ``strength``
    are no columns. Only the text decides a score.

    Null and empty texts, and texts without a known term, score the prior, which is below
    one half unless most labelled documents are toxic. An id labelled twice counts as
    toxic if either label is 1; rows that repeat an id all carry its label. Labels that
    are neither 0 nor 1, with a null id or without a document are left out. With labels of
    one class or none every score is the prior. Input columns named as the new ones are
    replaced. An empty table gives an empty one.
    """
    docs = others(docs, "held_out", "score", "predicted")
    machine = train(docs, labels, id_col, text_col, label_col, sample, strength)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # COLUMNS * (FACTORS + 2) numbers at most
    marked = docs.withColumn("held_out", held_out(F.col(f"`{id_col}`")))
    schema = with_columns(docs.schema, ADDED)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).fill_null("")
            for lo, hi in pieces(texts, 2 << 20):
                part, score = batch.slice(lo, hi - lo), shared.value.score(texts.slice(lo, hi - lo))
                yield pa.record_batch([*part.columns, pa.array(score), pa.array((score >= cut).astype(np.int32))], schema.names)

    return marked.mapInArrow(apply, schema)
