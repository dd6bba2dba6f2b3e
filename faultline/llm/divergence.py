"""How far the sources of a language differ in their words: exact integer divergences between pairs, and each source's own terms.

Terms are counted by sorting pointers. Of every shard of text (a few megabytes of an
Arrow batch's buffer) the word starts are taken as pointers to the words' suffixes and
sorted by a multikey quicksort: by the first eight bytes, then, inside each slice that
is still equal and goes on, by the next eight, and so forth; no word is copied to be
compared. A run of equal words yields its count and its documents in each source. Runs
of all shards are summed by Spark.

The divergence of two sources sums over all kept terms of the language, but only terms
that both hold are joined: terms that one side lacks have one value for the lacking
side, so they are summed from each source's counts of counts, and terms that both lack
are one product. Whole numbers only, so the split changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.frames import pieces, text_bytes
from faultline.session import store

SHARD_BYTES = 8 << 20
SCALE = 1_000_000_000
#: Slices that are equal for so many chunks of eight bytes are compared by what is left of them, whole.
DEEPEST = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[97:123] = IN_TERM[128:] = True
HEAD = np.array([~((1 << 8 * (8 - k)) - 1) % 2**64 for k in range(9)], np.uint64)


def word_pointers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every term in lower-cased bytes; ``at`` bounds the texts, which no term crosses."""
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def sort_pointers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in order of their words, and where in that order a new word begins."""
    n = len(starts)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)

    def chunk(which: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes of each word as a number, the first one highest; zero beyond its end, which no term holds."""
        left = np.clip(sizes[which] - 8 * depth, 0, 8)
        place = np.where(left > 0, starts[which] + 8 * depth, 0)
        return words[place].copy().view(">u8").ravel().astype(np.uint64) & HEAD[left]

    keys = chunk(np.arange(n), 0)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    open_ = np.arange(n)
    for depth in range(1, DEEPEST + 1):
        run = np.cumsum(new[open_]) - 1  # a run is open as a whole or not at all
        longer = np.bincount(run, sizes[order[open_]] > 8 * depth) > 0
        longer &= np.bincount(run) > 1
        open_, run = open_[longer[run]], run[longer[run]]
        if not len(open_):
            break
        if depth < DEEPEST:
            keys = chunk(order[open_], depth)
        else:
            rest = [data[s + 8 * depth : s + z].tobytes() if z > 8 * depth else b"" for s, z in zip(starts[order[open_]], sizes[order[open_]])]
            rank = {word: i for i, word in enumerate(sorted(set(rest)))}
            keys = np.array([rank[word] for word in rest])
        by = np.lexsort((keys, run))
        order[open_], keys = order[open_][by], keys[by]
        new[open_[1:]] |= keys[1:] != keys[:-1]
    return order, new


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings at these places."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    place = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[place].tobytes())).cast(pa.string())


def shard_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, count and number of documents of each pair of a term and a group (a small number per text)."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    starts, sizes = word_pointers(data, at)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none
    of = np.searchsorted(at, starts, side="right") - 1
    order, new = sort_pointers(data, starts, sizes)
    term = np.cumsum(new) - 1
    held, count = np.unique(term * len(texts) + of[order], return_counts=True)  # a run's pointers by document
    term, doc = np.divmod(held, len(texts))
    many = int(group.max()) + 1
    pair, back = np.unique(term * many + group[doc], return_inverse=True)
    term, which = np.divmod(pair, many)
    lead = order[new]
    words = gather(data, starts[lead], sizes[lead])
    return words.take(pa.array(term)), which, np.bincount(back, count).astype(np.int64), np.bincount(back)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of frames (lang, source, text) without nulls; each row is a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), SHARD_BYTES):
                part = batch.slice(lo, hi - lo)
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                l, s = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source))
                code, group = np.unique(l * len(source.dictionary) + s, return_inverse=True)
                terms, which, n, held = shard_counts(part.column("text"), group)
                l, s = np.divmod(code[which], len(source.dictionary))
                yield pa.record_batch([lang.dictionary.take(pa.array(l)), source.dictionary.take(pa.array(s)), terms, pa.array(n), pa.array(held)], ["lang", "source", "term", "n", "docs"])

    made = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) in whole numbers; wide enough for any count."""
    wide = (count.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, total.cast("decimal(20,0)"))


def _gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); a share is at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has a row for every other source of the language, part ``term`` the source's own terms.

    A term is a run of letters A-Z and of characters from U+0080 on, with A-Z in lower
    case. A language keeps the terms that ``min_docs`` of its documents hold. A source's
    share of a kept term is p = 1 + floor(10^9 (count + 1) / (N + V)) with V kept terms
    and N their count in the source. Against the share q of another source, or of the
    whole language, a term's value is floor((p - q)^2 / q). Pairs sum it over all kept
    terms; terms with p > q and a count above 0 are ranked, the first ``top`` returned.

    Each row is a document, also where ids repeat. Null languages, sources and texts are
    ''. Sources without terms have pairs like others; a language without kept terms has
    pairs of value 0, one with a single source has none. Ties go to the item that is
    first in UTF-8 order. No other column is read. An empty table gives an empty one.
    """
    read = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = store(term_counts(read), "term_counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = store(counts.drop("docs").join(terms, ["lang", "term"]), "kept_terms")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("mass"), F.count("*").alias("held"))
    langs = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("all").alias("mass_lang"))
    groups = read.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["mass", "held", "vocabulary", "mass_lang"])
    groups = store(groups.withColumn("p0", F.when(F.col("vocabulary") > 0, _share(F.lit(0), F.col("mass") + F.col("vocabulary")))), "groups")  # one row per source of a language
    shares = store(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", _share(F.col("n"), F.col("mass") + F.col("vocabulary")).alias("p"),
            _share(F.col("all"), F.col("mass_lang") + F.col("vocabulary")).alias("q"), "p0",
        ),
        "shares",
    )
    own = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gain(F.col("p"), F.col("q")).alias("value"))
    return _ranked(own).filter(F.col("rank") <= top).union(_ranked(_pairs(groups, shares)))


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.row_number().over(by).alias("rank"))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """The value of every two sources of a language."""
    col = F.col
    sides = groups.select("lang", col("source").alias("other"), col("held").alias("held_other"), col("p0").alias("q0"))
    couples = groups.join(sides, "lang").filter("source <> other")
    neither = F.when(col("vocabulary") > 0, (col("vocabulary") - col("held") - col("held_other")) * _gain(col("p0"), col("q0"))).otherwise(0)
    parts = couples.select("lang", "source", "other", neither.alias("value"))
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))  # terms of a source that count alike have one value against a source without them
    spread = alike.join(sides, "lang").filter("source <> other")
    parts = parts.union(spread.select("lang", "source", "other", col("k") * _gain(col("p"), col("q0"))))
    parts = parts.union(spread.select("lang", "other", "source", col("k") * _gain(col("q0"), col("p"))))
    left = shares.select("lang", "term", "source", "p", "p0")
    right = shares.select("lang", "term", col("source").alias("other"), col("p").alias("q"), col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).filter("source <> other")
    mended = _gain(col("p"), col("q")) - _gain(col("p"), col("q0")) - _gain(col("p0"), col("q")) + _gain(col("p0"), col("q0"))
    parts = parts.union(both.groupBy("lang", "source", "other").agg(F.sum(mended)))
    summed = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), col("other").alias("item"), "value")
