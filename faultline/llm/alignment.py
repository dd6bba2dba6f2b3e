"""Alignment of two tokenizers' tokens of the same text, and how often each pair of ids is linked in the corpus.

A tokenizer's tokens end at byte offsets of the text. Where tokens of both end, the text
is cut; what lies between two cuts is a group, and all its tokens of one side are linked
to all of the other. The cuts are the intersection of two rising lists: every end of the
shorter list is sought in the longer one by galloping, from a guess in steps that double
until the place is passed, then by halving. The found indices slice the tokens into
groups, and differences of ranks give each group's share of either list.

Texts travel in packs of a few megabytes. A pack is encoded and aligned once and stored
as one row: its ids and cuts, and its distinct pairs with the number of its documents
that hold each. Spark adds the pairs up, finds the highest count of each id, and sends
each pack the counts of its own pairs, so a pair that every document holds travels once
a pack. No table of the corpus is held whole by a task.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from faultline.llm.frames import pieces, text_bytes
from faultline.session import store

PACK_BYTES = 1 << 20
#: Links that are laid out at once.
LINKS = 1 << 19
#: Fixed value: how the byte-level vocabulary cuts text before it merges.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STORED = "pack long, ids array<{id}>, a_tokens array<int>, b_tokens array<int>, blob binary, pairs array<bigint>, docs array<int>"


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where it prints, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Names:
    """The bytes of each id, laid end to end."""

    def __init__(self, names: list[bytes]) -> None:
        self.size = np.array([len(n) for n in names], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(names), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - ends + sizes, sizes)]


def _young() -> np.ndarray:
    """Marks the code points that are not a letter, a number, a space or neither alike in all versions of Unicode since 3.2."""
    kind = lambda category: category[0] if category[0] in "LNZ" else "other"
    old, marks = unicodedata.ucd_3_2_0.category, np.zeros(sys.maxunicode + 1, bool)
    for point in range(len(marks)):
        was = old(chr(point))
        marks[point] = was == "Cn" or kind(was) != kind(unicodedata.category(chr(point)))
    return marks


class ByteSide:
    """The byte-level vocabulary: text to ids, ids to bytes.

    Its merges go in order of ids, so ids serve as ranks for the faster of two encoders.
    Texts with characters that versions of Unicode class differently, and vocabularies
    of another order, go to the library that reads the file itself.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_alphabet())}
        names = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for name, i in vocab.items():
            names[i] = name.encode() if name in special else bytes(back[c] for c in name)
        self.names = Names(names)
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        ranks = {names[i]: i for name, i in vocab.items() if name not in special}
        self.fast, self.young = None, None
        if merged == sorted(merged) and len(ranks) == 256 + len(merged):
            self.fast, self.young = tiktoken.Encoding("byte_side", pat_str=CUT, mergeable_ranks=ranks, special_tokens={}), _young()

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or (not text.isascii() and self.young[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceSide:
    """The piece vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = []
        for i in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(i)
            names.append(bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode())
        self.names = Names(names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def sides(byte_vocabulary: str, piece_vocabulary: str) -> tuple[ByteSide, PieceSide]:
    """Both vocabularies, read once per Python worker."""
    return ByteSide(byte_vocabulary), PieceSide(piece_vocabulary)


def gallop(wanted: np.ndarray, ends: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each wanted value the first place in ``ends`` (rising) that is not below it, sought from a guess in doubling steps."""
    n = len(ends)
    below = ends[guess] < wanted
    low, high = np.where(below, guess, guess - 1), np.where(below, guess + 1, guess)
    right, step = np.flatnonzero(below), 1
    while len(right):
        right = right[high[right] < n]
        right = right[ends[high[right]] < wanted[right]]
        low[right] = high[right]
        step *= 2
        high[right] = np.minimum(high[right] + step, n)
    left, step = np.flatnonzero(~below), 1
    while len(left):
        left = left[low[left] >= 0]
        left = left[ends[low[left]] >= wanted[left]]
        high[left] = low[left]
        step *= 2
        low[left] = np.maximum(low[left] - step, -1)
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = ends[middle] < wanted[open_]
        low[open_[less]], high[open_[~less]] = middle[less], middle[~less]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of the ends they share. ``at_a`` and ``at_b`` bound the documents; a document's shorter list drives."""
    doc = np.repeat(np.arange(len(at_a) - 1), np.diff(at_a))
    short = (np.diff(at_a) <= np.diff(at_b))[doc]
    in_a, in_b = [], []
    for mine, other, at, far, out, back in ((ends_a, ends_b, at_a, at_b, in_a, in_b), (ends_b, ends_a, at_b, at_a, in_b, in_a)):
        if mine is ends_b:
            doc = np.repeat(np.arange(len(at_b) - 1), np.diff(at_b))
            short = (np.diff(at_b) < np.diff(at_a))[doc]
        which = np.flatnonzero(short)
        if not len(which):
            continue
        d = doc[which]
        guess = far[d] + (which - at[d]) * (far[d + 1] - far[d]) // np.maximum(at[d + 1] - at[d], 1)
        found = gallop(mine[which], other, guess)
        hit = other[np.minimum(found, len(other) - 1)] == mine[which]
        out.append(which[hit])
        back.append(found[hit])
    return tuple(np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (in_a, in_b))


def _distinct(values: np.ndarray) -> np.ndarray:
    """In order, each once; whole numbers from 0 on."""
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) > 0]


class Groups:
    """The groups of a pack: ids of both sides end to end, and where each group ends in them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> None:
        self.a, self.b, self.at_a, self.at_b, self.cut_a, self.cut_b = a, b, at_a, at_b, cut_a, cut_b
        self.many_a, self.many_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        self.of = np.searchsorted(at_a, cut_a, side="right") - 1
        self.n_docs = len(at_a) - 1

    def per_doc(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sums of whole numbers by document; ``of`` rises."""
        run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        at = np.searchsorted(of, np.arange(self.n_docs + 1))
        return run[at[1:]] - run[at[:-1]]

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the groups of one token on either side, and their id pairs."""
        one = np.flatnonzero((self.many_a == 1) & (self.many_b == 1))
        return one, self.a[self.cut_a[one]] << 16 | self.b[self.cut_b[one]]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, id pair, how many links) of the other groups in parts of bounded size, each with rising documents; a pair may come again."""
        made = self.many_a * self.many_b
        several = np.flatnonzero((made > 1) & (made <= LINKS))
        total = np.cumsum(made[several])
        for part in np.split(several, np.flatnonzero(np.diff(total // LINKS)) + 1) if len(several) else []:
            k = made[part]
            g = np.repeat(part, k)
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            i, j = np.divmod(step, self.many_b[g])
            yield self.of[g], self.a[self.cut_a[g] - self.many_a[g] + 1 + i] << 16 | self.b[self.cut_b[g] - self.many_b[g] + 1 + j], np.ones(len(g), np.int64)
        for g in np.flatnonzero(made > LINKS):  # equal ids of a large group are counted before they are paired
            ia, na = np.unique(self.a[self.cut_a[g] - self.many_a[g] + 1 : self.cut_a[g] + 1], return_counts=True)
            ib, nb = np.unique(self.b[self.cut_b[g] - self.many_b[g] + 1 : self.cut_b[g] + 1], return_counts=True)
            wide = max(1, LINKS // len(ib))
            for lo in range(0, len(ia), wide):
                pair = (ia[lo : lo + wide, None] << 16 | ib[None, :]).ravel()
                yield np.full(len(pair), self.of[g]), pair, (na[lo : lo + wide, None] * nb[None, :]).ravel()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct id pair and how many documents hold it."""
        one, pair = self.single()
        held = _distinct(self.of[one] << 32 | pair)
        waiting, size = [], 0
        for of, pair, _ in self.links():
            waiting.append(_distinct(of << 32 | pair))
            size += len(waiting[-1])
            if size > max(4 * LINKS, 2 * len(held)):
                held, waiting, size = _distinct(np.concatenate([held, *waiting])), [], 0
        held = np.sort(_distinct(np.concatenate([held, *waiting])) & 0xFFFFFFFF)
        first = np.flatnonzero(np.diff(held, prepend=-1))
        return held[first], np.diff(np.append(first, len(held)))

    def spelled(self) -> pa.Array:
        """Each document's groups as text: ids joined by commas, sides by a bar, groups by semicolons."""
        n = len(self.a) + len(self.b)
        group_a = np.repeat(np.arange(len(self.cut_a)), self.many_a)
        group_b = np.repeat(np.arange(len(self.cut_b)), self.many_b)
        place_a = np.arange(len(self.a)) + (self.cut_b - self.many_b + 1)[group_a]
        place_b = np.arange(len(self.b)) + (self.cut_a + 1)[group_b]
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[self.cut_a]], mark[place_b[self.cut_b]] = ord("|"), ord(";")
        some = self.at_b[1:] > self.at_b[:-1]
        mark[place_b[self.at_b[1:][some] - 1]] = 0
        cells = np.concatenate([DIGITS[ids], np.zeros((n, 1), np.uint8)], axis=1)
        cells[np.arange(n), WIDTH[ids]] = mark
        ends = np.concatenate([[0], np.cumsum(WIDTH[ids] + (mark > 0))])[self.at_a + self.at_b]
        text = cells.ravel()
        return pa.LargeStringArray.from_buffers(self.n_docs, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text[text > 0].tobytes())).cast(pa.string())


WIDTH = np.array([len(str(i)) for i in range(1 << 16)])
DIGITS = np.frombuffer(b"".join(str(i).encode().ljust(5, b"\0") for i in range(1 << 16)), np.uint8).reshape(-1, 5)


def align_pack(texts: pa.Array, a_side: ByteSide, b_side: PieceSide) -> Groups:
    """Encode and align texts without nulls; a text that either side does not give back byte by byte has no tokens."""
    given = texts.to_pylist()
    many, flat = [], []
    for ids in ([a_side.encode(" " + t) if t else np.zeros(0, np.int64) for t in given], b_side.encode(given)):
        many.append(np.array([len(x) for x in ids], np.int64))
        flat.append(np.concatenate([np.zeros(0, np.int64), *ids]))
    data, at = text_bytes(texts)
    sizes = np.diff(at) + 1
    good = sizes > 1
    for side, n, ids in zip((a_side, b_side), many, flat):
        run = np.concatenate([[0], np.cumsum(side.names.size[ids])])
        good &= np.diff(run[np.concatenate([[0], np.cumsum(n)])]) == sizes
    whole = np.full(sizes.sum(), ord(" "), np.uint8)  # each text with a space before it
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(whole), bool)
    inner[starts] = False
    whole[inner] = data
    for side, n, ids in zip((a_side, b_side), many, flat):
        if side is a_side and a_side.fast is not None:
            continue  # merged bytes: they are the text's if they are as many
        back = side.names.join(ids[np.repeat(good, n)])
        wrong = np.flatnonzero(back != whole[np.repeat(good, sizes)])
        there = np.flatnonzero(good)
        good[there[np.searchsorted(np.cumsum(sizes[there]), wrong, side="right")]] = False
    many_a, many_b = (np.where(good, n, 0) for n in many)
    a, b = (ids[np.repeat(good, n)] for ids, n in zip(flat, many))
    at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (many_a, many_b))
    cut_a, cut_b = common_ends(np.cumsum(a_side.names.size[a]), np.cumsum(b_side.names.size[b]), at_a, at_b)
    return Groups(a, b, at_a, at_b, cut_a, cut_b)


def _pressed(groups: Groups, pairs: np.ndarray) -> bytes:
    """The groups, compressed: which have one token on either side, those as places in ``pairs``, then sizes and ids of the others."""
    one, pair = groups.single()
    alone = np.zeros(len(groups.cut_a), bool)
    alone[one] = True
    sizes = [x[~alone].astype("<u4") for x in (groups.many_a, groups.many_b)]
    rest = [ids[~np.repeat(alone, many)].astype("<u2") for ids, many in ((groups.a, groups.many_a), (groups.b, groups.many_b))]
    head = np.array([len(alone), len(one), len(rest[0]), len(rest[1])], "<i8")
    parts = [head, np.packbits(alone), np.searchsorted(pairs, pair).astype("<u4" if len(pairs) > 1 << 16 else "<u2"), *sizes, *rest]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def _restored(blob: bytes, pairs: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[Groups, np.ndarray, np.ndarray]:
    """What was compressed; places of the groups of one token on either side; their places in ``pairs``."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, n_one, n_rest_a, n_rest_b = (int(x) for x in np.frombuffer(data, "<i8", 4))
    at = 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    alone = np.unpackbits(take("u1", -(-n // 8)), count=n).astype(bool)
    places = take("<u4" if len(pairs) > 1 << 16 else "<u2", n_one).astype(np.int64)
    many_a, many_b = np.ones(n, np.int64), np.ones(n, np.int64)
    many_a[~alone], many_b[~alone] = take("<u4", n - n_one), take("<u4", n - n_one)
    both = []
    for many, count, ids in ((many_a, n_rest_a, pairs[places] >> 16), (many_b, n_rest_b, pairs[places] & 0xFFFF)):
        mine = np.repeat(alone, many)
        both.append(np.empty(len(mine), np.int64))
        both[-1][mine], both[-1][~mine] = ids, take("<u2", count)
    at_a, at_b = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (n_a, n_b))
    return Groups(*both, at_a, at_b, np.cumsum(many_a) - 1, np.cumsum(many_b) - 1), np.flatnonzero(alone), places


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def packs(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """One row per pack of (id, text) rows: its ids, tokens by document, both sides' ids and cuts in a blob, and its distinct pairs."""
    kind = docs.schema["id"].dataType
    schema = T.StructType.fromDDL(STORED.format(id=kind.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = sides(byte_vocabulary, piece_vocabulary)
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), PACK_BYTES):
                part = batch.slice(lo, hi - lo)
                groups = align_pack(part.column("text"), a_side, b_side)
                pair, held = groups.pairs()
                ids = part.column("id")
                columns = [
                    pa.array([made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), _listed(np.diff(groups.at_a), pa.int32()),
                    _listed(np.diff(groups.at_b), pa.int32()), pa.array([_pressed(groups, pair)], pa.binary()), _listed(pair, pa.int64()), _listed(held, pa.int32()),
                ]
                yield pa.record_batch(columns, schema.names)
                made += 1

    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``docs``.

    Side A encodes a space and the text with a byte-level vocabulary, side B the text
    with a piece vocabulary that puts a space before it; names of special tokens inside
    a text are plain text. ``groups`` spells the groups: the ids of A joined by commas, a
    bar, those of B, and semicolons between groups. ``n_links`` counts the linked pairs
    of tokens. A pair of ids counts the documents that hold it linked; ``n_best`` are the
    links whose pair counts as much as the best pair of its A id (ties included), and
    ``count_sum`` adds all links' counts.

    Null and empty texts, and texts that either side does not give back byte by byte
    (such as one with U+2581), have no tokens: zeros and ''. Each row is a document, also
    where ids repeat or are null. Other columns are not read. An empty table gives an
    empty one. Texts of any length are encoded whole. Ids must be below 65,536.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    stored = store(packs(read, byte_vocabulary, piece_vocabulary), "packs")
    mine = stored.select("pack", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "held")).select("pack", "at", F.col("held.pairs").alias("pair"), F.col("held.docs").alias("n"))
    counts = store(mine.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))  # one row per id of the vocabulary at most
    judged = counts.withColumn("a", F.shiftright("pair", 16)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = mine.select("pack", "at", "pair").join(judged, "pair").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("told"))
    full = stored.select("pack", "ids", "a_tokens", "b_tokens", "blob", "pairs").join(told, "pack", "left")
    full = full.select("ids", "a_tokens", "b_tokens", "blob", "pairs", F.col("told.n").alias("n"), F.col("told.best").alias("best"))
    schema = T.StructType([T.StructField(id_col, read.schema["id"].dataType), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n_a, n_b, pair, n, best = (_values(batch.column(c)[k]) for c in ("a_tokens", "b_tokens", "pairs", "n", "best"))
                groups, one, at = _restored(batch.column("blob")[k].as_buffer(), pair, n_a, n_b)
                sums = np.stack([groups.per_doc(x, groups.of[one]) for x in (np.ones(len(one), np.int64), best[at], n[at])])
                for of, key, times in groups.links():
                    at = np.searchsorted(pair, key)
                    sums += [groups.per_doc(x, of) for x in (times, times * best[at], times * n[at])]
                n_groups = groups.per_doc(np.ones(len(groups.of), np.int64), groups.of)
                columns = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, *sums)]
                yield pa.record_batch([batch.column("ids")[k].values, *columns, groups.spelled()], schema.names)

    return full.mapInArrow(finish, schema)


def _values(rows: pa.ListScalar) -> np.ndarray:
    return rows.values.to_numpy(zero_copy_only=False) if rows.is_valid else np.zeros(0, np.int64)
