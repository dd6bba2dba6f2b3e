"""Exact byte-pair encoding without a merge loop, and decoding by an offset table.

A sequence of tokens is what the merges give if and only if each neighbouring pair is:
the pair's own text encodes to just these two. So the encoder takes, from left to
right, the longest token that an Aho-Corasick automaton matched at the position, checks
it against its left neighbour in a table of compatible pairs, and on a misfit tries the
next shorter token or steps back. A position that proved to be a dead end is marked and
not entered again, which keeps the work linear in the text.

The vocabulary file is that of a word-end BPE: text is composed (NFC), lower-cased and
cut into words and marks, white space is dropped, bytes are written in a printable
alphabet, and the last one of each word carries an end mark. The operator works on whole
texts of any length, in Arrow batches.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from faultline.llm.frames import others, pieces, with_columns

END = "</w>"
MARK = "￿"  # stands for END inside strings, so that it is one character


def _ranges(kind: str) -> str:
    """The code points of a general category, as the inside of a regular expression's brackets."""
    found: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(chr(point)).startswith(kind):
            if found and found[-1][1] == point - 1:
                found[-1][1] = point
            else:
                found.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


L, N = _ranges("L"), _ranges("N")
UNKNOWN = re.compile(f"[{_ranges('Cn')}]")  # younger than this Python's tables
#: Fixed value: the cut into words and marks that the vocabulary was made with.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{L}{N}\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")
BLANK = re.compile(r"[^\S\x1c-\x1f]")
ODD = re.compile(r"[\x1c-\x1f]")  # white space to str.split(), not to the vocabulary's pattern
CHUNK = 1 << 18
MOST_CACHED = 600_000


def _beyond_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where it prints, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


ALPHABET = {b: c for b, c in enumerate(byte_alphabet())}


class OffsetTable:
    """Strings laid end to end; those of a list of numbers are gathered in one go."""

    def __init__(self, strings: list[str]) -> None:
        encoded = [s.encode() for s in strings]
        self.data = np.frombuffer(b"".join(encoded), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)

    def join(self, numbers: np.ndarray) -> bytes:
        starts = self.at[numbers]
        sizes = self.at[numbers + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.data[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes()


class Encoder(dict):
    """Run without white space to its ids as little-endian unsigned 32-bit bytes; computed on first use, forgotten when too many are held."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = {k.removesuffix(END) + MARK if k.endswith(END) else k: v for k, v in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in model["merges"]:
            parts = [p.removesuffix(END) + MARK if p.endswith(END) else p for p in (a, b)]
            x, y, z = (self.ids[p] for p in (*parts, "".join(parts)))
            if z <= max(x, y) or (self.pairs and z <= max_seen):
                raise ValueError("the vocabulary is not in the order of its merges")
            max_seen = z
            self.pairs[x, y] = z
            self.left[z], self.right[z] = x, y
        self.known: dict[int, bool] = {}
        self.size, self.shorter = [0] * size, [-1] * size
        self.automaton = ahocorasick.Automaton()
        reached = {s: i for s, i in self.ids.items() if self.left[i] == i or self._apart(self.left[i], self.right[i], i)}
        for string, i in reached.items():
            self.size[i] = len(string)
            self.shorter[i] = next((reached[string[:n]] for n in range(len(string) - 1, 0, -1) if string[:n] in reached), -1)
            self.automaton.add_word(string, i)
        self.automaton.make_automaton()
        self.reached = reached
        names = [""] * size
        for string, i in (self.ids | self.special).items():
            names[i] = string.replace(MARK, END) + " "
        self.names = OffsetTable(names)

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge joins the end of token a with the start of token b before ``limit``.

        Both are undone from the later merge to the earlier one; a merge that would join
        what then touches, and comes before the one just undone, takes place instead.
        """
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made < limit:
                return False
            later_a = a > b if self.left[a] != a or self.right[a] != a else False
            if not later_a and self.left[b] == b and self.right[b] == b:
                if self.right[a] == a:
                    return True
                later_a = True
            if later_a:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def word(self, text: str) -> list[int]:
        """Ids of one word or run of marks, already composed and in lower case."""
        if not (text.isascii() and text.isprintable()):  # printable bytes stand for themselves
            text = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(ALPHABET)
        string = text + MARK
        whole = self.reached.get(string)
        if whole is not None:
            return [whole]
        size, shorter, known = self.size, self.shorter, self.known
        n = len(string)
        longest = [-1] * n
        for end, token in self.automaton.iter(string):
            longest[end - size[token] + 1] = token  # ends rise, so the last one is the longest
        live = bytearray(b"\1") * (n + 1)
        live[n - 1] = 0  # the end mark belongs to the last character
        out: list[int] = []
        last, at, token = -1, 0, longest[0]
        while at < n:
            while token >= 0:
                if live[at + size[token]]:
                    if last < 0:
                        break
                    key = last << 20 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = self._learn(key)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                last, token = token, longest[at] if at < n else -1
            else:
                live[at] = 0
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return out

    def _learn(self, key: int) -> bool:
        """An entry of the pair-compatibility table, which is filled as pairs are met."""
        if len(self.known) >= 4 * MOST_CACHED:
            self.known.clear()
        found = self.known[key] = self._apart(key >> 20, key & 0xFFFFF, 1 << 60)
        return found

    def __missing__(self, run: str) -> bytes:
        """Ids of a run without white space: its words one by one."""
        if len(self) >= MOST_CACHED:
            self.clear()
        words = [run] if run.isalpha() else (ASCII_WORDS if run.isascii() else WORDS).findall(run)
        if len(words) == 1:
            found = array("I", self.word(words[0])).tobytes()
        else:
            found = b"".join([self[w] for w in words])
        self[run] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as bytes. Names of special tokens stand for them, as in the library."""
        if "<|" not in text:
            return self.ordinary(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.ordinary(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.ordinary(text[at:])])

    def ordinary(self, text: str) -> bytes:
        """Ids of a whole text in which names of special tokens mean nothing."""
        if len(text) <= CHUNK:
            return self._chunk(text)
        out, at = [], 0
        while at < len(text):  # cut at white space, which is in no word and composes with nothing before it
            blank = BLANK.search(text, at + CHUNK)
            end = blank.start() if blank else len(text)
            out.append(self._chunk(text[at:end]))
            at = end
        return b"".join(out)

    def _chunk(self, text: str) -> bytes:
        if not text.isascii():
            if _beyond_latin(text) and UNKNOWN.search(text):
                return self._cut_by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        runs = BLANK.split(text.lower()) if ODD.search(text) else text.lower().split()
        return b"".join(map(self.__getitem__, runs))

    def _cut_by_library(self, text: str) -> bytes:
        """For characters that only the library's newer tables know: it composes and cuts, the words are encoded here."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        spans = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        back = {ord(c): b for b, c in ALPHABET.items()}
        words = [bytes(w.translate(back), "latin-1").decode() for w, _ in spans]
        return b"".join(array("I", self.word(w)).tobytes() for w in words)

    def decode(self, ids: np.ndarray) -> str:
        """Token names joined by single spaces, as the library does for a vocabulary without a decoder."""
        return self.names.join(ids)[:-1].decode()


class LibraryEncoder(Encoder):
    """The same ids, for operators that only need them: new words are merged by the library, one by one."""

    def __init__(self, path: str) -> None:
        dict.__init__(self)
        self.path, self.library = path, Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def word(self, text: str) -> list[int]:
        if not (text.isascii() and text.isprintable()):
            text = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(ALPHABET)
        return [t.id for t in self.model.tokenize(text)]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder per Python worker and file."""
    return LibraryEncoder(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``ids`` (array of int) and, if asked for, ``decoded`` (text from these ids).

    ``vocabulary`` is the file's path on every executor. Null and empty texts, and texts
    of white space only, have no ids and decode to the empty text. Repeated rows are
    encoded each. Nulls elsewhere play no part. Input columns named as the new ones are
    replaced. An empty table gives an empty one.
    """
    docs = others(docs, "ids", "decoded")
    schema = with_columns(docs.schema, "ids array<int>" + ", decoded string" * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for lo, hi in pieces(batch.column(text_col), 2 << 20):
                part = batch.slice(lo, hi - lo)
                found = [np.frombuffer(coder.encode(t or ""), "<u4") for t in part.column(text_col).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                back = [pa.array([coder.decode(f) for f in found], pa.string())] if decoded else []
                yield pa.record_batch([*part.columns, ids, *back], schema.names)

    return docs.mapInArrow(run, schema)
