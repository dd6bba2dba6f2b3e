"""Online packing by sums of squares.

Documents arrive one by one. What does not fill a whole window goes into the window
whose fill level it is best for: the placement that leaves the sum of squares of the
numbers of partly filled windows per level smallest, where a filled window leaves the
count. A level array holds these numbers, so a placement looks at levels, not windows.

Every task packs its own rows, in the order in which they are read, and holds open
windows only. When it ends, what is left open is cut where a power of two allows it:
sequences of such a length need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import library_encoder
from faultline.llm.frames import pieces

PIECE = "start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[int, int, int, bytes]  # row, start, length in ids, the ids
Placed = tuple[int, int, int, bytes, int, int]  # the same with sequence and offset


class SumOfSquares:
    """Packs one stream of documents into windows of ``size`` ids."""

    def __init__(self, size: int, most_open: int = 2048) -> None:
        self.size, self.most_open = size, most_open
        self.level = np.zeros(size + 1, np.int64)  # open windows per fill
        self.open: dict[int, list[list[Piece]]] = {}
        self.opened = 0
        self.sequences = 0

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _emit(self, window: list[Piece]) -> Iterator[Placed]:
        sequence, offset = self._next(), 0
        for row, start, length, ids in window:
            yield row, start, length, ids, sequence, offset
            offset += length

    def _best(self, length: int) -> int:
        """Fill level to place ``length`` ids into; 0 opens a window.

        Moving a window from level h to h + length changes the sum of squares by
        2 (N[h + length] - N[h]) + 2, and by -2 N[h] + 1 if that fills it.
        Ties go to the fullest window.
        """
        levels = np.flatnonzero(self.level[1 : self.size - length + 1]) + 1
        if not len(levels):
            return 0
        filled = levels + length
        change = 2 * (self.level[filled % self.size] - self.level[levels]) + 2  # a filled window leaves the count: level 0 is empty
        if filled[-1] == self.size:
            change[-1] = 1 - 2 * self.level[levels[-1]]
        k = len(change) - 1 - int(change[::-1].argmin())
        return int(levels[k]) if change[k] <= 2 * int(self.level[length]) + 1 else 0

    def _put(self, level: int, window: list[Piece]) -> None:
        self.open.setdefault(level, []).append(window)
        self.level[level] += 1
        self.opened += 1

    def _take(self, level: int) -> list[Piece]:
        windows = self.open[level]
        window = windows.pop()
        if not windows:
            del self.open[level]
        self.level[level] -= 1
        self.opened -= 1
        return window

    def add(self, row: int, ids: bytes) -> Iterator[Placed]:
        """Place one document; yields the pieces of the windows that this fills."""
        total = len(ids) // 4
        start = 0
        while total - start >= self.size:
            end = start + self.size
            yield row, start, self.size, ids[4 * start : 4 * end], self._next(), 0
            start = end
        length = total - start
        if not length:
            return
        level = self._best(length)
        window = self._take(level) if level else []
        window.append((row, start, length, ids[4 * start :]))
        if level + length == self.size:
            yield from self._emit(window)
        else:
            self._put(level + length, window)
            if self.opened > self.most_open:  # more than the memory set aside: the fullest one goes, without padding
                yield from self._cut(self._take(max(self.open)))

    def _cut(self, window: list[Piece]) -> Iterator[Placed]:
        """A partly filled window as sequences whose lengths are powers of two, longest first."""
        left = sum(length for _, _, length, _ in window)
        room, sequence, offset = 0, 0, 0
        for row, start, length, ids in window:
            at = 0
            while at < length:
                if not room:
                    room, sequence, offset = 1 << (left.bit_length() - 1), self._next(), 0
                    left -= room
                n = min(room, length - at)
                yield row, start + at, n, ids[4 * at : 4 * (at + n)], sequence, offset
                at, offset, room = at + n, offset + n, room - n

    def close(self) -> Iterator[Placed]:
        """What is still open, fullest first."""
        while self.open:
            yield from self._cut(self._take(max(self.open)))


def pack(docs: DataFrame, tokens: Callable[[str], bytes] | None = None, vocabulary: str | None = None, end_id: int = 2, size: int = 4096,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document's id, ``start``, ``length``, ``ids`` (array of int), ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id`` and ``offset``.

    Ids come from ``tokens`` (text to packed 32-bit ids), or else from ``vocabulary`` by the
    tokenizers library; ``end_id`` follows each document. A sequence belongs to one task; its
    id joins the task's partition and a running number. ``size`` must be a power of two.

    Null and empty texts are documents of one id, ``end_id``. A null or repeated document
    id is carried along; each row is packed. Documents longer than a window fill whole
    windows first. Other columns are not read. An empty table gives an empty one.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens or library_encoder(vocabulary).encode
        packer = SumOfSquares(size)
        base = TaskContext.get().partitionId() << 40
        end = int(end_id).to_bytes(4, "little")
        name: dict[int, tuple[object, int]] = {}  # of rows that have pieces in open windows
        left: dict[int, int] = {}
        ready: list[tuple] = []
        held = number = 0
        arrow = None

        def done(pieces_: Iterator[Placed]) -> None:
            nonlocal held
            for row, start, length, ids, sequence, offset in pieces_:
                doc, total = name[row]
                ready.append((doc, start, length, ids, zlib.crc32(ids), total, base | sequence, offset))
                held += length
                left[row] -= length
                if not left[row]:
                    del left[row], name[row]

        def batch() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*ready))
            ids = pa.array(np.frombuffer(b"".join(columns[3]), "<i4"))
            at = np.concatenate([[0], np.cumsum(columns[2])])
            arrays = [pa.array(columns[0], arrow), *[pa.array(c, pa.int64()) for c in columns[1:3]], pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids)]
            arrays += [pa.array(c, pa.int64()) for c in columns[4:]]
            ready.clear()
            held = 0
            return pa.record_batch(arrays, ["doc", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for given in batches:
            arrow = given.schema.field("doc").type
            for lo, hi in pieces(given.column("text"), 2 << 20):
                part = given.slice(lo, hi - lo)
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                    ids = coder(text or "") + end
                    name[number], left[number] = (doc, len(ids) // 4), len(ids) // 4
                    done(packer.add(number, ids))
                    number += 1
                    if held > 1 << 20:
                        yield batch()
        done(packer.close())
        if ready:
            yield batch()

    out = rows.mapInArrow(run, f"doc {kind.simpleString()}, {PIECE}")
    return out.withColumnRenamed("doc", id_col)
