"""Frames and Arrow batches: small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once by a vectorised step, so that its arrays stay in the processor's cache. A longer document is a piece of its own.
PIECE_BYTES = 256 << 10


def with_columns(schema: T.StructType, added: str) -> T.StructType:
    """The schema with new columns at its end; same-named old ones give way."""
    new = T.StructType.fromDDL(added)
    return T.StructType([f for f in schema.fields if f.name.lower() not in {n.lower() for n in new.names}] + new.fields)


def others(df: DataFrame, *named: str) -> DataFrame:
    """Without the columns (in any letter case) that the operator is about to add."""
    taken = {n.lower() for n in named}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, in order; each holds one row at least."""
    ends = np.asarray(offsets(texts)[1:], dtype=np.int64)
    start, base = 0, int(offsets(texts)[0]) if len(texts) else 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        base, start = int(ends[stop - 1]), stop


def offsets(texts: pa.Array) -> np.ndarray:
    """Where each string begins in the array's bytes, and where the last ends."""
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffer = texts.buffers()[1]
    if buffer is None:
        return np.zeros(len(texts) + 1, dtype=width)
    return np.frombuffer(buffer, dtype=width)[texts.offset : texts.offset + len(texts) + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings in one array, and each string's start (then the end). Nulls are empty."""
    at = offsets(texts).astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data = data[at[0] : at[-1]]
    return data, at - at[0]
