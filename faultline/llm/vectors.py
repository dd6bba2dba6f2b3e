"""Vector columns: which rows take part, and packing rows into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sound(table: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id long, v array of double) of the rows that take part, each once.

    Rows with a null id or vector, an empty vector or one that holds a null or non-finite
    component are left out, and zero vectors unless ``zero``.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return (rows if zero else rows.filter(F.exists("v", lambda x: x != 0))).distinct()


def once(queries: DataFrame) -> DataFrame:
    """One row per query id; of several, the one whose vector comes first."""
    return queries.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def packed(rows: DataFrame, width: int, most: int) -> DataFrame:
    """Blocks of up to ``most`` rows of a partition: pid, seq, ids and the vectors as packed numbers, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        ids, vectors, held = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.record_batch([
                pa.array([pid], pa.int32()), pa.array([seq], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                pa.array([np.concatenate(vectors).astype("<f8").tobytes()], pa.binary()),
            ], ["pid", "seq", "ids", "data"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - held)
                ids.append(part.column("id").to_numpy())
                vectors.append(matrix(part.column("v"), width))
                at, held = at + part.num_rows, held + part.num_rows
                if held == most:
                    yield block()
                    ids, vectors, held, seq = [], [], 0, seq + 1
        if held:
            yield block()

    return rows.select("id", "v").mapInArrow(run, "pid int, seq int, ids binary, data binary")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query_id by falling score, then vec_id, with their rank from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
