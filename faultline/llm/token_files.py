"""Token counts of documents in flat token files.

A flat file is token ids, end to end, with an end-of-document id after each document, and
no index. It is read in blocks of fixed size by as many tasks as there are blocks. A block
is searched for the separator in one vectorised comparison; documents that cross blocks are
stitched by a prefix scan: the running number of separators gives a document's place in its
file, the running last separator its start. The scan has two levels, so that a file of any
length is windows of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.bpe import encoder
from faultline.llm.frames import pieces
from faultline.session import scratch_path, store

BLOCK = 1 << 22  # tokens
GROUP = 1024  # blocks of a window of the scan


def write_flat(docs: DataFrame, folder: str, vocabulary: str, separator: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the tokens of ``docs`` to flat files below ``folder``, a file per task; returns (id, file, ordinal) per document.

    Ids are little-endian unsigned numbers of ``width`` bytes. Names of special tokens in
    a text are ordinary text, so that the separator stands nowhere else. An attempt writes
    to a name of its own, and only files that the returned table names count.

    Null and empty texts are documents without tokens. Null and repeated ids are carried along.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"<u{width}"
    disk, root = fs.FileSystem.from_uri(folder)
    disk.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out, name, number = encoder(vocabulary), None, f"tokens-{uuid.uuid4().hex}.bin", 0
        end = np.array([separator], kind).tobytes()
        disk, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            if out is None and batch.num_rows:
                out = disk.open_output_stream(f"{root}/{name}", compression=None)
            for lo, hi in pieces(batch.column("text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                for text in part.column("text").to_pylist():
                    out.write(np.frombuffer(coder.ordinary(text or ""), "<u4").astype(kind).tobytes() + end)
                places = np.arange(number, number + len(part), dtype=np.int64)
                number += len(part)
                yield pa.record_batch([part.column("id"), pa.array([name] * len(part)), pa.array(places)], ["id", "file", "ordinal"])
        if out is not None:
            out.close()

    return store(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, file string, ordinal long"), "token_documents")


def scan_flat(files: DataFrame, folder: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) per document of the files (file, length in bytes) below ``folder``.

    ``ordinal`` and ``start`` count documents and tokens of the file from 0; ``n_tokens``
    is without the separator. Tokens after the last separator are a last document that is
    not ``terminated``; a file that ends with a separator has none. Separators in a row
    are empty documents, an empty file has no document. A length that is no multiple of
    the width fails the job.
    """
    whole = files.select("file", F.expr(f"if(length % {width} = 0, cast(length / {width} as long), cast(raise_error('a file ends inside a token') as long))").alias("total"))
    blocks = whole.filter("total > 0").select("file", "total", F.explode(F.sequence(F.lit(0), F.expr(f"cast((total - 1) div {block} as int)"))).alias("block"))
    spread = blocks.repartition(max(1, min(4096, blocks.count())), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column("block")[i].as_py() * block
                n = min(block, batch.column("total")[i].as_py() - first)
                with disk.open_input_file(f"{root}/{batch.column('file')[i].as_py()}") as file:
                    tokens = np.frombuffer(file.read_at(n * width, first * width), f"<u{width}")
                ends = np.flatnonzero(tokens == separator) + first
                yield pa.record_batch([*[batch.column(c).slice(i, 1) for c in ("file", "total", "block")], pa.array([ends], pa.list_(pa.int64()))], ["file", "total", "block", "ends"])

    found = store(spread.mapInArrow(run, "file string, total long, block int, ends array<long>"), "separators")
    sums = found.select("file", "block", F.expr(f"block div {GROUP}").alias("part"), F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last"))
    within = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    parts = parts.select("file", "part", F.sum("n").over(before).alias("n_before"), F.max("last").over(before).alias("last_before"))
    carried = sums.select("file", "block", "part", F.sum("n").over(within).alias("n_here"), F.max("last").over(within).alias("last_here")).join(parts, ["file", "part"])
    carried = carried.select("file", "block", (F.coalesce("n_here", F.lit(0)) + F.coalesce("n_before", F.lit(0))).alias("base"), F.coalesce("last_here", "last_before", F.lit(-1)).alias("carry"))
    met = found.join(carried, ["file", "block"])
    starts = F.transform("ends", lambda e, i: F.when(i == 0, F.col("carry") + 1).otherwise(F.get("ends", i - 1) + 1))
    each = met.select("file", "base", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), starts.alias("start"))).alias("i", "d"))
    closed = each.select("file", (F.col("base") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    rest = sums.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start")).join(whole, "file")
    rest = rest.filter("start < total").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.union(rest)


def listed(folder: str, names: DataFrame) -> DataFrame:
    """(file, length) of the named files; Spark lists the folder, and no content is read."""
    found = names.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return found.join(names.select("file").distinct(), "file", "left_semi")


def token_counts(docs: DataFrame, vocabulary: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``, ``start``) per document, counted in the flat files that its tokens were written to.

    Cases as in `write_flat` and `scan_flat`; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    written = write_flat(docs, folder, vocabulary, separator, id_col=id_col, text_col=text_col)
    if written.isEmpty():
        return written.select(F.col("id").alias(id_col), F.col("ordinal").alias("n_tokens"), F.col("ordinal").alias("start"))
    counts = scan_flat(listed(folder, written), folder, separator)
    return written.join(counts, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens", "start")
