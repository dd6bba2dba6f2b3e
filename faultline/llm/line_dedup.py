"""Lines that several documents share, dropped everywhere but in one of them.

Lines are exploded with their position, normalised and hashed to 128 bits, so no
text travels to be counted. Documents are counted per hash from rows that are
distinct in (hash, document) already; a line in a third of all documents is one
partial count per task. What to drop comes back as positions per document, and one
join by document reassembles the text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.frames import others, with_columns
from faultline.session import store

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, positions: pd.Series) -> pd.Series:
    """The texts without the lines at these positions."""

    def one(text: str, drop: object) -> str:
        gone = set(drop)
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([text if drop is None else one(text, drop) for text, drop in zip(texts, positions)], dtype=object)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All rows and columns of ``docs``, with the text's repeated lines dropped, and ``n_lines`` (before) and ``n_dropped``.

    A key of ``min_chars`` code points or more found in ``min_docs`` documents or more
    loses all its lines except in the largest id that holds it.

    Null or empty text is one empty line and becomes the empty text. A null id is no
    document to be counted and never the one that keeps a line. Rows that repeat an id
    count once for it. Input columns named as the new ones are replaced. An empty table
    gives an empty one.
    """
    docs = others(docs, "n_lines", "n_dropped")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("which"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("rest"))
    lines = rows.select("doc", "which", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc", "which", "at", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.length("key") >= min_chars).select("doc", "which", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    held = lines.groupBy("h1", "h2", "doc", "which").agg(F.collect_list("at").alias("ats"))
    shared = (
        lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("doc").alias("n"), F.max("doc").alias("keeper"))
        .filter(F.col("n") >= min_docs)
    )
    shared = store(shared, "shared_lines")  # as a table of its own it is joined by a plain exchange, whose hot keys Spark splits
    drops = (
        held.join(shared, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "which").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("drop"))
    )
    drops = drops.select(F.col("doc").alias("doc_"), F.col("which").alias("which_"), "drop")
    joined = rows.join(drops, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("which") == F.col("which_")), "left")
    out = joined.select(
        F.col("doc").alias(id_col), _without("text", "drop").alias(text_col), *[F.col("rest").getField(c).alias(c) for c in rest],
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
    )
    return out.select(*[F.col(f"`{c}`") for c in with_columns(docs.schema, "n_lines long, n_dropped long").names])
