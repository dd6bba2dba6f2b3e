"""Documents to training windows: reject junk, drop repeated lines, keep one near copy, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import line_dedup, near_dedup, packing, quality
from faultline.llm.queries import VOCABULARY
from faultline.session import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, unchanged."""
    return quality.classify(docs).filter("quality_keep").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that another one keeps."""
    kept = line_dedup.line_dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies, and documents without an id."""
    first = near_dedup.classes(docs).filter("doc_id = class_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).union(docs.filter("doc_id is null"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: every piece of every document with its ids, sequence and offset."""
    return packing.pack(docs, vocabulary=VOCABULARY)


STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("packing", pack_stage)]
#: Neither the trained scorer nor signatures and ids can be said in SQL; each stage is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
