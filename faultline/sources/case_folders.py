"""Benchmark cases on storage: ``<root>/<service>_<fault>/<instance>/`` with CSV files and the injection time."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.sources.benchmark import FAULT_TYPE, make_windows, whole_number
from faultline.session import store

PLACE = "_place"


def placed_lines(spark: SparkSession, root: str, system: str, name: str) -> DataFrame:
    """(incident_id, file, line, ``_place``) of file ``name`` of every case below ``root``.

    The incident is the case id ``<system>_<service>_<fault>_<instance>``, taken from the
    path; folders of unknown faults are no cases. Lines of a file compare by ``_place``:
    file, start of the block read, row in the block. So their order is known though a
    large file is read in many tasks. Blank lines are left out; no file at all is an
    empty table.
    """
    pattern = f"{root.rstrip('/')}/*/*/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path):
        return spark.createDataFrame([], f"incident_id string, file string, line string, {PLACE} struct<file:string,block:bigint,n:bigint>")
    parts = rf"/([^/]+)_([^/_]+)/([^/]+)/{name.replace('.', '[.]')}(/|$)"
    file = F.col("_metadata.file_path")
    place = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    read = spark.read.text(pattern).select(F.col("value").alias("line"), file.alias("file"), place.alias(PLACE))
    case = [F.regexp_extract("file", parts, i) for i in (1, 2, 3)]
    return read.where(case[1].isin(*FAULT_TYPE) & (F.trim("line") != "")).select(
        F.concat_ws("_", F.lit(system), *case).alias("incident_id"), "file", "line", PLACE)


def read_case_csv(spark: SparkSession, root: str, system: str, name: str) -> DataFrame:
    """Rows of CSV file ``name`` of every case: incident_id, ``_place`` and a text column for each heading.

    Files may differ in their headings: each distinct heading, of which there are as many
    as export formats, is read with its own columns, and a column that a file lacks is
    null. A heading named twice counts where it stands last; lines equal to the heading are
    no rows. A record is one line: a line break in quotes ends it.
    """
    lines = placed_lines(spark, root, system, name)
    heads = store(lines.groupBy("file").agg(F.min_by("line", PLACE).alias("head")), "heads")
    frames = [lines.select("incident_id", PLACE).limit(0)]
    for found in heads.select("head").distinct().collect():
        last = {title.strip().removeprefix("\ufeff"): i for i, title in enumerate(next(csv.reader([found.head])))}
        cells = ", ".join(f"c{i} string" for i in range(max(last.values()) + 1))
        mine = lines.join(heads.where(F.col("head") == found.head), "file").where(F.col("line") != F.col("head"))
        parsed = mine.select("incident_id", PLACE, F.from_csv("line", F.lit(cells), {"escape": '"'}).alias("r"))
        frames.append(parsed.select("incident_id", PLACE, *[F.col(f"r.c{i}").alias(title) for title, i in last.items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_case_windows(spark: SparkSession, root: str, system: str, pre: int = 180, post: int = 300) -> DataFrame:
    """The window of every case with a numeric ``inject_time.txt``; of several lines the first counts."""
    lines = placed_lines(spark, root, system, "inject_time.txt")
    times = lines.groupBy("incident_id").agg(whole_number(F.trim(F.min_by("line", PLACE))).alias("inject_time"))
    return make_windows(times.where(F.col("inject_time").isNotNull()), pre, post)
