"""Session helpers: shared work folder, checkpoints, and a session for local use."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, folder: str | None = None) -> SparkSession:
    """A session for tests and the bench, with its scratch folder; clusters bring their own."""
    named = {"spark.checkpoint.dir": folder} if folder else {}
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("faultline")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=named)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in
    tests, a folder in the warehouse is used: the other place that the driver and
    all executors share. Never a machine-local temporary folder, which does not
    outlive its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/faultline_scratch"


def _owned_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one; `release` removes it."""
    return f"{shared_dir(spark).rstrip('/')}/faultline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, one per use, removed by `release`."""
    return f"{_owned_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove every intermediate that this application wrote.

    Frames that read them are void afterwards, so the owner of the session calls it
    when the results have been written; what is left goes when Python ends.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_owned_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now, and the folder with it
        if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
            release(spark)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on reliable storage; iterative operators call this per round."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{_owned_dir(spark)}/checkpoints")
    return df.checkpoint(eager=True)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate that several branches read to the shared folder, and read it back.

    Columnar, so each branch reads only its columns, and its size is known to the
    planner. Worth it where recomputing means repeating a shuffle of the telemetry.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
