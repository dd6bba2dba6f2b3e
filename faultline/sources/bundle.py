"""Incident bundles on storage: scan, strict validation, and the sealed sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.operators.quality import BANNED_TOKENS, banned_token_findings
from faultline.schema import RULES, SIGNALS
from faultline.session import store

FILES = {"traces": "traces.jsonl", "metrics": "metrics.jsonl", "logs": "logs.jsonl", "changes": "changes.jsonl", "runbooks": "runbooks.jsonl"}
SEALED_PARTS = ("eval_only", "raw")
ORDER = {
    "metrics": ["time", "service", "metric", "value"], "logs": ["time", "service", "severity", "message", "trace_id"],
    "traces": ["time", "trace_id", "span_id", "parent_span_id"], "changes": ["time", "id"],
}


class SealedPathError(ValueError):
    """A path outside the public part of a bundle was asked for."""


def public_pattern(root: str, name: str) -> str:
    """Glob of one public file of every bundle below ``root``."""
    if any(part in SEALED_PARTS for part in root.split("/")):
        raise SealedPathError(f"not a public location: {root}")
    return f"{root.rstrip('/')}/*/public/{name}"


def _lines(spark: SparkSession, pattern: str) -> DataFrame:
    reader = spark.read.option("ignoreMissingFiles", "true")
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:  # a signal no bundle has is an empty table
        return spark.createDataFrame([], "line string, incident_id string")
    text = reader.text(pattern).withColumnRenamed("value", "line")
    return text.where(F.trim("line") != "").select(
        "line", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/public/", 1).alias("incident_id"))


def validate_rows(lines: DataFrame, signal: str) -> DataFrame:
    """JSON lines (column ``line``) as typed rows plus ``reject_reasons`` (empty for valid rows).

    Unknown fields, wrong types, empty text and out-of-range numbers are reasons. Each line is
    parsed once: filters do not reach below the explode, where they would parse it for each field.
    """
    schema = SIGNALS[signal]
    rest = [c for c in lines.columns if c != "line"]
    read = F.struct(F.json_object_keys("line").alias("keys"), F.from_json("line", schema).alias("r"))
    parsed = lines.select(*rest, "line", F.explode(F.array(read)).alias("_read")).select(*rest, "line", F.col("_read.keys").alias("_keys"), "_read.r.*")
    extra = F.array_except(F.coalesce("_keys", F.array().cast("array<string>")), F.array(*[F.lit(n) for n in schema.names]))
    reasons = [F.when(F.col("_keys").isNull(), F.lit("not a JSON object"))]
    reasons += [F.when(F.coalesce(~F.expr(rule), F.lit(True)), F.lit(text)) for rule, text in RULES[signal]]
    unknown = F.transform(extra, lambda k: F.concat(F.lit("unknown field "), k))
    found = F.concat(F.filter(F.array(*reasons), lambda v: v.isNotNull()), unknown)
    return parsed.withColumn("reject_reasons", found).drop("_keys")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = checked.where(F.size("reject_reasons") == 0).drop("reject_reasons", "line")
    rejects = checked.where(F.size("reject_reasons") > 0).select(
        *[c for c in ("incident_id",) if c in checked.columns], "line", "reject_reasons")
    return valid, rejects


def with_span_kind(spans: DataFrame) -> DataFrame:
    """Lift the kind and RPC method out of the attribute map."""
    return spans.withColumn("span_kind", F.lower(F.try_element_at("attributes", F.lit("span.kind")))).withColumn(
        "rpc_method", F.try_element_at("attributes", F.lit("rpc.method")))


def read_bundles(spark: SparkSession, root: str, strict: bool = True) -> dict[str, DataFrame]:
    """Canonical tables of all bundles below ``root``.

    Strict reading fails the job on the first invalid row; otherwise rejected
    rows come back under ``rejects``, and the typed rows are stored, so that the
    lines are read and parsed once for both.
    """
    out: dict[str, DataFrame] = {}
    rejects = None
    for signal in ("traces", "metrics", "logs", "changes"):
        checked = validate_rows(_lines(spark, public_pattern(root, FILES[signal])), signal)
        if strict:
            message = F.concat(F.lit(f"invalid {signal} row: "), F.array_join("reject_reasons", ", "), F.lit(" in "), "line")
            checked = checked.where(F.when(F.size("reject_reasons") > 0, F.raise_error(message).cast("boolean")).otherwise(True))
        else:
            bad_line = F.when(F.size("reject_reasons") > 0, F.col("line"))
            checked = store(checked.withColumn("line", bad_line), f"checked-{signal}")
        valid, bad = split_valid(checked)
        out[signal] = valid
        bad = bad.withColumn("signal", F.lit(signal))
        rejects = bad if rejects is None else rejects.unionByName(bad)
    out["spans"] = with_span_kind(out.pop("traces"))
    manifests = (
        spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(SIGNALS["manifest"]).json(public_pattern(root, "manifest.json"))
        .withColumn("incident_id", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/public/", 1)))
    out["incidents"] = manifests.select(
        "incident_id", "scenario_id", "source", "symptom", "available_signals", "notes", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))
    out["alerts"] = manifests.select("incident_id", F.explode("alerts").alias("a")).select("incident_id", "a.*")
    out["runbooks"] = _lines(spark, public_pattern(root, FILES["runbooks"])).select(
        "incident_id", F.from_json("line", "map<string,string>").alias("runbook"))
    out["rejects"] = rejects
    return out


class LeakError(ValueError):
    """Public output would hold a banned token."""


def write_bundle(tables: dict[str, DataFrame], truth: DataFrame | None, path: str, fmt: str = "json", tokens: list[str] = BANNED_TOKENS) -> None:
    """Write canonical tables by incident, rows in canonical order, truth in its own sealed folder.

    Nothing is written when a public row holds a banned token. Incidents spread
    over time slices, so one large incident does not end up in a single task.
    """
    for signal, df in tables.items():
        lines = df.select(F.to_json(F.struct(*df.columns)).alias("line"))
        if not banned_token_findings(lines, tokens).isEmpty():
            raise LeakError(f"{signal} holds a banned token")
    for signal, df in tables.items():
        order = [c for c in ORDER.get(signal, []) if c in df.columns]
        if order:
            laid = df.repartitionByRange("incident_id", *[F.col(c).asc_nulls_first() for c in order])
            df = laid.sortWithinPartitions("incident_id", *[F.col(c).asc_nulls_first() for c in order])
        df.write.mode("errorifexists").format(fmt).partitionBy("incident_id").save(f"{path}/public/{signal}")
    if truth is not None:
        truth.write.mode("errorifexists").format(fmt).save(f"{path}/eval_only/truth")
