"""Row-level column expressions: folds, callee parsing, templates, hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: severity names and their ranks
SEVERITY_RANKS = {
    "trace": 0,
    "debug": 1,
    "info": 2,
    "information": 2,
    "notice": 2,
    "warn": 3,
    "warning": 3,
    "error": 4,
    "err": 4,
    "critical": 5,
    "fatal": 5,
}

# fixed values: characters Python's str.strip removes from ASCII text
WHITESPACE = " \t\n\r\x0b\x0c"


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_error(status: str | Column = "status") -> Column:
    return F.upper(as_col(status)) == "ERROR"


def kind_is(kind: str, column: str | Column = "span_kind") -> Column:
    return F.coalesce(F.lower(as_col(column)) == kind, F.lit(False))


def severity_rank(severity: str | Column = "severity") -> Column:
    """Rank of a severity name, any case; unknown names rank 0."""
    table = F.create_map(*[F.lit(x) for pair in SEVERITY_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(as_col(severity))), F.lit(0))


def rpc_callee(operation: str | Column) -> Column:
    """Callee service named by an RPC operation such as ``pkg.CartService/Get``."""
    op = as_col(operation)
    segments = F.filter(
        F.split(F.substring_index(op, "/", 1), r"\."),
        lambda s: F.lower(s).endswith("service"),
    )
    segment = F.try_element_at(segments, F.lit(-1))
    stem = F.substring(segment, F.lit(1), F.length(segment) - 7)
    kebab = F.lower(F.regexp_replace(stem, r"(?<!^)(?=[A-Z])", "-"))
    return F.when(op.contains("/"), F.nullif(kebab, F.lit("")))


def strip(text: str | Column) -> Column:
    return F.btrim(as_col(text), F.lit(WHITESPACE))


def log_template(message: str | Column) -> Column:
    """Template of an error message: long hex ids and digit runs become ``#``."""
    text = F.regexp_replace(strip(message), r"(?U)\b[0-9a-f]{8,}\b", "#")
    return F.substring(F.regexp_replace(text, r"(?U)\d+", "#"), 1, 120)


def log_fingerprint(message: str | Column) -> Column:
    """Normal form used to compare incidents; coarser than :func:`log_template`."""
    text = F.regexp_replace(F.lower(as_col(message)), r"(?U)\b[0-9a-f]{8,}\b", "<id>")
    text = F.regexp_replace(text, r"(?U)\b\d+\b", "<n>")
    text = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.substring(text, 1, 120)


def log_line(message: str | Column, limit: int = 300) -> Column:
    """Message on one line, cut at ``limit`` characters with an ellipsis."""
    flat = F.replace(strip(message), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.substring(flat, 1, limit), F.lit("..."))
    return F.when(F.length(flat) > limit, cut).otherwise(flat)


def label_text(labels: str | Column) -> Column:
    """``k=v`` pairs of a map in key order, comma separated."""
    pairs = F.array_sort(F.map_entries(as_col(labels)))
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"])), ",")


def alert_fingerprint(name: str | Column, labels: str | Column, algorithm: str = "sha256") -> Column:
    """First 16 hex digits over the alert name and its sorted labels."""
    payload = F.concat(as_col(name), F.lit("|"), label_text(labels))
    digest = F.sha2(payload, 256) if algorithm == "sha256" else F.sha1(payload)
    return F.substring(digest, 1, 16)


def round6(value: str | Column) -> Column:
    return F.round(as_col(value), 6)


def tokens(text: str | Column) -> Column:
    """Distinct lower-case alphanumeric tokens of a text; null text has none."""
    parts = F.split(F.lower(F.coalesce(as_col(text), F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def contains_any(text: str | Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | as_col(text).contains(word)
    return found
