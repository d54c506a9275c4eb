"""Sinks: tables, one-row reports and verified intermediates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contracts import spec_fingerprint, table_digest


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json_report(metrics: DataFrame, path: str) -> None:
    """A metrics frame of one row as a single JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def verified(
    spark: SparkSession,
    path: str,
    spec: dict,
    build: Callable[[], DataFrame],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A stored intermediate, reused only if its specification and its content still match.

    The table lies under a name that carries the fingerprint of ``spec``; a sidecar row holds
    the content digest. The content is digested again on every call, so a table that was
    rewritten since is rebuilt and never trusted.
    """
    name = f"{path}/v-{spec_fingerprint(spec)}"
    stored, sidecar = f"{name}/rows", f"{name}/digest"
    try:
        rows = spark.read.parquet(stored)
        expected = spark.read.json(sidecar, schema="n_rows long, digest string").first()
        chosen = list(columns or rows.columns)
        actual = table_digest(rows, sorted(chosen), spec_fingerprint(spec)).first()
        if expected is not None and tuple(actual) == tuple(expected):
            return rows
    except AnalysisException:
        pass
    write_parquet(build(), stored)
    rows = spark.read.parquet(stored)
    chosen = list(columns or rows.columns)
    digest = table_digest(rows, sorted(chosen), spec_fingerprint(spec))
    write_json_report(digest.select("n_rows", "digest"), sidecar)
    return rows


def stale(current: DataFrame, stored: DataFrame, columns: Sequence[str], salt: str = "") -> bool:
    """Does the stored artifact still equal the one from before a change?"""
    a, b = (table_digest(d, columns, salt).first() for d in (current, stored))
    return tuple(a) == tuple(b)
