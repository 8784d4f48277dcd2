"""Writers. Rows are rebalanced by file key first: hot keys are split over several
tasks, small ones share a file, so neither huge tasks nor a flood of files results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark.schema import COST_REPORT_FIELDS, RECORD_FIELDS


def record_line(fields: Sequence[str] = RECORD_FIELDS) -> Column:
    """One JSON line with every key present, nulls written, text not escaped to ASCII."""
    return F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"})


def write_record_lines(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.select(record_line().alias("value")).write.mode(mode).text(path)


def append_trace(
    events: DataFrame, path: str, partition_by: Sequence[str] = ("domain", "run_id")
) -> None:
    """Append events as JSONL, one folder per domain and run; null members are left out.

    With very many short runs, partition by fewer columns: a folder each would mean more
    files than events.
    """
    keyed = events.hint("rebalance", *partition_by)
    # Partition columns leave the line, so the folders are named by copies.
    out = keyed.withColumns({f"by_{c}": F.col(c) for c in partition_by})
    out.write.mode("append").partitionBy(*[f"by_{c}" for c in partition_by]).json(path)


def write_confidence(confidence: DataFrame, path: str, mode: str = "errorifexists") -> None:
    confidence.write.mode(mode).json(path)


def write_patterns(store: DataFrame, path: str) -> None:
    """To a new path: the old store is still being read while this one is written."""
    store.write.mode("errorifexists").json(path)


def write_cost_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    reports.select("run_id", *COST_REPORT_FIELDS).write.mode(mode).json(path)
