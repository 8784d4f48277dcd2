"""Stored listing to verdict: lines, typed records, one aggregation, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.operators import quality as Q


def validate_lines(
    lines: DataFrame,
    keys: Sequence[str],
    sets: DataFrame | None = None,
    required: Sequence[str] = M.REQUIRED_FIELDS,
    allowed: Sequence[str] = M.ALLOWED_COUNTRY_CODES,
) -> DataFrame:
    """Verdict per record set from its JSONL lines (keys, line_no, line).

    ``sets`` may bring reported_total, script_clean and output_found, and sets without
    any line. One bad line fails its set, whatever the other lines hold.
    """
    return verdicts(Q.line_facts(typed_lines(lines, keys), keys, allowed), keys, sets, required)


def typed_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-blank lines as typed records, with their number and ``is_bad``."""
    return Q.scan_lines(lines).select(*keys, "line_no", "is_bad", "record.*")


def verdicts(
    facts: DataFrame, keys: Sequence[str], sets: DataFrame | None = None, required: Sequence[str] = M.REQUIRED_FIELDS
) -> DataFrame:
    """Verdict per record set from ``quality.line_facts``."""
    if sets is not None:
        facts = sets.join(facts, list(keys), "left")

    def given(name: str):
        return F.col(name) if sets is not None and name in sets.columns else None

    return Q.record_set_report(
        facts,
        given("reported_total"),
        given("script_clean"),
        given("output_found"),
        F.col("lines_ahead"),
        required,
    ).drop("bad_at", "lines_ahead")
