"""Table schemas and the closed string domains used by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD_FIELDS = (
    "title", "job_id", "city", "state", "country", "country_code", "url", "apply_url",
    "date_posted", "date_posted_text", "job_description", "employment_type", "work_type",
    "salary_range",
)

SOURCE_TYPES = (
    "ssr_html", "embedded_json", "rest_api", "graphql", "spa_rendered", "spa_no_api", "unknown",
)
PAGINATION_STATUSES = ("confirmed", "not_required", "unknown", "failed")
FAILURE_CATEGORIES = (
    "syntax_error", "runtime_error", "http_forbidden", "timeout", "schema_drift",
    "pagination_undercount", "zero_results_filter_mismatch", "zero_results_parsing_bug",
    "contains_regex", "mojibake_encoding", "other",
)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), True) for n in names]


RECORD = T.StructType(_strings(*RECORD_FIELDS))

INTERACTIONS = T.ArrayType(T.StructType(_strings("action", "target")))

PAGE = T.StructType(
    _strings("domain", "url")
    + [T.StructField("status", T.IntegerType())]
    + _strings("html")
    + [T.StructField("interactions", INTERACTIONS)]
)

CAPTURE = T.StructType(
    _strings("domain")
    + [T.StructField("seq", T.LongType())]
    + _strings("url", "method")
    + [T.StructField("status", T.IntegerType())]
    + _strings("request_body", "body")
    + [T.StructField("request_headers", T.MapType(T.StringType(), T.StringType()))]
    + _strings("response_content_type")
)

PATTERN = T.StructType(
    _strings(
        "signature", "source_type", "pagination_mechanism", "pagination_param",
        "india_filter_mechanism", "ats_hint",
    )
    + [T.StructField("hit_count", T.LongType()), T.StructField("last_seen", T.DoubleType())]
)

EVIDENCE = T.StructType(
    _strings(
        "careers_url", "source_type", "pagination_status", "pagination_mechanism",
        "india_filter_mechanism",
    )
    + [
        T.StructField("requires_browser", T.BooleanType()),
        T.StructField("requires_firecrawl", T.BooleanType()),
        T.StructField("reported_total_count", T.LongType()),
    ]
    + _strings("evidence_notes")
)

# Trace lines keep these as columns; every other key stays in ``extras``.
TRACE_FIELDS = (
    "timestamp", "domain", "type", "node", "summary", "artifact_ref",
    "tokens_prompt", "tokens_completion",
)

COST_REPORT_FIELDS = (
    "domain", "status", "repair_attempts", "total_attempts_used", "tokens_prompt",
    "tokens_completion", "credits_used",
)
