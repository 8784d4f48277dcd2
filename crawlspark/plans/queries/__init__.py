"""Queries over the test tables; importing the package fills the registry."""

from crawlspark.plans.queries import (  # noqa: F401
    evidence_plan_query,
    evidence_queries,
    page_queries,
    payload_queries,
    quality_queries,
    record_queries,
    trace_queries,
    url_queries,
    verdict_queries,
)
