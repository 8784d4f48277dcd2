"""Trace events: cost, console, credits, numbering; in batch and as a stream.

An event row is a trace event of the user's run; its type decides which members it has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark.operators import keyed as K
from crawlspark.operators import trace as TR
from crawlspark.plans.inputs import table
from crawlspark.plans.queries.evidence_queries import CHUNK, SQL_ATTEMPTS_WITH, attempts, k_of
from crawlspark.plans.queries.quality_queries import _SQL_LINE_REPORT, event_lines
from crawlspark.plans.registry import query
from crawlspark.session import shared_dir
from crawlspark.sources import sinks
from crawlspark.streaming import trace_stream as TS

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_TYPES = {
    "view": "tool_result", "click": "tool_call", "purchase": "validation", "signup": "evidence",
    "error": "repair_decision",
}
_SQL_TYPE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"

_SQL_TRACE = f"""
trace AS (SELECT event_id, 'd' || user_id % 7 AS domain, user_id AS run_id, type, k, value,
    CASE WHEN type = 'tool_result' THEN k END AS tokens_prompt, CASE WHEN type = 'tool_result' AND k % 2 = 0 THEN k // 2 END AS tokens_completion,
    type = 'evidence' AND value < 5 AS sufficient, type = 'validation' AND value < 0.3 AS passed,
    CASE WHEN type = 'tool_call' THEN 1000 END AS credits_before, CASE WHEN type = 'tool_call' AND k % 3 <> 0 THEN 990 + k % 20 END AS credits_after
  FROM (SELECT *, {_K} AS k, {_SQL_TYPE} AS type FROM events))"""


def trace_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", k_of())
    kind = F.create_map(*[F.lit(x) for p in _TYPES.items() for x in p])[F.col("event_type")]
    k, is_result, is_call = F.col("k"), kind == "tool_result", kind == "tool_call"
    return e.select(
        "event_id",
        F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("domain"),
        F.col("user_id").alias("run_id"),
        kind.alias("type"),
        "k",
        "value",
        F.when(is_result, k).alias("tokens_prompt"),
        F.when(is_result & (k % 2 == 0), F.floor(k / 2).cast("int")).alias("tokens_completion"),
        ((kind == "evidence") & (F.col("value") < 5)).alias("sufficient"),
        ((kind == "validation") & (F.col("value") < 0.3)).alias("passed"),
        F.when(is_call, 1000).alias("credits_before"),
        F.when(is_call & (k % 3 != 0), 990 + k % 20).alias("credits_after"),
    )


_SQL_COST = f"""WITH {_SQL_TRACE} SELECT domain, run_id, CASE WHEN bool_or(passed) THEN 'success' ELSE 'failed' END AS status,
      count(*) FILTER (type = 'repair_decision') AS repair_attempts,
      least(count(*) FILTER (type = 'repair_decision' OR (type = 'evidence' AND NOT sufficient)), 8) AS total_attempts_used,
      CAST(sum(coalesce(tokens_prompt, 0)) AS BIGINT) AS tokens_prompt, CAST(sum(coalesce(tokens_completion, 0)) AS BIGINT) AS tokens_completion,
      CAST(sum(coalesce(greatest(1000 - credits_after, 0), 0)) AS BIGINT) AS credits_used
    FROM trace GROUP BY domain, run_id"""


@query("trace_cost", _SQL_COST)
def trace_cost(spark, sf_dir):
    return TR.cost_report(trace_events(spark, sf_dir))


@query("cost_report_files", _SQL_COST)
def cost_report_files(spark, sf_dir):
    """Cost reports written and read back."""
    reports, path = trace_cost(spark, sf_dir), shared_dir(spark, "cost")
    sinks.write_cost_reports(reports, path)
    return spark.read.schema(reports.schema).json(path)


@query(
    "credit_delta",
    f"""WITH {_SQL_TRACE} SELECT run_id, count(*) AS calls, count(credits_after) AS measured_calls,
      CAST(coalesce(sum(greatest(1000 - credits_after, 0)) FILTER (credits_after IS NOT NULL), 0) AS BIGINT) AS credits_used
    FROM trace WHERE type = 'tool_call' GROUP BY run_id""",
)
def credit_delta(spark, sf_dir):
    calls = trace_events(spark, sf_dir).where(F.col("type") == "tool_call")
    return TR.credit_totals(calls)


def trace_lines(spark, sf_dir):
    """Trace events as JSON lines."""
    t = trace_events(spark, sf_dir).join(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text"), "event_id", "left"
    )
    node = F.when(F.col("k") % 10 != 0, F.concat(F.lit("node"), (F.col("k") % 3).cast("string")))
    kind = F.col("type")
    line = F.to_json(
        F.struct(
            F.col("event_id").cast("double").alias("timestamp"),
            "domain",
            F.col("run_id").cast("string").alias("run_id"),
            "type",
            node.alias("node"),
            F.when(kind.isin("tool_call", "tool_result"), "fetch_url").alias("tool"),
            F.when(kind == "tool_call", F.concat(F.lit("in "), F.coalesce("text", F.lit("")))).alias("input"),
            F.when((kind == "tool_result") & (F.col("k") < 20), "boom").alias("error"),
            "tokens_prompt",
            "tokens_completion",
            F.when(kind == "evidence", "rest_api").alias("source_type"),
            F.when(kind == "evidence", F.col("sufficient")).alias("sufficient"),
            F.when(kind == "validation", F.col("passed")).alias("passed"),
            F.when(kind == "validation", F.col("k")).alias("row_count"),
            F.when(kind == "repair_decision", "patch").alias("action"),
            F.when(kind == "repair_decision", F.col("k")).alias("repair_attempt"),
        )
    )
    return t.select("event_id", line.alias("line"))


def _sql_cut(text: str) -> str:
    return f"CASE WHEN length({text}) <= 160 THEN {text} ELSE substr({text}, 1, 159) || '…' END"


_PAIRS = (
    "'run_id=' || run_id || ', tokens_prompt=' || k || "
    "CASE WHEN k % 2 = 0 THEN ', tokens_completion=' || (k // 2) ELSE '' END"
)
_SQL_CONSOLE = f"""WITH {_SQL_TRACE}, texts AS (
    SELECT t.*, CASE WHEN k % 10 <> 0 THEN 'node' || k % 3 ELSE '-' END AS node, coalesce(d.text, '') AS text
    FROM trace t LEFT JOIN documents d ON d.doc_id = t.event_id)
  SELECT event_id, '    [' || node || '] ' || CASE type
    WHEN 'tool_call' THEN '-> fetch_url(' || {_sql_cut("('in ' || text)")} || ')'
    WHEN 'tool_result' THEN CASE WHEN k < 20 THEN '<- fetch_url ERROR: boom' ELSE '<- fetch_url: ' || {_PAIRS} END
    WHEN 'evidence' THEN 'EVIDENCE source_type=rest_api pagination_confirmed=None sufficient=' || CASE WHEN sufficient THEN 'True' ELSE 'False' END || ' confidence=None'
    WHEN 'validation' THEN 'VALIDATE passed=' || CASE WHEN passed THEN 'True' ELSE 'False' END || ' rows=' || k || ' category=None'
    WHEN 'repair_decision' THEN 'REPAIR action=patch category=None attempt=' || k END AS line_text
  FROM texts"""


@query("trace_console", _SQL_CONSOLE)
def trace_console(spark, sf_dir):
    lines = trace_lines(spark, sf_dir)
    return lines.select("event_id", TR.console_line(F.col("line")).alias("line_text"))


@query(
    "artifact_index",
    """SELECT user_id, event_id, CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END
        || '_' || event_type || '.html' AS artifact_name
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""",
)
def artifact_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.concat("event_type", F.lit(".html")).alias("name")
    )
    out = TR.artifact_index(e, "user_id", [F.col("event_id")], K.span(F.col("event_id"), CHUNK))
    return out.select("user_id", "event_id", "artifact_name")


@query(
    "revisions",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision
      FROM events WHERE event_type = 'purchase'""",
)
def revisions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_type") == "purchase", "code_generated").otherwise("other").alias("type"),
    )
    out = TR.revisions(e, ["user_id"], [F.col("event_id")], K.span(F.col("event_id"), CHUNK))
    return out.select("user_id", "event_id", "revision")


# --- streams ----------------------------------------------------------------


def _run(started) -> None:
    """Wait for a finite stream; a failed one raises here."""
    started.awaitTermination()


@query(
    "stream_trace_cost",
    f"""WITH {_SQL_TRACE} SELECT domain, CAST(run_id AS VARCHAR) AS run_id, CAST(sum(coalesce(tokens_prompt, 0)) AS BIGINT) AS tokens_prompt,
      CAST(sum(coalesce(tokens_completion, 0)) AS BIGINT) AS tokens_completion FROM trace GROUP BY domain, run_id""",
)
def stream_trace_cost(spark, sf_dir):
    """Trace appended as JSONL, read back as a stream, totals kept in update mode."""
    root = shared_dir(spark, "trace-cost")
    events = trace_events(spark, sf_dir).select(
        F.col("event_id").cast("double").alias("timestamp"), "domain", F.col("run_id").cast("string").alias("run_id"),
        "type", "tokens_prompt", "tokens_completion",
    )
    sinks.append_trace(events, f"{root}/trace", partition_by=("domain",))
    totals = TS.running_cost(TS.trace_stream(spark, f"{root}/trace", files_per_trigger=4))
    _run(TS.append_batches(totals, f"{root}/out", f"{root}/checkpoint", "update"))
    schema = "domain string, run_id string, tokens_prompt long, tokens_completion long, batch_id long"
    return TS.latest(spark, f"{root}/out", schema, ["domain", "run_id"])


@query(
    "stream_console",
    _SQL_CONSOLE.replace("SELECT event_id, '    ['", "SELECT CAST(event_id AS DOUBLE) AS event_time, '    ['"),
)
def stream_console(spark, sf_dir):
    root = shared_dir(spark, "trace-console")
    trace_lines(spark, sf_dir).select(F.col("line").alias("value")).write.text(f"{root}/trace")
    lines = TS.console(TS.trace_stream(spark, f"{root}/trace"))
    _run(TS.append_batches(lines, f"{root}/out", f"{root}/checkpoint"))
    out = spark.read.schema("timestamp double, text string").option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return out.select(F.col("timestamp").alias("event_time"), F.col("text").alias("line_text"))


@query(
    "stream_stagnation",
    f"""{SQL_ATTEMPTS_WITH} SELECT CAST(run_id AS VARCHAR) AS run_id, attempt,
      NOT sufficient AND coalesce(fingerprint = lag(fingerprint) OVER (PARTITION BY run_id ORDER BY attempt), false) AS stagnant,
      CAST(greatest(4 - sum(CASE WHEN sufficient THEN 0 ELSE 1 END)
        OVER (PARTITION BY run_id ORDER BY attempt ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS attempts_left FROM attempts""",
)
def stream_stagnation(spark, sf_dir):
    """Attempts arrive in event order over several batches, not in run order."""
    root = shared_dir(spark, "attempts")
    numbered = attempts(spark, sf_dir).withColumn("run_id", F.col("run_id").cast("string"))
    schema = numbered.schema
    numbered.repartitionByRange(4, "event_id").write.json(f"{root}/attempts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(f"{root}/attempts")
    _run(TS.append_batches(TS.live_attempts(stream, 4), f"{root}/out", f"{root}/checkpoint"))
    out = spark.read.schema("run_id string, attempt long, stagnant boolean, attempts_left long")
    return out.option("recursiveFileLookup", "true").parquet(f"{root}/out")


@query("stream_record_check", _SQL_LINE_REPORT)
def stream_record_check(spark, sf_dir):
    """Record lines are checked as they arrive; the lines of a set spread over two micro-batches."""
    root = shared_dir(spark, "record-lines")
    lines = event_lines(spark, sf_dir)
    lines.repartition(4, "line_no").write.json(f"{root}/lines")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).json(f"{root}/lines")
    _run(TS.check_record_sets(stream, f"{root}/out", f"{root}/checkpoint", ["set_id"], ("title", "job_id")))
    return TS.latest(spark, f"{root}/out/reports", "set_id long, row_count long, details string, batch_id long", ["set_id"])
