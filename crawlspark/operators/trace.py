"""Trace events: console lines, cost, credits, artifact and revision numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.functions.binding import let
from crawlspark.operators import keyed as K

_HEAD_FIELDS = ("timestamp", "domain", "type", "node", "tool")


def truncated(text: Column, limit: int = 160) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    )


def console_line(line: Column) -> Column:
    """Short text of an event given as JSON; NULL hides it.

    Members print in the order of the line, a missing one as ``None``.
    """
    return let(
        F.from_json(line, "map<string,string>"),
        lambda fields: F.when(fields.isNotNull(), _console_text(fields)),
    )


def _python_word(value: Column) -> Column:
    return F.when(value == "true", "True").when(value == "false", "False").otherwise(value)


def _console_text(fields: Column) -> Column:
    def value(name: str, default: str = "None") -> Column:
        return F.coalesce(_python_word(F.try_element_at(fields, F.lit(name))), F.lit(default))

    def given(name: str) -> Column:
        return F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))

    node = F.when(given("node") == "", "-").otherwise(given("node"))
    at = F.concat(F.lit("    ["), node, F.lit("] "))
    pairs = F.transform(
        F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*_HEAD_FIELDS) & e["value"].isNotNull()),
        lambda e: F.concat(e["key"], F.lit("="), _python_word(e["value"])),
    )
    result = F.when(
        given("error") != "",
        F.concat(at, F.lit("<- "), value("tool", "?"), F.lit(" ERROR: "), truncated(given("error"))),
    ).otherwise(
        F.concat(at, F.lit("<- "), value("tool", "?"), F.lit(": "), truncated(F.array_join(pairs, ", ")))
    )
    settled = F.coalesce(
        F.try_element_at(fields, F.lit("pagination_param_confirmed")),
        F.try_element_at(fields, F.lit("pagination_status")),
        F.lit("None"),
    )
    lines = {
        "node_enter": F.concat(F.lit(">>> "), node),
        "tool_call": F.concat(
            at, F.lit("-> "), value("tool", "?"), F.lit("("), truncated(given("input")), F.lit(")")
        ),
        "tool_result": result,
        "decision": F.concat(
            at, F.lit("DECISION "), value("action", "?"), F.lit(": "), truncated(given("rationale"))
        ),
        "evidence": F.concat(
            at, F.lit("EVIDENCE source_type="), value("source_type"),
            F.lit(" pagination_confirmed="), _python_word(settled),
            F.lit(" sufficient="), value("sufficient"), F.lit(" confidence="), value("confidence"),
        ),
        "code_generated": F.concat(
            at, F.lit("CODE revision="), value("revision"), F.lit(" mode="), value("mode"),
            F.lit(" -> "), value("path"),
        ),
        "execution": F.concat(
            at, F.lit("EXEC exit_code="), value("exit_code"), F.lit(" duration="), value("duration"),
            F.lit("s timed_out="), value("timed_out"),
        ),
        "validation": F.concat(
            at, F.lit("VALIDATE passed="), value("passed"), F.lit(" rows="), value("row_count"),
            F.lit(" category="), value("failure_category"),
        ),
        "repair_decision": F.concat(
            at, F.lit("REPAIR action="), value("action"), F.lit(" category="),
            value("failure_category"), F.lit(" attempt="), value("repair_attempt"),
        ),
    }
    kind = F.try_element_at(fields, F.lit("type"))
    out = None
    for name, text in lines.items():
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out


# --- cost -------------------------------------------------------------------


def token_totals(events: DataFrame, keys: Sequence[str] = ("domain", "run_id")) -> DataFrame:
    """Tokens per run; an event without usage counts as 0."""
    return events.groupBy(*keys).agg(
        F.sum(F.coalesce("tokens_prompt", F.lit(0))).alias("tokens_prompt"),
        F.sum(F.coalesce("tokens_completion", F.lit(0))).alias("tokens_completion"),
    )


def final_status(status: Column) -> Column:
    """A run still marked running never resolved, so it failed."""
    return F.when(status == "running", "failed").otherwise(status)


def attempts_used(max_attempts: Column, attempts_left: Column) -> Column:
    return max_attempts - attempts_left


def cost_report(
    events: DataFrame,
    keys: Sequence[str] = ("domain", "run_id"),
    max_attempts: int = M.MAX_ATTEMPTS,
) -> DataFrame:
    """One row per run from its trace.

    Reads type, sufficient, passed, tokens and credit balances before and after. Only a
    passed validation makes a run succeed.
    """
    spent = F.count_if(
        ((F.col("type") == "evidence") & ~F.coalesce("sufficient", F.lit(False)))
        | (F.col("type") == "repair_decision")
    )
    passed = F.max((F.col("type") == "validation") & F.coalesce("passed", F.lit(False)))
    return events.groupBy(*keys).agg(
        final_status(F.when(passed, "success").otherwise("running")).alias("status"),
        F.count_if(F.col("type") == "repair_decision").alias("repair_attempts"),
        F.least(spent, F.lit(max_attempts)).alias("total_attempts_used"),
        F.sum(F.coalesce("tokens_prompt", F.lit(0))).alias("tokens_prompt"),
        F.sum(F.coalesce("tokens_completion", F.lit(0))).alias("tokens_completion"),
        F.sum(F.coalesce(credit_spend(), F.lit(0))).alias("credits_used"),
    )


def credit_spend(before: str = "credits_before", after: str = "credits_after") -> Column:
    """Credits of one call, never below 0; NULL when a balance is unknown."""
    known = F.col(before).isNotNull() & F.col(after).isNotNull()
    return F.when(known, F.greatest(F.col(before) - F.col(after), F.lit(0)))


def credit_totals(calls: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(credit_spend()).alias("measured_calls"),
        F.coalesce(F.sum(credit_spend()), F.lit(0)).alias("credits_used"),
    )


# --- running numbers --------------------------------------------------------


def artifact_index(
    artifacts: DataFrame, key: str, order: Sequence[Column], chunk: Column, name: str = "name"
) -> DataFrame:
    """Per-domain running number and file name, three digits at least."""
    numbered = K.number_rows(artifacts, [key], order, chunk, "artifact_no")
    return numbered.withColumn("artifact_name", F.format_string("%03d_%s", "artifact_no", name))


def revisions(
    events: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column
) -> DataFrame:
    """Code events with their revision number within the run."""
    code = events.where(F.col("type") == "code_generated")
    return K.number_rows(code, keys, order, chunk, "revision")
