"""Structured content out of stored model replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crawlspark.functions.binding import let
from crawlspark.functions.jsontext import is_json, parsed, valid_json

_FENCE = "```"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _fenced(text: Column, language: str) -> Column:
    """Body of the named fence, else of a fence the text opens with, else the text."""
    mark = F.lit(_FENCE + language)
    named = F.regexp_extract(text, rf"(?s){_FENCE}{language}(.*)$", 1)
    parts = F.split(text, _FENCE)
    return (
        F.when(F.contains(text, mark), F.substring_index(named, _FENCE, 1))
        .when(F.startswith(text, F.lit(_FENCE)) & (F.size(parts) >= 2), F.element_at(parts, 2))
        .otherwise(text)
    )


def _first_to_last_brace(text: Column) -> Column:
    """From the first opening to the last closing brace, NULL without such a pair."""
    pattern = r"(?s)\{.*\}"
    return F.when(text.rlike(pattern), F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def json_text(reply: Column) -> Column:
    """JSON of a reply as text, NULL when none of it parses."""

    def pick(body: Column) -> Column:
        return F.when(is_json(body), body).otherwise(
            let(
                _first_to_last_brace(body),
                valid_json,
            )
        )

    return let(_strip(_fenced(_strip(reply), "json")), pick)


def code_text(reply: Column) -> Column:
    """Code of a reply with one closing newline."""
    return F.concat(_strip(_fenced(_strip(reply), "python")), F.lit("\n"))


def reply_fields(body: Column) -> dict[str, Column]:
    """Content and token usage of a stored completion; absent usage counts as 0."""
    reply = parsed(body)
    return {
        "content": F.try_variant_get(reply, "$.choices[0].message.content", "string"),
        "tokens_prompt": F.coalesce(F.try_variant_get(reply, "$.usage.prompt_tokens", "bigint"), F.lit(0)),
        "tokens_completion": F.coalesce(
            F.try_variant_get(reply, "$.usage.completion_tokens", "bigint"), F.lit(0)
        ),
    }
