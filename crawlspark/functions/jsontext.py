"""Whole-text JSON checks.

``try_parse_json`` reads the first value and ignores what follows it, so text with a JSON
head would pass. Here the text is parsed as a member in front of an end mark: the mark is
only reached when the text is one value and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crawlspark.functions.binding import let


def _framed(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end_of_text":true}')))


def _ended(framed: Column) -> Column:
    return F.coalesce(F.try_variant_get(framed, "$.end_of_text", "boolean"), F.lit(False))


def is_json(text: Column) -> Column:
    return _ended(_framed(text))


def is_json_object(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*\{"), F.lit(False)) & is_json(text)


def valid_json(text: Column) -> Column:
    """The text when it is JSON, else NULL."""
    return F.when(is_json(text), text)


def parsed(text: Column) -> Column:
    """The text as VARIANT when it is JSON, else NULL."""
    return let(_framed(text), lambda v: F.when(_ended(v), F.try_variant_get(v, "$.v", "variant")))
