"""Row filters as boolean Columns.

Marker lists are short and fixed, so "holds any of these" is one alternation of literals
in generated code; no marker table is joined or broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from crawlspark import markers as M
from crawlspark.functions import urls as U


def _any_of(words: Sequence[str]) -> str:
    """Alternation of literals behind a look at the first character, which rules out most
    positions of a long text in one step."""
    heads = "".join(re.escape(c) for c in sorted({w[0] for w in words}))
    return f"(?=[{heads}])(?:" + "|".join(re.escape(w) for w in words) + ")"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(_any_of(words)) if words else F.lit(False)


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    return text.rlike("^" + _any_of(prefixes))


def ends_with_any(text: Column, suffixes: Sequence[str]) -> Column:
    return text.rlike(_any_of(suffixes) + r"\z")


def marker_hits(text: Column, words: Sequence[str] = M.API_URL_WORDS) -> Column:
    """How many of the words occur in the text, case ignored."""
    lowered = F.lower(text)
    return reduce(add, [F.contains(lowered, F.lit(w)).cast("int") for w in words])


def is_careers_url(url: Column, domain: Column, words: Sequence[str] = M.CAREERS_URL_WORDS) -> Column:
    return F.contains(url, domain) & contains_any(F.lower(url), words)


def is_denied(text: Column, hosts: Sequence[str] = M.TRACKING_HOSTS) -> Column:
    """Text (a whole URL or only its host) names a denied host."""
    return contains_any(text, hosts)


def is_api_like(url: Column, words: Sequence[str] = M.API_URL_WORDS) -> Column:
    return contains_any(F.lower(url), words)


def is_static_asset(url: Column, suffixes: Sequence[str] = M.STATIC_SUFFIXES) -> Column:
    return ends_with_any(F.lower(U.path(url)), suffixes)


def same_site(host: Column, registrable: Column) -> Column:
    return (registrable == "") | F.contains(host, registrable)


def is_navigable(href: Column) -> Column:
    """A link a reader could follow: no mail, phone, script, anchor or unfilled template."""
    return (
        (href != "")
        & ~starts_with_any(href, M.NON_NAVIGABLE_PREFIXES)
        & ~contains_any(href, M.TEMPLATE_PLACEHOLDERS)
    )


def is_web_url(url: Column) -> Column:
    return starts_with_any(url, ("http://", "https://"))


def slug_words(href: Column) -> Column:
    """Words of the slug: last path segment, or the one before a trailing number."""
    parts = U.segments(href)
    last = F.try_element_at(parts, F.lit(-1))
    slug = F.when(
        last.rlike("^[0-9]+$") & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-2))
    ).otherwise(last)
    return F.filter(F.split(slug, "[-_]"), lambda w: w != "")


def is_title_slug(
    words: Column,
    min_words: int = 3,
    generic: Sequence[str] = M.GENERIC_SLUG_WORDS,
    navigation: Sequence[str] = M.NAV_SLUG_WORDS,
) -> Column:
    """Words read like a posting title; a lone generic word stands for an id-only URL."""
    plain = tuple(generic) + tuple(navigation)
    specific = F.filter(words, lambda w: ~F.lower(w).isin(*plain))
    lone = (F.size(words) == 1) & F.lower(F.try_element_at(words, F.lit(1))).isin(*generic)
    return F.coalesce(lone | ((F.size(words) >= min_words) & (F.size(specific) >= 2)), F.lit(False))


def is_job_slug(href: Column, min_words: int = 3) -> Column:
    return is_title_slug(slug_words(href), min_words)


def is_job_link(
    href: Column, words: Sequence[str] = M.JOB_LINK_WORDS, min_words: int = 3
) -> Column:
    return contains_any(F.lower(href), words) & is_job_slug(href, min_words)


def is_graphql(url: Column, request_body: Column) -> Column:
    keys = F.json_object_keys(request_body)
    return F.contains(F.lower(url), F.lit("graphql")) | F.coalesce(
        F.array_contains(keys, "query") & F.array_contains(keys, "variables"), F.lit(False)
    )


def responded(status: Column) -> Column:
    """Answered without an error status."""
    return F.coalesce(status < 400, F.lit(False))


def is_pdf(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))


def is_usable_pdf_text(text: Column, min_chars: int = 100) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.length(trimmed) >= min_chars


def has_mojibake(*texts: Column, damaged: Sequence[str] = M.MOJIBAKE) -> Column:
    """Any of the texts holds a sequence left by decoding with the wrong code page."""
    joined = texts[0] if len(texts) == 1 else F.concat_ws("\n", *texts)
    return F.coalesce(contains_any(joined, damaged), F.lit(False))


def is_sufficient(
    url: Column, source_type: Column, pagination_status: Column, filter_mechanism: Column
) -> Column:
    return (
        url.isNotNull()
        & source_type.isNotNull()
        & pagination_settled(pagination_status)
        & filter_mechanism.isNotNull()
    )


def pagination_settled(pagination_status: Column) -> Column:
    return F.coalesce(pagination_status.isin("confirmed", "not_required"), F.lit(False))


def host_tier(
    url: Column,
    first: Sequence[str] = M.ATS_HOSTS,
    second: Sequence[str] = M.CAREERS_HOST_WORDS,
) -> Column:
    """0 for a known platform host, 1 for a host with a careers word, else 2."""
    h = U.host(url)
    return F.when(contains_any(h, first), 0).when(contains_any(h, second), 1).otherwise(2)


def is_strong(url: Column) -> Column:
    return host_tier(url) < 2


def mentions_city(location: Column, cities: Sequence[str] = M.DEFAULT_COUNTRY_CITIES) -> Column:
    tokens = F.split(F.lower(F.replace(location, F.lit("-"), F.lit(" "))), r"\s+")
    return F.arrays_overlap(tokens, F.array(*[F.lit(c.lower()) for c in cities]))
