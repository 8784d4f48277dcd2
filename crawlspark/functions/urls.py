"""URL functions as Column expressions.

Splitting follows the generic URI grammar instead of a strict URI parser: a URL with
blanks or template marks still has a host and a path, so nothing turns NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from crawlspark.functions.binding import let
from crawlspark.markers import COMMON_CAREERS_PATHS

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Network location with port and user, case kept."""
    return F.regexp_extract(url, _PREFIX + r"//([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(authority(url))


def path(url: Column) -> Column:
    """Path without the ``;params`` tail of its last segment."""
    return F.regexp_replace(
        F.regexp_extract(url, _PREFIX + r"(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", ""
    )


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def slash_count(url: Column) -> Column:
    p = path(url)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def registrable_domain(host_: Column) -> Column:
    """Last two host labels."""
    return F.substring_index(host_, ".", -2)


def trim_trailing_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


# --- resolving a reference against a base -----------------------------------


def _remove_dots(parts: Column) -> Column:
    """Apply ``.`` and ``..`` segments; a closing one leaves a trailing slash."""
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    closes = F.element_at(parts, -1).isin(".", "..")
    return F.when(closes, F.concat(walked, F.array(F.lit("")))).otherwise(walked)


def _join_path(parts: Column) -> Column:
    joined = F.array_join(parts, "/")
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on a page at ``base``."""
    base_root = F.concat(scheme(base), F.lit("://"), authority(base))
    base_path = path(base)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    ref_path = F.regexp_extract(href, r"^([^?#]*)", 1)

    rooted = F.split(ref_path, "/")
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    merged = F.split(F.concat(folder, ref_path), "/")
    # A merge keeps its first and last piece; empty ones in between vanish.
    merged = F.concat(
        F.slice(merged, 1, 1),
        F.filter(F.slice(merged, F.lit(2), F.greatest(F.size(merged) - 2, F.lit(0))), lambda s: s != ""),
        F.when(F.size(merged) > 1, F.slice(merged, -1, 1)).otherwise(F.array().cast("array<string>")),
    )
    parts = F.when(F.startswith(ref_path, F.lit("/")), rooted).otherwise(merged)
    has_dots = F.concat(F.lit("/"), ref_path, F.lit("/")).rlike(r"/\.\.?/")
    new_path = F.when(has_dots, _join_path(_remove_dots(parts))).otherwise(_join_path(parts))

    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike(_SCHEME), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("?")), F.concat(base_root, base_path, href))
        .when(F.startswith(href, F.lit("#")), F.concat(base_root, base_path, base_query, href))
        .otherwise(F.concat(base_root, new_path, tail))
    )


# --- query parameters -------------------------------------------------------


def _decode(text: Column) -> Column:
    """Percent-decode; a malformed escape stays as it stands."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    """Form encoding with ``~`` left alone and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pairs(url: Column) -> Column:
    """(k, v) in text order; parameters without a value are lost."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]*=."))
    return F.transform(
        parts,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def query_params(url: Column) -> Column:
    """map<key, list of values>, keys in first-seen order."""

    def grouped(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.transform(
            keys,
            lambda k: F.struct(
                k.alias("k"),
                F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("v"),
            ),
        )

    return F.map_from_entries(let(_pairs(url), grouped))


def with_params(url: Column, overrides: dict[str, Column | str | int]) -> Column:
    """``url`` with parameters replaced in place, or added at the end when new."""
    fixed = {k: v if isinstance(v, Column) else F.lit(str(v)) for k, v in overrides.items()}

    def rendered(params: Column) -> Column:
        keys = F.array_distinct(F.concat(F.map_keys(params), F.array(*[F.lit(k) for k in fixed])))

        def one(key: Column) -> Column:
            values = params[key]
            for name, value in fixed.items():
                values = F.when(key == name, F.array(value.cast("string"))).otherwise(values)
            return F.transform(values, lambda v: F.concat(_encode(key), F.lit("="), _encode(v)))

        return F.array_join(F.flatten(F.transform(keys, one)), "&")

    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    tail = F.regexp_extract(url, r"(#.+)$", 1)
    return F.concat(head, F.lit("?"), let(query_params(url), rendered), tail)


def append_param(url: Column, key: str, value: Column) -> Column:
    """Plain append, joined by ``&`` when the URL already has a query."""
    sep = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(url, sep, F.lit(f"{key}="), value.cast("string"))


# --- shapes and identifiers -------------------------------------------------


def shape(url: Column) -> Column:
    """Path with every segment reduced to N (digits) or S (anything else)."""
    return F.array_join(
        F.transform(segments(url), lambda s: F.when(s.rlike("^[0-9]+$"), "N").otherwise("S")), "/"
    )


def id_after(url: Column, word: str = "jobs") -> Column:
    """Segment behind the first ``word`` segment."""
    s = segments(url)
    at = F.array_position(s, word)
    return F.when(at > 0, F.try_element_at(s, (at + 1).cast("int")))


def id_last_after(url: Column, word: str = "jobs") -> Column:
    """Last ``/`` part of the URL when the part before it is ``word``."""
    parts = F.split(trim_trailing_slashes(url), "/")
    return F.when(
        F.try_element_at(parts, F.lit(-2)) == word, F.try_element_at(parts, F.lit(-1))
    )


def id_first_number(url: Column) -> Column:
    """First all-digit path segment."""
    return F.try_element_at(F.filter(segments(url), lambda s: s.rlike("^[0-9]+$")), F.lit(1))


def id_before_dash(url: Column) -> Column:
    """Text before the first dash of the last part."""
    last = F.substring_index(trim_trailing_slashes(url), "/", -1)
    return F.substring_index(last, "-", 1)


def id_last_dash_part(url: Column) -> Column:
    """Last dash part of the tail, query cut off, when it has three or more."""
    tail = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    parts = F.split(tail, "-")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1))


def candidate_urls(domain: Column, paths: Sequence[str] = COMMON_CAREERS_PATHS) -> Column:
    """Guessed page URLs of a domain, in order."""
    return F.array(*[F.concat(F.lit("https://"), domain, F.lit(p)) for p in paths])
