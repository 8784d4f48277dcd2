"""Extraction from page HTML with built-in functions.

``tokens`` cuts a page once into tags, texts, comments and whole script and style elements, quoted
attribute values taken whole; elements, attributes and texts are then found in that array. An element
ends at the closing tag that matches it, a paragraph also at the next one, or with the page. Character
references are decoded as browsers do: all names, those without a semicolon that may do so, and
numbers with their replacements.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from crawlspark import markers as M
from crawlspark.functions import predicates as P
from crawlspark.functions import urls as U
from crawlspark.functions.binding import let

# An attribute value: double-quoted, single-quoted or bare.
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
_INVISIBLE = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
)
# The attributes of a tag up to some place, as few as needed; what may follow them starts with blanks.
_ATTRIBUTES = r"""(?:[\s/]++(?:[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>]++))?+)?+)*?[\s/]++"""
# The rest of a tag; a quoted value as a whole, so a > inside it doesn't end the tag.
_REST = r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>"""
_TEXT = r"(?:<(?![A-Za-z/!?])[^<]*+)*+"
_PIECE = (
    rf"(?is)<!--.*?(?:-->|\z)|<script(?=[\s/>]){_REST}.*?(?:</script\s*+>|\z)|<style(?=[\s/>]){_REST}.*?(?:</style\s*+>|\z)"
    rf"|</?[A-Za-z]{_REST}|<[A-Za-z/!?][^>]*+>|[^<]++{_TEXT}|<(?![A-Za-z/!?])[^<]*+{_TEXT}|<[^<]*+"
)
URL_LITERAL = r"""["'`]((?:https?:)?//[^"'`\s]+|/[A-Za-z0-9._~/%+?&=-]+)["'`]"""


def markup(html: Column) -> Column:
    """HTML without comments and without script and style bodies."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _INVISIBLE, "")


# What may stand behind the ampersand of a reference.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")
_NAMES = [*_COMMON, *(n for n in html5 if n.endswith(";") and n not in _COMMON)]
_NAME_TEXT = "".join(f"\u0002{n}\u0001{html5[n]}" for n in _NAMES)
# Names that end without a semicolon, the longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE_TEXT = "".join(f"\u0002{n}\u0001{html5[n]}" for n in _BARE)
# Numbers 128 to 159 are read as Windows-1252 where that has a character.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
_WINDOWS_TEXT = "".join(f"\u0002{n}\u0001{c}" for n, c in _WINDOWS.items())


def unescape(text: Column) -> Column:
    """Character references by number or name, each decoded once; texts without any are left alone."""

    def found(table: str, key: Column) -> Column:
        # a text is a lighter literal than a map, and the common names stand first
        def behind(at: Column) -> Column:
            return F.when(at > 0, F.substring_index(F.substring(F.lit(table), at + F.char_length(key) + 2, F.lit(3)), "\u0002", 1))

        return let(F.instr(F.lit(table), F.concat(F.lit("\u0002"), key, F.lit("\u0001"))), behind)

    def number(ref: Column) -> Column:
        def code(digits: Column) -> Column:
            short = F.char_length(digits) <= 8  # more can't be a character
            hexadecimal = F.startswith(F.lower(ref), F.lit("#x"))
            return F.coalesce(F.when(short & hexadecimal, F.conv(F.concat(F.lit("0"), digits), 16, 10)).when(short, F.concat(F.lit("0"), digits)).try_cast("long"), F.lit(0x110000))

        return let(let(F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*)", 1), code), char)

    def char(code: Column) -> Column:
        silent = code.between(1, 8) | code.between(14, 31) | code.isin(11, 127) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
        return (
            F.when((code > 0x10FFFF) | (code < 0) | code.between(0xD800, 0xDFFF), "\ufffd")
            .when((code == 0) | (code == 13) | code.between(0x80, 0x9F), found(_WINDOWS_TEXT, code.cast("string")))
            .when(silent, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    def decoded(piece: Column) -> Column:
        # every piece but the first starts with what stood behind a reference's ampersand
        def of(ref: Column) -> Column:
            bare = F.regexp_extract(ref, "^(?:" + "|".join(_BARE) + ")", 0)
            known = F.when(F.startswith(ref, F.lit("#")), number(ref)).when(F.endswith(ref, F.lit(";")), found(_NAME_TEXT, ref))
            whole = F.concat(known, F.substr(piece, F.char_length(ref) + 1))
            begun = let(bare, lambda b: F.concat(found(_BARE_TEXT, b), F.substr(piece, F.char_length(b) + 1)))
            return F.coalesce(whole, begun, F.concat(F.lit("&"), piece))

        return let(F.regexp_extract(piece, _REFERENCE, 1), of)

    def joined(pieces: Column) -> Column:
        return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), decoded), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&"), joined)).otherwise(t))


def _unquote(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    """Values of one attribute over all tags of a name, in page order."""
    pattern = rf"(?is)<{tag}(?=[\s/]){_ATTRIBUTES}{attribute}\s*=\s*{_VALUE}"
    return F.transform(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda v: unescape(_unquote(v))
    )


def attribute(tag_text: Column, name: str) -> Column:
    """One attribute of a single opening tag, NULL when absent."""
    pattern = rf"(?is)^<[^\s/>]+{_ATTRIBUTES}{name}\s*=\s*{_VALUE}"
    # The capture holds the quotes, so it is only empty when there is no such attribute.
    return let(F.regexp_extract(tag_text, pattern, 1), lambda v: F.when(v != "", unescape(_unquote(v))))


def anchor_hrefs(html: Column) -> Column:
    """Every ``a/@href`` of the page in order."""
    return attribute_values(markup(html), "a", "href")


def script_sources(html: Column) -> Column:
    """Every ``script/@src`` in order; script bodies are skipped, the tags stay."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->", "")
    return attribute_values(bare, "script", "src")


# --- tokens ------------------------------------------------------------------


def tokens(html: Column) -> Column:
    """array<struct<at, name, piece, text>> of a whole page, cut in one pass; ``text`` has its references decoded.

    ``name`` is the lower-case element name of an opening tag, with a slash for a closing one, ``!``, ``?`` or ``/`` for
    comments and declarations and empty for text. Script and style elements are one token each.
    """

    def token(piece: Column, at: Column) -> Column:
        name = F.when(F.startswith(piece, F.lit("<")), F.lower(F.regexp_extract(piece, r"^<(/?[A-Za-z][^\s/>]*|[!?/])", 1))).otherwise("")
        marked = F.startswith(piece, F.lit("<")) & piece.rlike("^<[A-Za-z/!?]")
        plain = F.when(marked, None).when(F.contains(piece, F.lit("&")), unescape(piece)).otherwise(piece)
        return F.struct((at + 1).alias("at"), name.alias("name"), piece.alias("piece"), plain.alias("text"))

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_PIECE), F.lit(0)), token)


def having(condition: str = "", tag: str = r"[A-Za-z][^\s/>]*") -> str:
    """Pattern of an opening tag with an attribute that fits ``condition``."""
    return rf"<{tag}(?=[\s/>])" + (f"{_ATTRIBUTES}{condition}" if condition else "")


def class_condition(name: str) -> str:
    return rf"""class\s*=\s*(?:"(?:[^"]*\s)?(?:{name})(?:\s[^"]*)?"|'(?:[^']*\s)?(?:{name})(?:\s[^']*)?'|(?:{name})(?=[\s>]))"""


def id_condition(name: str) -> str:
    return attr_condition("id", name)


def attr_condition(name: str, value: str) -> str:
    return rf"""{name}\s*=\s*(?:"{value}"|'{value}'|{value}(?=[\s/>]))"""


def openings(page: Column, tag: str, condition: str = "") -> Column:
    """Tokens of all such opening tags."""
    pattern = "(?is)^" + having(condition, tag)
    return F.filter(page, lambda t: (t["name"] == tag) & t["piece"].rlike(pattern) if condition else t["name"] == tag)


def opening(page: Column, tag: str, condition: str = "") -> Column:
    """First such opening tag, NULL when absent."""
    return F.try_element_at(openings(page, tag, condition), F.lit(1))


def inside(page: Column, start: Column) -> Column:
    """Tokens between an opening tag and the closing tag that matches it, or the page's end; NULL without a tag."""

    def grown(state: Column, t: Column) -> Column:
        closes = F.startswith(t["name"], F.lit("/"))
        step = F.when(closes, -1).when(t["name"] == "p", -state["depth"]).otherwise(1)  # a paragraph holds none
        depth = state["depth"] + step
        ends = state["end"].isNull() & (depth <= 0)
        return F.struct(depth.cast("int").alias("depth"), F.when(ends, t["at"]).otherwise(state["end"]).alias("end"))

    def of(o: Column) -> Column:
        rivals = F.filter(page, lambda t: (t["at"] > o["at"]) & ((t["name"] == o["name"]) | (t["name"] == F.concat(F.lit("/"), o["name"]))))
        none = F.struct(F.lit(1).alias("depth"), F.lit(None).cast("int").alias("end"))
        end = F.coalesce(F.aggregate(rivals, none, grown)["end"], F.element_at(page, -1)["at"] + 1)
        return F.when(o.isNotNull(), F.slice(page, o["at"] - page[0]["at"] + 2, end - o["at"] - 1))

    return let(start, of)


def text(part: Column, joiner: str = "") -> Column:
    """Texts of some tokens, put together with ``joiner`` between two of them and trimmed, NULL when nothing is left."""
    return let(F.regexp_replace(F.array_join(part["text"], joiner), r"^\s+|\s+$", ""), lambda found: F.when(found != "", found))


def text_of(html: Column, joiner: str = "") -> Column:
    """Descendant text of a fragment, trimmed, NULL when nothing is left."""
    return text(tokens(html), joiner)


def element(html: Column, tag: str, condition: str = "") -> Column:
    """Inner HTML of the first such element, NULL when it is empty or the page has none."""
    held = let(tokens(html), lambda page: inside(page, opening(page, tag, condition)))
    return F.nullif(F.array_join(F.transform(held, lambda t: t["piece"]), ""), F.lit(""))


def element_text(html: Column, tag: str, condition: str = "", joiner: str = "") -> Column:
    """Text of the first such element, NULL when it has none."""
    return let(tokens(html), lambda page: text_in(page, tag, condition, joiner))


def text_in(page: Column, tag: str, condition: str = "", joiner: str = "") -> Column:
    """``element_text`` on tokens."""
    return text(inside(page, opening(page, tag, condition)), joiner)


def attribute_in(page: Column, tag: str, name: str, condition: str = "") -> Column:
    """An attribute of the first such opening tag."""
    return attribute(opening(page, tag, condition)["piece"], name)


# --- listing pages ----------------------------------------------------------


def job_links(html: Column) -> Column:
    """Distinct job-posting hrefs of a page, in first-seen order.

    Two passes over the array: the slug words are computed once per link and the test
    then reads them, instead of re-deriving them for each part of the condition.
    """
    marked = F.filter(
        F.array_distinct(anchor_hrefs(html)),
        lambda h: P.contains_any(F.lower(h), M.JOB_LINK_WORDS),
    )
    worded = F.transform(marked, lambda h: F.struct(h.alias("href"), P.slug_words(h).alias("words")))
    return F.transform(F.filter(worded, lambda x: P.is_title_slug(x["words"])), lambda x: x["href"])


def ats_link(html: Column, base_url: Column, hosts: Sequence[str] = M.ATS_HOSTS) -> Column:
    """Link to a known platform host with the fewest slashes, then the shortest, then the first."""
    usable = F.filter(anchor_hrefs(html), lambda h: P.is_navigable(h))
    resolved = F.transform(usable, lambda h: U.resolve(base_url, h))
    on_host = F.filter(
        resolved, lambda u: P.is_web_url(u) & P.contains_any(U.authority(u), hosts)
    )
    ranked = F.transform(
        on_host,
        lambda u, i: F.struct(
            U.slash_count(u).alias("slashes"), F.length(u).alias("len"), i.alias("at"), u.alias("url")
        ),
    )
    return F.array_min(ranked)["url"]


def endpoint_literals(text: Column, base_url: Column) -> Column:
    """Quoted URL literals that look like a listing endpoint, absolute, in order of mention."""
    return absolute_endpoints(raw_endpoint_literals(text), base_url)


def raw_endpoint_literals(text: Column) -> Column:
    """The literals as they stand in the text; no base URL is needed."""
    literals = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_LITERAL), F.lit(1))
    return F.filter(literals, lambda u: P.is_api_like(u))


def absolute_endpoints(literals: Column, base_url: Column) -> Column:
    """Raw literals made absolute, without tracking hosts and static files."""
    absolute = F.transform(
        literals,
        lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u))
        .when(F.startswith(u, F.lit("http")), u)
        .otherwise(U.resolve(base_url, u)),
    )
    return F.filter(
        absolute,
        lambda u: (U.authority(u) != "") & ~P.is_denied(U.authority(u)) & ~P.is_static_asset(u),
    )


def bundle_urls(html: Column, base_url: Column) -> Column:
    """Script sources on the page's own registrable domain, absolute."""
    site = U.registrable_domain(U.host(base_url))
    absolute = F.transform(
        script_sources(html),
        lambda s: F.when(F.startswith(s, F.lit("http")), s).otherwise(U.resolve(base_url, s)),
    )
    return F.filter(
        absolute,
        lambda u: (U.host(u) != "") & ~P.is_denied(U.host(u)) & P.same_site(U.host(u), site),
    )


def clean(html: Column, tags: Sequence[str] = M.STRIPPED_TAGS) -> Column:
    """HTML without the noise tags, whole length."""
    out = F.coalesce(html, F.lit(""))
    for tag in tags:
        if tag in ("link", "meta"):
            out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>", "")
        else:
            out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def sample(text: Column, max_chars: int = 6000) -> Column:
    """The head kept as an evidence sample; the cap is the purpose of a sample."""
    return F.substring(text, 1, max_chars)


def sample_or_note(text: Column, max_chars: int = 8000) -> Column:
    kept = F.when(F.coalesce(text, F.lit("")) != "", sample(text, max_chars))
    return F.coalesce(kept, F.lit("(no sample)"))


def job_link_sample(html: Column, max_items: int = 5, max_chars: int = 6000) -> Column:
    """First matched job anchors in their list item or table cell, else the cleaned page."""
    body = markup(html)
    anchor = rf"<a(?=[\s/]){_ATTRIBUTES}href\s*=\s*{_VALUE}{_REST}.*?</a\s*>"
    context = rf"(?is)(<li(?=[\s>]){_REST}\s*{anchor}\s*</li\s*>|<td(?=[\s>]){_REST}\s*{anchor}\s*</td\s*>|{anchor})"
    snippets = F.regexp_extract_all(body, F.lit(context), F.lit(1))

    def wanted(snippet: Column) -> Column:
        href = unescape(_unquote(F.regexp_extract(snippet, rf"(?is)<a(?=[\s/]){_ATTRIBUTES}href\s*=\s*{_VALUE}", 1)))
        return let(href, lambda h: P.is_job_link(h))

    joined = F.array_join(
        F.slice(F.filter(snippets, wanted), 1, max_items), "\n\n---\n\n"
    )
    return let(joined, lambda found: F.when(found != "", sample(found, max_chars)).otherwise(sample(clean(html), max_chars)))


# --- rendered pagination ----------------------------------------------------


def has_pagination_control(html: Column, texts: Sequence[str] = M.PAGINATION_TEXTS) -> Column:
    """A next link, a pagination container, or a link or button with a paging text."""
    body = markup(html)
    marked = (
        body.rlike(r"""(?is)<a\s[^>]*?\brel\s*=\s*["']next["']""")
        | body.rlike(r"""(?s)<[A-Za-z][^>]*\saria-label\s*=\s*["']Next["']""")
        | body.rlike(r"""(?s)<[A-Za-z][^>]*\sclass\s*=\s*["'][^"'>]*pagination""")
    )
    labels = F.concat(
        F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)),
        F.regexp_extract_all(body, F.lit(r"(?is)<button\b[^>]*>(.*?)</button\s*>"), F.lit(1)),
    )
    # Only text that belongs to the link or button itself, not to a tag within it.
    own = F.transform(
        labels, lambda t: F.lower(unescape(F.regexp_replace(t, r"(?s)<([A-Za-z0-9]+)\b[^>]*>.*?</[A-Za-z0-9]+\s*>", "")))
    )
    return marked | F.exists(own, lambda t: P.contains_any(t, texts))


def revealed_more(interactions: Column) -> Column:
    """An interaction pressed a control that reveals further items."""
    return F.coalesce(
        F.exists(
            interactions,
            lambda a: F.coalesce(
                a["action"].isin(*M.REVEAL_ACTIONS)
                & P.contains_any(F.lower(a["target"]), M.REVEAL_TARGETS),
                F.lit(False),
            ),
        ),
        F.lit(False),
    )


def rendered_pagination(html: Column, interactions: Column) -> Column:
    """struct<status, mechanism> of a listing that only exists once rendered."""
    driven = revealed_more(interactions)
    status = (
        F.when(driven, "confirmed")
        .when(has_pagination_control(html), "unknown")
        .otherwise("not_required")
    )
    return F.struct(
        status.alias("status"), F.when(driven, M.RENDERED_MECHANISM).alias("mechanism")
    )
