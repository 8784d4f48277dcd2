"""Main text of HTML pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clusters.

The standard library's parser streams events. A line is the text of one block, white space as one
space; its ratio is its characters over the tags met in it. Ratios are smoothed along the page, and
lines above a threshold (a share of their standard deviation) form clusters. The cluster regions are
the outermost article and main elements, whole, or the body if there are none. Ratios alone would lose headlines and short last paragraphs and take long footers, so
elements that are never content (menus, headers, footers, scripts) are left out by name, and within an
article element every other line stays. Forms, and blocks whose class or id says
advert, notice, sidebar, comments, are only candidates: one that holds an article, a main, an h1 or a
cluster of its own stays; those that say comments, sidebar or advert go also with clusters and articles, unless the page
has no other. A region goes only if it has no cluster of its own and is mostly links or
stands in a candidate.
"""

import functools
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SMOOTHING = 2.0  # standard deviation in lines
THRESHOLD = 0.5  # in standard deviations of the smoothed ratios

_SKIPPED = frozenset("nav header footer aside script style noscript template iframe object svg math select button textarea head title dialog menu canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_REGIONS = ("article", "main")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOISE = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|side-?bar|menu|"
    r"nav(?:s|bar|igation|menu|list|links?|items?)?|breadcrumbs?|footer|comments?|respond|replies|disqus|share|sharing|"
    r"social(?=$|[_-](?:share|sharing|links?|icons?|media|buttons?|bar|networks?|follow|feed|list))|"
    r"related(?=$|[_-](?:posts?|articles?|stories|content|links?|news|items?|topics?|reading|products?|videos?|list))|"
    r"recommend\w*|widget|pagination|pager|login|signup)(?:$|[_-])",
    re.I,
)
# Of these, blocks that go however long their texts are, and names of frames around a page that only mention one.
_AROUND = re.compile(r"(?:^|[_-])(?:comments?|respond|replies|disqus|side-?bar|ads?|advert\w*|sponsor\w*|promo\w*)(?:$|[_-])", re.I)
_FRAME = re.compile(r"(?:^|[_-])(?:layout|wrap|wrapper|container|grid|row|page|site|content|main|free|enabled|disabled|open|closed|count|off|on)(?:$|[_-])", re.I)
_HEADER = re.compile(r"(?:^|[_-])(?:header|masthead)(?:$|[_-])", re.I)
_ABOUT = re.compile(r"(?:^|[_-])(?:has|with|without|no)$|(?:^|[_-])(?:has|with|without|no)[_-]", re.I)  # the name says what is beside or absent
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_SPACE = re.compile(r"\s+")


@functools.lru_cache(4096)
def _noise(names: str, headers: bool) -> bool:
    """Whether a class or id names something that is seldom content; ``headers`` as well, outside regions."""
    for name in names.split():
        for pattern in (_NOISE, _HEADER)[: 1 + headers]:
            if (found := pattern.search(name)) and not _ABOUT.search(name[: found.start()]):
                return True
    return False


@functools.lru_cache(4096)
def _beside(names: str) -> bool:
    """Whether a class or id names reader comments, a sidebar or an advert, and not a frame or what is absent."""
    for name in names.split():
        if (found := _AROUND.search(name)) and not _FRAME.search(name) and not _ABOUT.search(name[: found.start()]):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of a page: (parts, tags, region) with region the outermost article or main element, 0 for none.

    A part is (text, candidate, linked) with candidate the innermost element around it that may be no content, 0 for none.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, left out, region, candidate
        self.outer = [0]  # of each candidate, the candidate around it
        self.stays = [True]  # it holds an article, a main or an h1
        self.beside = [False]  # it is named reader comments, sidebar or advert, or stands in one that is
        self.articles = [False]  # such a one holds an article
        self.alone = True  # no article or main stands outside of these
        self.named = [False]  # of each region, whether it stands in a candidate
        self.left_out = self.linked = self.tags = 0
        self.held: list[tuple[str, int, bool]] = []

    @property
    def region(self) -> int:
        return self.open[-1][2] if self.open else 0

    @property
    def candidate(self) -> int:
        return self.open[-1][3] if self.open else 0

    def end_line(self) -> None:
        if any(not text.isspace() for text, *_ in self.held):
            self.lines.append((self.held, self.tags, self.region))
        self.held, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS or tag in _SKIPPED:
            self.end_line()
        if tag in _CLOSES_P:
            self.close_p()
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.held.append((" ", self.candidate, self.linked > 0))
            return
        named = dict(attrs)
        role = (named.get("role") or "").lower()
        out = tag in _SKIPPED and not (tag == "header" and self.region and not self.left_out) or "hidden" in named or role in _ROLES
        region, candidate = self.region, self.candidate
        if not self.left_out and not out:
            names = f"{named.get('class') or ''} {(tag not in _HEADINGS and named.get('id')) or ''}"  # a heading's id is its words
            beside = tag not in ("html", "body", "main") and _beside(names)
            if tag == "form" or role == "form" or beside or tag not in ("html", "body", *_REGIONS) and _noise(names, not region):
                self.outer.append(candidate)
                self.stays.append(False)
                self.beside.append(beside or self.beside[candidate])
                self.articles.append(False)
                candidate = len(self.outer) - 1
            if tag in _REGIONS:
                self.alone &= self.beside[candidate]
            if tag == "h1" or tag in _REGIONS:
                around = candidate
                while not self.stays[around]:
                    if tag == "article" and self.beside[around]:
                        self.articles[around] = True
                    else:
                        self.stays[around] = True
                    around = self.outer[around]
        if tag in _REGIONS and not region and not self.left_out:
            self.named.append(candidate > 0)
            region = len(self.named) - 1
        self.open.append((tag, out, region, candidate))
        self.left_out += out
        self.linked += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def close_p(self) -> None:
        """A block start ends an open paragraph, and inline elements left open in it."""
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag == "p":
                return self.drop_from(k)
            if tag in _BLOCKS or tag in _SKIPPED:
                return None
        return None

    def drop_from(self, k: int) -> None:
        self.left_out -= sum(x[1] for x in self.open[k:])
        self.linked -= sum(x[0] == "a" for x in self.open[k:])
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS or tag in _SKIPPED:
            self.end_line()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                return self.drop_from(k)
        return None

    def handle_data(self, data: str) -> None:
        if not self.left_out:
            self.held.append((data, self.candidate, self.linked > 0))


def _smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average along the lines; the weights of lines beyond the ends go to those there are."""
    reach = min(len(ratios) - 1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]


def _without_noise(parser: _Lines, sigma: float) -> list[tuple[str, int, int, int]]:
    """(text, tags, region, length of link texts) of the lines, without candidates that hold no article, main, h1 or cluster.

    Candidates named reader comments, sidebar or advert go whatever cluster or article they hold, but
    for those with articles on pages without any other article or main, and on pages of nothing else.
    """
    for k, holds in enumerate(parser.articles):
        if holds and parser.alone:
            while not parser.stays[k]:
                parser.stays[k] = True
                k = parser.outer[k]
    lines = _kept_lines(parser, sigma, parser.beside)
    return lines if lines or not any(parser.beside) else _kept_lines(parser, sigma, [False] * len(parser.beside))


def _kept_lines(parser: _Lines, sigma: float, beside: list[bool]) -> list[tuple[str, int, int, int]]:
    """Lines without candidates that are ``beside`` the content or have no cluster.

    A candidate's cluster is judged by its own text: ratios of its lines, all other lines as zero,
    smoothed, reach half the page's mean ratio somewhere.
    """
    stays, outer = list(parser.stays), parser.outer
    if not all(stays):
        sizes = [[len(_SPACE.sub(" ", text).strip()) for text, *_ in parts] for parts, _, _ in parser.lines]
        tags = np.array([max(1, tags) for _, tags, _ in parser.lines])
        least = (np.array([sum(n) for n in sizes]) / tags).mean() / 2 if sizes else 0.0
        own: dict[int, dict[int, int]] = {}
        for k, (parts, _, _) in enumerate(parser.lines):
            for (_, candidate, _), n in zip(parts, sizes[k], strict=True):
                while candidate:
                    if not stays[candidate]:
                        held = own.setdefault(candidate, {})
                        held[k] = held.get(k, 0) + n
                    candidate = outer[candidate]
        reach = math.ceil(3 * sigma)
        for candidate, held in own.items():
            first, last = max(0, min(held) - reach), min(len(tags), max(held) + reach + 1)
            ratios = np.zeros(last - first)
            for k, n in held.items():
                ratios[k - first] = n / tags[k]
            stays[candidate] = not beside[candidate] and bool(_smoothed(ratios, sigma).max() >= least)
    gone = [False] * len(stays)
    for candidate in range(1, len(stays)):
        gone[candidate] = not stays[candidate] or gone[outer[candidate]]
    lines = []
    for parts, tags, region in parser.lines:
        kept = [(text, linked) for text, candidate, linked in parts if not gone[candidate]]
        text = _SPACE.sub(" ", "".join(text for text, _ in kept)).strip()
        if text:
            lines.append((text, tags, region, sum(len(text.strip()) for text, linked in kept if linked)))
    return lines


def main_text(html: str | None, sigma: float = SMOOTHING, threshold: float = THRESHOLD) -> str:
    """Content lines joined by line feeds; empty if there are none."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    lines = _without_noise(parser, sigma)
    if not lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, *_ in lines])
    smooth = _smoothed(ratios, sigma)
    least = threshold * smooth.std()
    places: dict[int, list[int]] = {}
    for k, (_, _, region, _) in enumerate(lines):
        if region:
            places.setdefault(region, []).append(k)
    if not places:
        return "\n".join(line[0] for line, inside in zip(lines, smooth >= least, strict=True) if inside)
    kept = set(places)
    if len(places) > 1:
        kept = {r for r, at in places.items() if _smoothed(ratios[at], sigma).max() >= least or not (parser.named[r] or _mostly_links([lines[k] for k in at]))} or kept
    return "\n".join(text for text, _, region, _ in lines if region in kept)


def _mostly_links(lines: list[tuple[str, int, int, int]]) -> bool:
    return 2 * sum(linked for *_, linked in lines) > sum(len(text) for text, *_ in lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars (code points) of every page.

    Defined results: null or empty html, and pages without content, give an empty text; markup left
    open ends with the page; rows that repeat are extracted each. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
