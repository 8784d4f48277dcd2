"""Operators over pages and embeddings against plain versions, and on odd rows."""

import base64
import hashlib
import itertools
import random

import numpy as np
import pyarrow.fs
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from crawlspark.llm import html_text, nearest, url_filter, vector_dup, warc
from crawlspark.llm.queries import RULES

PAGES = "page_id long, url string, html string, key string, text string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "t", "r") for i, u, h in rows], PAGES).repartition(3)


ODD_PAGES = [
    (1, "https://a.example.org/es/x?y", "<p>same</p>"), (2, "http://EXAMPLE.org/en/12", "<p>same</p>"), (3, None, None), (4, "no scheme", ""),
    (5, "http://b.com/fr/1", "<p>same</p>"), (5, "http://b.com/fr/1", "<p>same</p>"), (None, "http://c.com/de/", "<p>same</p>"), (7, "http://c.com/de/\nx", "é" * 200_000),
    (8, "http://org", "x"), (9, "http://norg/", "y"), (10, "ftp://x.y.example.org/en/2#f", "\0 <b>z"), (1, "https://a.example.org/es/x?y", "<p>same</p>"),
    (11, "a://b://example.org/es/", "q"), (12, "http://example.org?/es/", "q"),
]


def test_warc_round_trip(spark):
    got = warc.round_trip(pages(spark, ODD_PAGES)).collect()
    first = {}
    for i, _, h in ODD_PAGES:
        data = (h or "").encode()
        if i is not None:
            first[data] = min(i, first.get(data, i))
    want = []
    for i, u, h in ODD_PAGES:
        data = (h or "").encode()
        revisit = i is not None and i != first[data]
        want.append((i, None if revisit else data, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[data] if revisit else None))
    order = lambda r: tuple(map(str, r))
    assert sorted(((r[0], None if r[2] is None else bytes(r[2]), *r[3:]) for r in got), key=order) == sorted(want, key=order)
    assert warc.round_trip(pages(spark, ODD_PAGES).where("false")).count() == 0
    small = warc.round_trip(pages(spark, ODD_PAGES), least_bytes=100).collect()
    assert {r.record_type for r in small} == {"response"}


def test_archive_starts_with_a_dictionary(spark, tmp_path):
    rows = [(k, f"http://x.org/{k}", f"<html><body><p>page {k} has the same frame as others</p></body></html>" * 4) for k in range(300)]
    archives = warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path)).collect()
    assert sum(a.records for a in archives) == 300
    data = pyarrow.fs.LocalFileSystem().open_input_stream(archives[0].path).read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert unpack.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and unpack.unused_data


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
        ("<nav>m</nav><article><h1>T &eacute;</h1><p>one\n two<br>three <b>four</p><p>f&#105;ve</article><footer>&copy; x</footer>", "T é\none two three four\nfive"),
        ("<article><p>text of the article<div class='ad banner'>buy</div><p>more<script>if (a<b) x()</script><form>f<p>g</form></article>", "text of the article\nmore"),
        ("<article><p>body text here</p><section id=comments><p>first!</p></section></article><aside>s</aside>", "body text here"),
        ("<main><p title='a > b'>kept</p><div role=navigation>no</div><!-- c --><p>end &am", "kept\nend &am"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = "long words of running text " * 6
PARAGRAPH = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        ("<div class='layout has-sidebar'><article><p>the body</p></article></div>", ["the body"], []),
        ("<div class='sidebar'><main><p>the body</p></main></div>", ["the body"], []),
        ("<div class='content-with-sidebar'><p>the body</p></div><div class='no-sidebar'><p>more</p></div>", ["the body", "more"], []),
        ("<div class=header><h1>Head</h1></div>" + PARAGRAPH * 3, ["Head", LONG.strip()], []),
        ("<form id=aspnetForm><article>" + PARAGRAPH * 3 + "</article></form>", [LONG.strip()], []),
        ("<form>" + PARAGRAPH * 4 + "</form>", [LONG.strip()], []),
        ("<article><header class='entry-header'><h2>Head</h2></header><div class='article-header'>By X</div>" + PARAGRAPH + "</article>", ["Head", "By X"], []),
        ("<article>" + PARAGRAPH * 3 + "<section class='social-science'><p>S.</p></section><section class='related-work'><p>R.</p></section><p class=navy>N.</p></article>", ["S.", "R.", "N."], []),
        ("<article>" + PARAGRAPH * 3 + "<section class=notice><p>first</p>" + PARAGRAPH * 3 + "</section></article>", ["first"], []),
        ("<article>" + PARAGRAPH * 3 + "<p>one <span class=share>Tweet</span> two</p><form><label>Mail</label></form></article>", ["one two"], ["Tweet", "Mail"]),
        ("<article>" + PARAGRAPH * 3 + "<div class=comments>" + "<div><b>x</b><i>2020</i><p>nice post</p></div>" * 9 + "</div></article>", [], ["nice post", "2020"]),
        ("<div class='site-header'>Site</div><article><p>the body</p></article>", ["the body"], ["Site"]),
    ],
)
def test_names_alone_drop_no_content(html, kept, gone):
    lines = html_text.main_text(html).split("\n")
    assert set(kept) <= set(lines) and not any(word in line for word in gone for line in lines)


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        ("<main><h1>Title</h1><p>lead</p><article>" + PARAGRAPH * 20 + "</article><p>end</p></main>", ["Title", "lead", "end"], []),
        ("<article>" + PARAGRAPH * 20 + "<article><p>section</p></article></article>", ["section"], []),
        ("<article>" + PARAGRAPH * 20 + "</article>" + "".join(f"<article><b>10:0{k}</b><p>Goal {k}</p></article>" for k in range(9)), ["10:00", "Goal 0", "Goal 8"], []),
        ("<article>" + PARAGRAPH * 20 + "</article>" + "<article><a href=/x><h3>Next story</h3></a></article>" * 9, [LONG.strip()], ["Next story"]),
        ("<main><article><h1>T</h1></article></main><div>" + PARAGRAPH * 20 + "</div>", ["T"], []),
    ],
)
def test_regions_stay_whole(html, kept, gone):
    lines = html_text.main_text(html).split("\n")
    assert set(kept) <= set(lines) and not any(word in line for word in gone for line in lines)


TOP = "<article><h1>T</h1>" + PARAGRAPH * 3
READERS = "".join(f"<div class=who><b>Reader {k}</b>" + "<p>a long opinion of a reader " + LONG + "</p></div>" for k in range(5))


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        (TOP + "<div class=comments>" + READERS + "</div></article>", ["T"], ["opinion", "Reader"]),
        (TOP + "</article><section id=post-comments>" + READERS.replace("div", "article") + "</section>", ["T"], ["opinion", "Reader"]),
        (TOP + "</article>" + READERS.replace("div class=who", "article class='comment depth-1'").replace("/div", "/article"), ["T"], ["opinion"]),
        ("<main>" + TOP + "</article><div class=sidebar><article><h3>Side</h3>" + PARAGRAPH * 4 + "</article></div></main>", ["T"], ["Side"]),
        (TOP + "<div class='advert-box'><p>buy it " + LONG + "</p></div><p>after</p></article>", ["T", "after"], ["buy it"]),
        ("<div class='sidebar left'><article><p>only this</p></article></div>", ["only this"], []),
        ("<div class=comments>" + PARAGRAPH * 4 + "</div>", [LONG.strip()], []),
        ("<div class='sidebar-layout'>" + PARAGRAPH * 4 + "</div><div class=sidebar><p>side " + LONG + "</p></div>", [LONG.strip()], ["side "]),
        ("<div class=sidebar><h1>T</h1>" + PARAGRAPH + "</div>" + PARAGRAPH * 3, ["T"], []),
        (TOP + "<p class=comment-count>3 replies</p><section class='commentary'><p>C.</p></section></article>", ["T", "C."], []),
    ],
)
def test_comments_sidebars_and_adverts_go_however_long(html, kept, gone):
    lines = html_text.main_text(html).split("\n")
    assert set(kept) <= set(lines) and not any(word in line for word in gone for line in lines)


def test_clusters_without_an_article():
    body = "".join(f"<p>{'long words of running text ' * 6}{k}</p>" for k in range(6))
    links = "".join(f"<li><a href=/{k}>x{k}</a></li>" for k in range(30))
    got = html_text.main_text(f"<body><div>{body}</div><ul>{links}</ul></body>")
    assert got.count("running text") == 36 and "x29" not in got


def test_extract_keeps_every_page(spark):
    got = html_text.extract(pages(spark, ODD_PAGES)).collect()
    assert len(got) == len(ODD_PAGES) and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 200_000


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, key in RULES:
        h, p = key[: key.index("/")], key[key.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(key), key, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_rules_equal_plain_version(spark):
    rng = random.Random(2)
    rows = [(k, f"{rng.choice(['http', 'x'])}://{rng.choice(['a.', 'b.A.', ''])}{rng.choice(['example.org', 'org', 'com', 'q.com', 'exampleXorg'])}{rng.choice(['', '/', '/es/', '/en/1', '/en/12', '/fr/', '/de/x', '/e'])}{rng.choice(['', '?a=/es/', '#/de/'])}", "") for k in range(300)]
    rows += ODD_PAGES
    rules = url_filter.rules_table(spark, [*RULES, ("block", "org/")])
    rules = rules.where("NOT (key = 'org/' AND verdict = 'block')")
    got = url_filter.judge(pages(spark, rows), rules, blocks=4).collect()  # a full filter lets all pass to the join
    want = [(i, *judged(u)) for i, u, _ in rows]
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=order) == sorted(want, key=order)
    assert url_filter.judge(pages(spark, rows).where("false"), rules).count() == 0


def test_bloom_holds_every_key_and_few_others(spark):
    keys = spark.range(5000).selectExpr("concat('host', id, '/') AS key", "'block' AS verdict")
    table = url_filter.bloom(keys, 1 << 10)
    def passes(names):
        h = np.array([xxhash.xxh64_intdigest(n.encode(), 42) for n in names], np.uint64)
        block, bits = url_filter._bits(h, 1 << 10)
        return ((table[block] & bits) == bits).all(1).mean()

    assert passes([f"host{k}/" for k in range(5000)]) == 1 and passes([f"other{k}/" for k in range(5000)]) < 0.02


VECTORS = "vec_id long, embedding array<float>, label int, h1 string, n string, id string, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "h", "n", "i", "c") for i, v in rows], VECTORS).repartition(3)


def odd_vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 40))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[3] + 0.12 * rng.standard_normal(40)).astype(np.float32).tolist()) for k in range(40)]
    rows += [(200, rows[5][1]), (201, (3 * np.array(rows[5][1])).tolist()), (202, rows[5][1]), (202, rows[5][1])]
    rows += [(300, None), (301, [0.0] * 40), (302, [1.0] * 39 + [None]), (303, [1.0] * 39 + [float("nan")]), (304, [1.0] * 39 + [float("inf")]), (305, [1.0] * 3), (306, []), (None, rows[5][1])]
    rows += [(400, [1e-30] * 40), (401, [1e30] * 40)]
    return rows


def plain(rows):
    usable = {i: np.asarray(v, float) for i, v in rows if i is not None and v is not None and len(v) == 40 and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(usable)
    unit = np.stack([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    return ids, unit @ unit.T


@pytest.mark.parametrize("tile", [16, 4096])
def test_vector_links_equal_brute_force(spark, tile):
    rows = odd_vectors()
    ids, cosine = plain(rows)
    links = {i: {ids[y] for y in np.flatnonzero(cosine[x] >= 0.95)} - {i} for x, i in enumerate(ids)}
    root = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for i, js in links.items():
            root[i] = min([root[i], *(root[j] for j in js)])
    want = sorted((i if i is not None else -1, len(links.get(i, ())), root.get(i, -1), i is None or root[i] == i) for i, _ in rows)
    got = vector_dup.near_duplicates(vectors(spark, rows), tile=tile).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == want


def test_nearest_recall_and_scores(spark):
    rows = odd_vectors()
    ids, cosine = plain(rows)
    got = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0, block=32).collect()
    hits = total = 0
    for q, found in itertools.groupby(sorted(got, key=lambda r: (r.query_id, r["rank"])), key=lambda r: r.query_id):
        found, x = list(found), ids.index(q)
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        for r in found:
            assert r.score == pytest.approx(cosine[x, ids.index(r.vec_id)], abs=1e-12) and r.vec_id != q
        best = sorted((-c, i) for c, i in zip(cosine[x], ids, strict=True) if i != q)[:5]
        hits += sum(r.score >= -best[-1][0] - 1e-12 for r in found)
        total += 5
    assert {r.query_id for r in got} == {i for i in ids if i % 10 == 0} and hits >= 0.9 * total
    few = nearest.nearest(vectors(spark, rows[:3]), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_empty_vector_tables(spark):
    none = vectors(spark, odd_vectors()).where("false")
    assert vector_dup.near_duplicates(none).count() == 0
    assert nearest.nearest(none, F.col("vec_id") == 0).count() == 0
    unusable = vectors(spark, [(1, None), (2, [0.0])])
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dup.near_duplicates(unusable).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
