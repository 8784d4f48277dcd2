import re

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import candidates as C
from crawlspark.operators import evidence as E
from crawlspark.operators import keyed as K
from crawlspark.operators import memory as ME
from crawlspark.plans import evidence_plan
from crawlspark.schema import PATTERN
from crawlspark.sources import readers, sinks

EVIDENCE = (
    "run_id string, attempt int, careers_url string, source_type string, pagination_status string, "
    "pagination_mechanism string, india_filter_mechanism string, reported_total_count long"
)


def attempts(spark, rows):
    return spark.createDataFrame(rows, EVIDENCE)


def test_gate(spark):
    full = ("r", 1, "u", "rest_api", "confirmed", "page number", "query param country=IN", None)
    rows = [full] + [tuple(None if j == i else v for j, v in enumerate(full)) for i in (2, 3, 4, 6)]
    rows += [(*full[:4], "not_required", *full[5:]), (*full[:4], "failed", *full[5:]), (*full[:6], "client_side_fallback", None)]
    got = E.gate(attempts(spark, [(f"r{i}", *r[1:]) for i, r in enumerate(rows)])).orderBy("run_id").collect()
    assert [r.sufficient for r in got] == [True, False, False, False, False, True, False, True]
    assert [r.confidence for r in got] == [0.9, 0.9, 0.9, 0.3, 0.6, 0.9, 0.3, 0.6]


def test_stagnation(spark):
    bad = ("u", "spa_no_api", "unknown", None, "client_side_fallback", None)
    good = ("u", "rest_api", "confirmed", "page number", "x", None)
    rows = [("r", 1, *bad), ("r", 2, *bad), ("r", 3, *good), ("r", 4, *good), ("r", 5, *bad), ("q", 1, *bad)]
    for width in (1, 2, 1000):
        got = {(r.run_id, r.attempt): r.stagnant for r in E.stagnation(attempts(spark, rows), ["run_id"], chunk_width=width).collect()}
        assert got == {("r", 1): False, ("r", 2): True, ("r", 3): False, ("r", 4): False, ("r", 5): False, ("q", 1): False}
    text = E.stagnation(attempts(spark, rows[:1]), ["run_id"]).first().fingerprint
    assert text == "spa_no_api|u|unknown|None|client_side_fallback|None"


def test_budget_and_routes(spark):
    rows = [
        (1, "evidence", False, None, False), (2, "evidence", True, None, False), (3, "validation", None, False, None),
        (4, "repair", None, None, None), (5, "validation", None, True, None), (6, "evidence", False, None, True),
        (7, "evidence", False, None, False), (8, "validation", None, False, None), (9, "repair", None, None, None),
    ]
    df = spark.createDataFrame(
        [("r", *r) for r in rows], "run_id string, step int, kind string, sufficient boolean, passed boolean, stagnant boolean"
    )
    got = E.attempt_budget(df, ["run_id"], [F.col("step")], K.span(F.col("step"), 2), 4)
    out = got.withColumn("route", E.route()).orderBy("step").collect()
    assert [r.attempts_left for r in out] == [3, 3, 3, 2, 2, 1, 0, 0, 0]
    assert [r.route for r in out] == [
        "insufficient", "sufficient", "fail", None, "pass", "budget_exhausted", "budget_exhausted", "budget_exhausted", None,
    ]


@pytest.mark.parametrize(
    "category, action, stage",
    [
        ("syntax_error", "patch", "docker_execute"), ("timeout", "patch", "docker_execute"),
        ("schema_drift", "re-investigate", "investigate"), ("http_forbidden", "re-investigate", "investigate"),
        ("other", "rewrite", "generate_script"), ("unheard_of", "rewrite", "generate_script"), (None, "rewrite", "generate_script"),
    ],
)
def test_repair_routing(value, category, action, stage):
    c = F.lit(category).cast("string")
    assert value(E.repair_action(c), E.next_stage(c)) == (action, stage)


def test_execution_category(value):
    run = lambda t, c, s: value(E.execution_category(F.lit(t), F.lit(c).cast("int"), F.lit(s)))
    assert run(True, 1, "SyntaxError") == "timeout"
    assert run(False, 1, "SyntaxError: x") == "syntax_error"
    assert run(None, 2, "ValueError") == "runtime_error"
    assert run(False, 0, "SyntaxError") is None and run(False, None, None) is None
    assert value(E.execution_detail(F.lit(False), F.lit(1), F.lit("a" * 3000 + "end"))) == "a" * 1997 + "end"


# --- candidates -------------------------------------------------------------


def choose(spark, urls, answers):
    cand = spark.createDataFrame([("d", 0, i, u) for i, u in enumerate(urls)], "domain string, source_no int, seq long, url string")
    ans = spark.createDataFrame(answers, "url string, status int, ats_link string")
    row = C.choose_url(cand, ans, ["domain"]).first()
    return row.careers_url, row.action


def test_choice(spark):
    www, sub = "https://www.d.com/careers", "https://careers.d.com/us/"
    assert choose(spark, [www, sub], [(www, 200, None), (sub, 403, None)]) == (sub, "prefer_strong_careers_url")
    assert choose(spark, [www, sub], [(www, 200, "ats"), (sub, 403, None)]) == ("ats", "follow_ats_link")
    # A good answer of the strong top candidate ends the scan before the link is seen.
    assert choose(spark, [www, sub], [(www, 200, "ats"), (sub, 200, None)]) == (sub, "prefer_strong_careers_url")
    plain = "https://www.d.com/en/careers"
    assert choose(spark, [plain, www], [(plain, 200, None), (www, 500, "no")]) == (plain, "use_probed_candidate")
    assert choose(spark, [plain, www], [("x", 200, None)]) == (www, "use_probed_candidate")


def test_only_the_best_eight_are_looked_at(spark):
    urls = [f"https://www.d.com/{'a' * i}" for i in range(1, 10)]
    answers = [(urls[8], 200, "ats")] + [(u, 404, None) for u in urls[:8]]
    assert choose(spark, urls, answers) == (urls[0], "use_probed_candidate")


# --- memory -----------------------------------------------------------------


def test_signature(value):
    a = value(ME.site_signature(F.lit("Greenhouse"), F.lit("id,title")))
    assert a == value(ME.site_signature(F.lit("Greenhouse"), F.lit("id,title"))) and len(a) == 16
    assert a != value(ME.site_signature(F.lit("Lever"), F.lit("id,title")))
    none = F.lit(None).cast("string")
    assert value(ME.site_signature(none, F.lit("x"))) == value(ME.site_signature(F.lit("unknown"), F.lit("x")))


def pattern(signature, param, at, **kw):
    return (signature, kw.get("source_type"), kw.get("mechanism"), param, kw.get("filter"), kw.get("hint"), at)


CONFIRMED = (
    "signature string, source_type string, pagination_mechanism string, pagination_param string, "
    "india_filter_mechanism string, ats_hint string, confirmed_at double"
)


def test_upsert_lookup_and_store(spark, tmp_path):
    empty = spark.createDataFrame([], PATTERN)
    first = spark.createDataFrame([pattern("s1", "page", 1.0), pattern("s1", "offset", 3.0), pattern("s1", "start", 2.0)], CONFIRMED)
    store = ME.upsert(empty, first)
    row = store.first()
    assert (row.hit_count, row.pagination_param, row.last_seen) == (3, "offset", 3.0)

    sinks.write_patterns(store, str(tmp_path / "v1"))
    with open(tmp_path / "v1" / "broken.json", "w") as f:
        f.write("not valid json{{{\n\n[1]\n")
    loaded = readers.patterns(spark, str(tmp_path / "v1"))
    assert [tuple(r) for r in loaded.collect()] == [tuple(r) for r in store.select(loaded.columns).collect()]

    second = spark.createDataFrame([pattern("s1", None, 9.0), pattern("s2", "p", 9.0)], CONFIRMED)
    merged = {r.signature: r for r in ME.upsert(loaded, second).collect()}
    assert merged["s1"].hit_count == 4 and merged["s1"].pagination_param is None and merged["s2"].hit_count == 1

    sources = spark.createDataFrame([("a", "s1"), ("b", "never-seen"), ("c", None)], "domain string, signature string")
    got = {r.domain: r.hint_param for r in ME.lookup(sources, loaded).collect()}
    assert got == {"a": "offset", "b": None, "c": None}


def test_corrupt_store_reads_as_empty(spark, tmp_path):
    (tmp_path / "p.json").write_text("not valid json{{{")
    assert readers.patterns(spark, str(tmp_path / "p.json")).count() == 0


# --- page to evidence -------------------------------------------------------

LINKS = '<li><a href="https://acme.zohorecruit.in/jobs/Careers/654/Senior-Project-Manager">S</a></li>'


def evidence_of(spark, html, plain="<p>no jobs</p>", interactions=(), captures=(), probes=(), content_type="text/html"):
    pages = spark.createDataFrame(
        [("d", "https://acme.com/careers", 200, html, list(interactions), content_type, "t" * 200, False)],
        "domain string, url string, status int, html string, interactions array<struct<action:string,target:string>>, "
        "content_type string, pdf_text string, from_render_service boolean",
    )
    plain_df = spark.createDataFrame([("d", plain)], "domain string, html string")
    cap = spark.createDataFrame(
        [("d", *c) for c in captures], "domain string, seq int, url string, method string, request_body string, body string"
    )
    prb = spark.createDataFrame(
        [("d", *p) for p in probes], "domain string, kind string, trial string, status int, body string"
    )
    return evidence_plan.build(pages, plain_df, cap, prb, spark.createDataFrame([], PATTERN)).first()


def test_links_only_after_rendering(spark):
    e = evidence_of(spark, LINKS)
    assert (e.source_type, e.pagination_status, e.requires_browser, e.sufficient) == ("spa_rendered", "not_required", True, True)
    e = evidence_of(spark, LINKS + "<button>Load more</button>")
    assert (e.pagination_status, e.sufficient) == ("unknown", False)
    e = evidence_of(spark, LINKS + "<button>Load more</button>", interactions=[("click", "load more")])
    assert (e.pagination_status, e.sufficient) == ("confirmed", True)


def test_links_that_survive_a_plain_fetch(spark):
    e = evidence_of(spark, LINKS, plain=LINKS, probes=[("html", "page", 200, LINKS)])
    assert (e.source_type, e.pagination_status, e.requires_browser) == ("ssr_html", "not_required", False)


def test_longest_list_wins_and_tracking_hosts_do_not_count(spark):
    many = '{"jobs":[{"id":1},{"id":2},{"id":3}]}'
    two = '{"jobs":[{"id":1,"title":"a"},{"id":2,"title":"b"}]}'
    moved = '{"jobs":[{"id":3,"title":"c"}]}'
    caps = [
        (1, "https://cdn.cookielaw.org/en.json", "GET", None, many), (2, "https://x.com/api", "GET", None, '{"n":[{"title":"one"}]}'),
        (3, "https://x.com/search", "POST", '{"offset":0,"limit":2}', two), (4, "https://x.com/late", "GET", None, two),
    ]
    e = evidence_of(spark, LINKS, captures=caps, probes=[("api", "next", 200, moved), ("api", "country=IN", 200, two)])
    assert (e.source_type, e.pagination_mechanism, e.pagination_param) == ("rest_api", "offset/limit", "body")
    assert e.india_filter_mechanism == "client_side_fallback"


def test_graphql_cursor(spark):
    body = '{"data":{"jobs":{"edges":[{"node":{"id":"1"}}],"pageInfo":{"endCursor":"c"}}}}'
    caps = [(1, "https://x.com/graphql", "POST", '{"query":"q","variables":{"first":1,"after":null}}', body)]
    e = evidence_of(spark, "", captures=caps, probes=[("api", "next", 200, '{"data":[{"id":"2"}]}')])
    assert (e.source_type, e.pagination_mechanism, e.pagination_param) == ("graphql", "cursor", "variables")


def test_nothing_found_and_pdf(spark):
    e = evidence_of(spark, "<p>x</p>")
    assert (e.source_type, e.pagination_status, e.india_filter_mechanism) == ("spa_no_api", "unknown", "client_side_fallback")
    e = evidence_of(spark, "", content_type="Application/PDF")
    assert (e.source_type, e.pagination_mechanism, e.sufficient) == ("ssr_html", "single_page", True)


def test_endpoints_named_in_scripts(spark):
    jobs = '{"jobs":[{"id":1,"title":"a"},{"id":2,"title":"b"}]}'
    script = '<script>get("/v2/jobs"); get("/v2/jobs?search=1")</script>'
    one, two = "https://acme.com/v2/jobs", "https://acme.com/v2/jobs?search=1"
    e = evidence_of(spark, script, probes=[("endpoint", one, 200, jobs), ("endpoint", two, 200, '{"x":1}')])
    assert (e.source_type, e.signature is not None) == ("rest_api", True)
    e = evidence_of(spark, script, probes=[("endpoint", one, 500, jobs), ("endpoint", "https://acme.com/other", 200, jobs)])
    assert e.source_type == "spa_no_api"

    bundle = '<script src="/app.js"></script>'
    text = ("bundle", "https://acme.com/app.js", 200, "let u = '/v2/jobs'")
    assert evidence_of(spark, bundle, probes=[text, ("endpoint", one, 200, jobs)]).source_type == "rest_api"
    # a captured list comes first, however short
    captures = [(1, "https://x.com/api", "POST", "{}", '{"n":[{"title":"one"}]}')]
    e = evidence_of(spark, bundle, captures=captures, probes=[text, ("endpoint", one, 200, jobs)])
    assert (e.source_type, e.signature) == ("rest_api", None)


def test_pdf_has_no_signature(spark):
    assert evidence_of(spark, LINKS, plain=LINKS, content_type="application/pdf").signature is None
    assert evidence_of(spark, LINKS, plain=LINKS).signature is not None


HOP = "domain string, careers_url string, source_type string, sufficient boolean, ats_hint string"


def test_platform_hops_null_repeated_and_unstored_pages(spark):
    to = lambda url: f'<a href="{url}">jobs</a>'
    board = "https://boards.greenhouse.io/acorn"
    evidence = spark.createDataFrame([
        ("moves", "https://m.test", "spa_no_api", False, None),
        ("unknown", "https://u.test", None, None, None),
        ("done", "https://d.test", "ssr_html", True, None),
        ("away", "https://a.test", "spa_no_api", False, None),
        ("hosted", "https://jobs.lever.co/oak", "spa_no_api", False, None),
        ("no_url", None, None, False, None),
        ("loop", "https://l.test", None, False, None),
        ("b1", board, "spa_no_api", False, None),
        ("b2", board, "rest_api", True, None),
        ("l1", board + "/loop", None, False, None),
    ], HOP)
    pages = spark.createDataFrame([
        ("moves", "https://m.test", to(board)), ("unknown", "https://u.test", to(board)),
        ("done", "https://d.test", to(board)), ("away", "https://a.test", to("https://boards.greenhouse.io/none")),
        ("hosted", "https://jobs.lever.co/oak", to("https://www.lever.co/")), ("no_url", None, to(board)),
        ("loop", "https://l.test", to(board + "/loop")), ("l1", board + "/loop", to(board + "/loop")),
        ("b1", board, None), ("b2", board, ""),
    ], "domain string, url string, html string")
    out = {r.domain: r for r in evidence_plan.platform_hops(evidence, pages).collect()}
    assert len(out) == 10
    state = lambda d: (out[d].careers_url, out[d].source_type, out[d].sufficient, out[d].platform_hops)
    assert state("moves") == state("unknown") == (board, "rest_api", True, 1)
    assert state("done") == ("https://d.test", "ssr_html", True, 0)
    assert state("away") == ("https://boards.greenhouse.io/none", "spa_no_api", False, 1)
    assert state("hosted") == ("https://jobs.lever.co/oak", "spa_no_api", False, 0)
    assert state("no_url") == (None, None, False, 0)
    assert state("loop") == (board + "/loop", None, False, 1)
    assert state("b1") == (board, "spa_no_api", False, 0)
    assert out["moves"].ats_hint and not out["done"].ats_hint
    assert evidence_plan.platform_hops(evidence.limit(0), pages.limit(0)).count() == 0


def test_bodies_end_at_the_scan(spark, capsys):
    """After the facts no shuffle carries HTML, PDF text or bodies, and pages, captures and probes are not read again."""
    pages = spark.createDataFrame(
        [("d", "https://shop.example/careers", 200, LINKS, [], "text/html", "t", False)],
        "domain string, url string, status int, html string, interactions array<struct<action:string,target:string>>, "
        "content_type string, pdf_text string, from_render_service boolean",
    )
    plain = spark.createDataFrame([("d", LINKS)], "domain string, html string")
    cap = spark.createDataFrame([], "domain string, seq int, url string, method string, request_body string, body string")
    prb = spark.createDataFrame([], "domain string, kind string, trial string, status int, body string")
    evidence_plan.build(pages, plain, cap, prb, spark.createDataFrame([], PATTERN)).explain("formatted")
    sections = capsys.readouterr().out.split("\n\n")
    inputs = {True: [], False: []}
    for section in sections:
        head, _, rest = section.strip().partition("\n")
        inputs["Exchange" in head].append((head, rest))
    assert inputs[True]
    for _, rest in inputs[True]:
        assert not re.search(r"\b(html|body|pdf_text|request_body|response_json|json_body|items)#", rest), rest
    read = [rest for head, rest in inputs[False] if "Scan" in head]
    assert read and not any(re.search(r"\b(body|pdf_text|interactions)#", rest) for rest in read)


def test_facts_of_payloads(spark):
    """Equal items in another order and spelling give equal sets; tracking hosts, forms and broken bodies give none."""
    rows = [
        ("d", 1, "https://x.example/api", "get", None, '{"jobs":[{"id":1,"title":"a"},{"title":"b","id":2}]}'),
        ("d", 2, "https://x.example/api", "GET", "a=1", '[{"title":"b","id":2},{"title":"a","id":1},{"id":1,"title":"a"}]'),
        ("d", 3, "https://www.hotjar.com/api", "GET", None, '[{"id":1,"title":"a"}]'),
        ("d", 4, "https://x.example/api", "POST", '{"offset":0,"limit":2}', '[{"id":1,"title":"a"}]'),
        (None, 5, None, None, None, None), ("d", 6, "https://x.example/api", "POST", "{", "[{"),
    ]
    cap = spark.createDataFrame(rows, "domain string, seq int, url string, method string, request_body string, body string")
    got = {r.seq: r for r in evidence_plan.capture_facts(cap).collect()}
    assert [got[s].n_items for s in range(1, 7)] == [2, 3, 0, 1, 0, 0]
    assert set(map(bytes, got[1].hashes)) == set(map(bytes, got[2].hashes)) and len(got[2].hashes) == 2
    assert all(len(h) == 16 for h in got[1].hashes) and got[1].shape == "id,title"
    assert (got[4].moved, got[1].moved, got[6].moved) == ("offset/limit", None, None)
    assert [bool(got[s].has_json_body) for s in (2, 4, 6)] == [False, True, False]
