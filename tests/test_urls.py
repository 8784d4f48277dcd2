from urllib.parse import parse_qs, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from crawlspark.functions import urls as U

L = F.lit


@pytest.mark.parametrize("base", ["https://a.com/x/y?q=1#f", "http://b.org", "https://c.net/d/e/"])
def test_resolve_agrees_with_urljoin(spark, base):
    refs = [
        "c", "/c", "../c", "./c/", "?z=2", "#g", "//b.com/k", "http://o/p", "", "a//b", "../../../z", "..", ".",
        "c/./d/../e?q#f", "https://b/../c", "mailto:x", "/a/../b/", "/a//b",
    ]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    got = {r.ref: r.u for r in df.select("ref", U.resolve(L(base), F.col("ref")).alias("u")).collect()}
    assert got == {r: urljoin(base, r) for r in refs}


def test_parts_survive_blanks_and_templates(value):
    u = L("https://Host.com:8080/jobs/{{id}}/a b;p=1?x={{y}}#z")
    assert value(U.authority(u), U.host(u), U.path(u), U.query(u), U.fragment(u)) == (
        "Host.com:8080", "host.com:8080", "/jobs/{{id}}/a b", "x={{y}}", "z",
    )
    assert value(U.path(L("/rel/path?x")), U.authority(L("/rel/path"))) == ("/rel/path", "")
    assert value(U.registrable_domain(L("a.b.example.org"))) == "example.org"


def test_query_params_like_parse_qs(value):
    for u in ["https://a.com/p?x=1&y=2&x=3&b=&c&d=a%20b+c%zz#t", "https://a.com/p", "/q?page=9&=v"]:
        assert value(U.query_params(L(u))) == parse_qs(urlparse(u).query)


def test_with_params_replaces_in_place_and_drops_blanks(value):
    got = value(U.with_params(L("https://a.com/p?x=1&y=2&x=3&b=&c=4#t"), {"x": 9, "n": "é ~*"}))
    assert got == "https://a.com/p?x=9&y=2&c=4&n=%C3%A9+~%2A#t"
    assert value(U.append_param(L("https://a/b?c=1"), "page", L(2))) == "https://a/b?c=1&page=2"


def test_shape_ignores_names_and_keeps_depth(value):
    one = "https://job-boards.greenhouse.io/first-company/jobs/4708904005"
    two = "https://job-boards.greenhouse.io/second/jobs/9988001"
    assert value(U.shape(L(one))) == value(U.shape(L(two))) == "S/S/N"
    assert value(U.shape(L("https://x.org/"))) == ""


def test_ids(value):
    assert value(U.id_after(L("https://c.com/us-en/jobs/000123/x"))) == "000123"
    assert value(U.id_after(L("https://c.com/us-en/jobs"))) is None
    assert value(U.id_last_after(L("https://g.io/acme/jobs/4708/"))) == "4708"
    assert value(U.id_last_after(L("https://g.io/acme/roles/4708"))) is None
    assert value(U.id_first_number(L("https://z.in/jobs/Careers/6544/Lead/77"))) == "6544"
    assert value(U.id_before_dash(L("https://s.com/Acme/744000136-lead-role/"))) == "744000136"
    assert value(U.id_last_dash_part(L("https://d.com/i/global-careers-spanish?location=USA"))) == "spanish"
    assert value(U.id_last_dash_part(L("https://d.com/i/global-careers"))) is None


def test_candidate_urls_in_order(value):
    got = value(U.candidate_urls(L("acme.com")))
    assert got[0] == "https://acme.com/careers" and got[-1] == "https://acme.com/careers/jobs" and len(got) == 8
