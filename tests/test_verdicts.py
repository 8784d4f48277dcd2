from pyspark.sql import functions as F

from crawlspark.operators import verdicts as V

SCHEMA = "source_id string, trial string, responded boolean, item string"


def probes(spark, **sources):
    """source -> trial -> items; None is a failed probe, [] an empty answer."""
    data = []
    for source, trials in sources.items():
        for trial, items in trials.items():
            if items is None:
                data.append((source, trial, False, None))
            for item in items or ([None] if items is not None else []):
                data.append((source, trial, True, item))
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def verdicts(df, column="pagination"):
    return {r.source_id: r[column] for r in df.collect()}


def test_query_pagination(spark):
    p = probes(
        spark,
        page={"base": ["a", "b"], "page": ["c"], "offset": ["d"]},
        same={"base": ["a", "b"], "page": ["b", "a", "a"], "offset": ["a", "b"], "start": []},
        subset={"base": ["a", "b"], "page": ["a"]},
        superset={"base": ["a"], "page": ["a"], "offset": ["a", "z"]},
        none={"base": ["a"], "page": None},
        nobase={"base": [], "page": ["a"]},
    )
    facts = V.trial_facts(p, ["source_id"], list(V.QUERY_TRIALS))
    got = verdicts(V.query_pagination(facts))
    assert got["page"].param == "page" and got["page"].mechanism == "page number"
    assert not got["same"].confirmed
    assert got["subset"].param == "page"
    assert got["superset"].param == "offset" and got["superset"].mechanism == "offset/limit"
    assert not got["none"].confirmed and not got["nobase"].confirmed
    hinted = verdicts(V.query_pagination(facts, F.lit("offset")))
    assert hinted["page"].param == "offset"


def test_html_pagination(spark):
    p = probes(
        spark,
        moved={"base": ["a"], "page": ["b"]},
        single={"base": ["a"], "page": ["a"], "p": []},
        ignored={"base": ["a", "b"], "page": ["b", "a"], "p": ["a", "b"], "pg": ["a", "b"]},
        silent={"base": ["a"], "page": None, "p": None},
        late={"base": ["a"], "page": None, "pg": ["c"]},
    )
    got = verdicts(V.html_pagination(V.trial_facts(p, ["source_id"], list(V.HTML_TRIALS))))
    assert tuple(got["moved"]) == (True, "page number", "page")
    assert tuple(got["single"]) == tuple(got["ignored"]) == (True, "single_page", None)
    assert tuple(got["silent"]) == (False, None, None)
    assert tuple(got["late"]) == (True, "page number", "pg")


def test_body_pagination(spark):
    p = probes(
        spark,
        moved={"base": ["a"], "next": ["b"]},
        ended={"base": ["a"], "next": []},
        same={"base": ["a"], "next": ["a"]},
        failed={"base": ["a"], "next": None},
    )
    facts = V.trial_facts(p, ["source_id"], [V.NEXT_PAGE])
    got = verdicts(V.body_pagination(facts, F.lit("cursor"), F.lit("variables")))
    assert tuple(got["moved"]) == (True, "cursor", "variables")
    assert tuple(got["ended"]) == (True, "single_page", None)
    assert not got["same"].confirmed and not got["failed"].confirmed
    unknown = verdicts(V.body_pagination(facts, F.lit(None).cast("string"), F.lit("body")))
    assert not any(v.confirmed for v in unknown.values())


def test_filters(spark):
    p = probes(
        spark,
        a={"base": ["a", "b"], "country=IN": ["a", "b"], "location=India": ["a"]},
        b={"base": ["a"], "country=IN": [], "location=India": None, "country=India": ["a"]},
        c={"base": [], "country=IN": ["q"]},
    )
    facts = V.trial_facts(p, ["source_id"], V.filter_trials())
    assert verdicts(V.query_filter(facts), "filter") == {
        "a": "query param country=IN", "b": "query param country=India", "c": "query param country=IN",
    }
    assert verdicts(V.query_filter(facts, require_diff=True), "filter")["a"] == "query param location=India"
    assert verdicts(V.html_filter(facts), "filter") == {"a": "query param location=India", "b": None, "c": None}
    assert verdicts(V.body_filter(facts), "filter") == {
        "a": "body param location=India", "b": None, "c": "body param country=IN",
    }


def test_a_set_never_differs_from_itself(spark):
    items = [f"i{n % 37}" for n in range(500)]
    p = probes(spark, s={"base": items, "page": items[::-1], "offset": items[:37], "start": items + items})
    facts = V.trial_facts(p, ["source_id"], list(V.QUERY_TRIALS)).collect()[0]
    assert facts.n_base == 37 and [t.different for t in facts.trials] == [False] * 3


def test_pagination_status(spark):
    v = spark.createDataFrame(
        [(1, (True, "single_page")), (2, (True, "page number")), (3, (False, None)), (4, None)],
        "i int, v struct<confirmed:boolean,mechanism:string>",
    )
    got = [r[0] for r in v.orderBy("i").select(V.pagination_status(F.col("v"))).collect()]
    assert got == ["not_required", "confirmed", "unknown", "unknown"]


def test_link_survival_and_difference(spark):
    rendered = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("e", "x")], "domain string, href string")
    plain = spark.createDataFrame([("d", "b"), ("d", "c")], "domain string, href string")
    got = {r.domain: r for r in V.link_survival(rendered, plain, ["domain"]).collect()}
    assert (got["d"].n_rendered, got["d"].n_plain, got["d"].n_common, got["d"].survives) == (2, 2, 1, True)
    assert got["e"].survives is False
    diff = {r.domain: r for r in V.set_difference(rendered, plain, ["domain"], "href").collect()}
    assert (diff["d"].only_left, diff["d"].only_right, diff["d"].common, diff["d"].equal) == (1, 1, 1, False)


def walk(spark, pages):
    data = [("s", n, i) for n, items in pages.items() for i in (items or [None])]
    return spark.createDataFrame(data, "source_id string, page_no int, item string")


def kept(df):
    return sorted((r.page_no, r.item) for r in df.collect())


def test_walk_until_short(spark):
    pages = walk(spark, {1: ["a", "b"], 2: ["c"], 3: ["d", "e"]})
    assert kept(V.walk_until_short(pages, ["source_id"], "page_no", "item", 2)) == [(1, "a"), (1, "b"), (2, "c")]
    empty = walk(spark, {1: ["a"], 2: [], 3: ["z"]})
    assert kept(V.walk_until_short(empty, ["source_id"], "page_no", "item")) == [(1, "a")]
    full = walk(spark, {1: ["a"], 2: ["b"]})
    assert kept(V.walk_until_short(full, ["source_id"], "page_no", "item")) == [(1, "a"), (2, "b")]


def test_walk_until_known(spark):
    pages = walk(spark, {1: ["a", "a", "b"], 2: ["b", "c"], 3: ["a", "c"], 4: ["new"]})
    assert kept(V.walk_until_known(pages, ["source_id"], "page_no", "item")) == [(1, "a"), (1, "a"), (1, "b"), (2, "c")]
    assert kept(V.walk_until_known(pages, ["source_id"], "page_no", "item", 1)) == [(1, "a"), (1, "a"), (1, "b")]
