import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlspark.functions import fields as FD
from crawlspark.functions import postings as PO
from crawlspark.operators import normalize as N
from crawlspark.plans import inputs as I
from crawlspark.plans.registry import QUERIES
import crawlspark.plans.queries  # noqa: F401  (fills the registry)

L = F.lit


def test_dates(value):
    run = lambda t: value(FD.iso_date(L(t)))
    assert run("2024-01-05") == "2024-01-05T00:00:00"
    assert run("2024-01-05T10:11Z") == "2024-01-05T10:11:00+00:00"
    assert run("2024-01-05 10:11:12.5+0530") == "2024-01-05T10:11:12.500000+05:30"
    assert run("January 5, 2024") == run("Posted on 5 Jan 2024") == run("1/5/2024") == "2024-01-05T00:00:00"
    for text in ["Posted 3 Days Ago", "Posted Today", "2024-13-45", "Foo 5, 2024", ""]:
        assert run(text) is None, text


def test_locations(value):
    by_count = lambda t: tuple(value(FD.location_by_count(L(t))))
    assert by_count("a, b, c") == ("a", "b", "c")
    assert by_count("a,c") == ("a", None, "c")
    assert by_count("c") == (None, None, "c")
    assert by_count("a,b,c,d") == by_count("") == (None, None, None)
    assert tuple(value(FD.location_by_position(L("a , b")))) == ("a", "b", None)
    assert tuple(value(FD.location_first_word(L("Mumbai Remote, x")))) == ("Mumbai", None, "India")
    assert tuple(value(FD.location_first_word(L("mumbai")))) == ("mumbai", None, None)
    assert tuple(value(FD.location_first_word(L("")))) == (None, None, None)


def test_location_with_default(spark):
    keys = N.country_keys(spark.createDataFrame([("India", "IN"), ("Germany", "DE")], "name string, code string"))
    texts = ["Bengaluru, India", "germany", "DE", "Pune", "Pune,", "Ulm, Nowhere", "", "a, b, c"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = {r.raw: (r.city, r.country, r.country_code) for r in N.located_with_default(df, "raw", keys).collect()}
    assert got == {
        "Bengaluru, India": ("Bengaluru", "India", "IN"), "germany": (None, "Germany", "DE"), "DE": (None, "Germany", "DE"),
        "Pune": ("Pune", "India", "IN"), "Pune,": ("Pune", "India", "IN"), "Ulm, Nowhere": ("Ulm", "Nowhere", None),
        "": (None, None, None), "a, b, c": ("a", "b, c", None),
    }


def records(spark, text, column):
    return [r.asDict() for r in spark.createDataFrame([(text,)], "t string").select(F.inline(column)).collect()]


def test_workday(spark):
    payload = {"total": 2, "jobPostings": [
        {"title": "A", "externalPath": "/job/1", "bulletFields": ["R1", "x"], "locationsText": "Pune", "postedOn": "Posted 3 Days Ago"},
        {"title": "B"},
    ]}
    one, two = records(spark, json.dumps(payload), PO.workday(F.col("t"), L("https://w.com")))
    assert (one["job_id"], one["url"], one["city"], one["country_code"], one["date_posted"], one["date_posted_text"]) == (
        "R1", "https://w.com/job/1", "Pune", "IN", None, "Posted 3 Days Ago")
    assert two["title"] == "B" and two["url"] is None and two["job_id"] is None and two["date_posted_text"] is None


def test_listing_is_told_apart_by_its_start(spark):
    feed = json.dumps([{"id": "1", "text": "T", "hostedUrl": "u", "categories": {"location": "Noida, UP"}}])
    (r,) = records(spark, " \n" + feed, PO.listing(F.col("t")))
    assert (r["job_id"], r["city"], r["state"], r["country_code"], r["apply_url"]) == ("1", "Noida", "UP", "IN", None)
    assert records(spark, "[broken", PO.listing(F.col("t"))) == []
    page = (
        '<div class="posting" data-qa-posting-id="7"><a class="posting-title" href="u7"><h5 data-qa="posting-name">T 7</h5>'
        '<span class="location">Noida</span><span class="workplaceTypes">On-site —</span></a></div>'
        '<div class="posting" data-qa-posting-id="8"></div>'
    )
    a, b = records(spark, page, PO.listing(F.col("t")))
    assert (a["job_id"], a["title"], a["url"], a["city"], a["state"], a["work_type"]) == ("7", "T 7", "u7", "Noida", None, "On-site")
    assert (b["job_id"], b["title"], b["url"]) == ("8", None, None)


def test_greenhouse_prefers_detail_and_filters_by_listing(spark):
    listing = spark.createDataFrame([(
        '<td class="cell"><a href="https://g/acme/jobs/1"><p class="body body--medium">One</p>'
        '<p class="body body__secondary body--metadata">Bengaluru</p></a></td>'
        '<td class="cell"><a href="https://g/acme/jobs/2"><p class="body body--medium">Two</p>'
        '<p class="body body__secondary body--metadata">Germany</p></a></td>'
        '<td class="cell"><a href="https://g/acme/jobs/3"><p class="body body--medium">Three</p></a></td>',)], "html string")
    detail = spark.createDataFrame([("https://g/acme/jobs/1", (
        '<h1 class="section-header">One (detail)</h1><div class="job__location"><div>Pune, India</div></div>'
        '<div class="job__description body"><p>a</p><p>b</p></div><time>March 1, 2024</time>'))], "url string, html string")
    keys = N.country_keys(spark.createDataFrame([("India", "IN"), ("Germany", "DE")], "name string, code string"))
    (r,) = N.greenhouse_records(listing, detail, keys).collect()
    assert (r.title, r.job_id, r.city, r.country_code, r.job_description, r.date_posted) == (
        "One (detail)", "1", "Pune", "IN", "a\nb", "2024-03-01T00:00:00")
    assert {r.job_id for r in N.greenhouse_records(listing, detail, keys, None).collect()} == {"1", "2", "3"}


def test_generic_takes_the_first_element_on_the_page(value):
    html = (
        '<title>t</title><p class="title">first</p><h1>second</h1><!-- <time>no</time> -->'
        '<meta property="article:published_time" content=" 2024-02-01 "><time>May 4, 2024</time>'
        '<div class="description">d <b>e</b></div><a class="btn-apply" href="apply">x</a>'
    )
    r = value(PO.generic_detail(L(html), L("https://c.com/us/jobs/77/x")))
    assert (r.title, r.job_id, r.date_posted, r.job_description, r.apply_url) == (
        "first", "77", "2024-02-01T00:00:00", "d e", "https://c.com/us/jobs/77/apply")
    bare = value(PO.generic_detail(L("<title>only</title>"), L("https://c.com/x")))
    assert bare.title == "only" and bare.apply_url is None and bare.job_id is None


def test_link_record_and_completion(spark, value):
    r = value(PO.link_record(L(" Role "), L("https://z.in/jobs/Careers/654/Role")))
    assert (r.title, r.job_id, r.url, r.apply_url, r.city) == ("Role", "654", r.apply_url, r.url, None)
    a = spark.createDataFrame([("1",)], "job_id string")
    b = spark.createDataFrame([("t",)], "title string")
    got = N.with_defaults(N.combine([a, b]), {"title": "none"})
    assert {tuple(x) for x in got.select("job_id", "title").collect()} == {("1", "none"), (None, "t")}


def test_spread_deals_the_rows_of_one_file_over_all_cores(spark, tmp_path):
    rows = [(k // 2 if k % 5 else None, "same") for k in range(400)]
    spark.createDataFrame(rows, "k int, t string").coalesce(1).write.parquet(str(tmp_path / "one"))
    dealt = I.spread(spark.read.parquet(str(tmp_path / "one"))).withColumn("task", F.spark_partition_id()).collect()
    tasks = Counter(r.task for r in dealt)
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(tasks.values()) <= 2 * min(tasks.values())
    assert Counter((r.k, r.t) for r in dealt) == Counter(rows)


@pytest.mark.parametrize("name", ["greenhouse_records", "smartrecruiters_records", "lever_listing", "workday_records"])
def test_pages_made_of_one_file_are_worked_on_by_many_tasks(spark, tmp_path, name):
    parts = [(k, f"name {k}", "Brand#1", "SMALL", 1 + 3 * (k % 8)) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "NATION_1")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    out = QUERIES[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition ") == plan.count("Relation [p_partkey") > 0
    assert out.count() == 40


def test_details_are_not_broadcast_to_their_links(spark):
    page = spark.createDataFrame([('<a class="js-job-ad-link" href="https://s/A/1-x">x</a>',)], "html string")
    detail = spark.createDataFrame([("https://s/A/1-x", '<h1 itemprop="title">T</h1>'), (None, "<h1>no url</h1>")], "url string, html string")
    out = N.smartrecruiters_records(page, detail)
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.title, r.job_id, r.url) for r in out.collect()] == [("T", "1", "https://s/A/1-x")]
