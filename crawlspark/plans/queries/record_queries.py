"""Source shapes normalised to the flat record: locations, dates, listings, details."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark import markers as M
from crawlspark.functions import fields as FD
from crawlspark.functions import postings as PO
from crawlspark.functions import predicates as P
from crawlspark.operators import normalize as N
from crawlspark.operators import quality as Q
from crawlspark.plans.inputs import spread, table
from crawlspark.plans.registry import query

def _filled(*columns):
    """Columns with NULL shown as ``none``."""
    return [F.coalesce(F.col(c), F.lit("none")).alias(c) for c in columns]


def countries(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    named = nation.select("n_name", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    return N.country_keys(named, "n_name", "code")


# --- locations --------------------------------------------------------------


def places(spark, sf_dir):
    """Location text of every customer, in five forms, one of them with a listed city."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    form = F.col("c_custkey") % 6
    text = (
        F.when(form == 0, F.concat("c_mktsegment", F.lit(" , state x, "), "n_name"))
        .when(form == 1, F.concat("c_mktsegment", F.lit(", "), F.lower("n_name")))
        .when(form == 2, F.concat(F.lit(" "), "n_name", F.lit(" ")))
        .when(form == 3, F.col("c_mktsegment"))
        .when(form == 4, F.concat(F.lit("Pune Remote-"), "c_mktsegment", F.lit(", a, b, c")))
        .otherwise(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    )
    return joined.select("c_custkey", text.alias("place"))


_SQL_PLACES = """
places AS (SELECT c_custkey, c_custkey % 6 AS form, c_mktsegment AS seg, n_name, n_nationkey, 'N' || n_nationkey AS code,
  CASE c_custkey % 6 WHEN 0 THEN c_mktsegment || ' , state x, ' || n_name WHEN 1 THEN c_mktsegment || ', ' || lower(n_name)
    WHEN 2 THEN ' ' || n_name || ' ' WHEN 3 THEN c_mktsegment WHEN 4 THEN 'Pune Remote-' || c_mktsegment || ', a, b, c'
    ELSE 'N' || n_nationkey END AS place
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "locations_by_count",
    f"""WITH {_SQL_PLACES} SELECT c_custkey, CASE WHEN form IN (0, 1) THEN seg ELSE 'none' END AS city,
      CASE WHEN form = 0 THEN 'state x' ELSE 'none' END AS state,
      CASE form WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN n_name WHEN 3 THEN seg WHEN 4 THEN 'none' ELSE code END AS country,
      CASE WHEN form IN (0, 1, 2, 5) THEN code ELSE 'none' END AS country_code FROM places""",
)
def locations_by_count(spark, sf_dir):
    out = N.located_by_count(places(spark, sf_dir), "place", countries(spark, sf_dir))
    return out.select("c_custkey", *_filled("city", "state", "country", "country_code"))


@query(
    "locations_with_default",
    f"""WITH {_SQL_PLACES} SELECT c_custkey, CASE WHEN form IN (0, 1, 3) THEN seg WHEN form = 4 THEN 'Pune Remote-' || seg ELSE 'none' END AS city,
      CASE form WHEN 0 THEN 'state x, ' || n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN n_name WHEN 3 THEN 'India' WHEN 4 THEN 'a, b, c' ELSE n_name END AS country,
      CASE form WHEN 0 THEN 'none' WHEN 3 THEN 'IN' WHEN 4 THEN 'none' ELSE code END AS country_code FROM places""",
)
def locations_with_default(spark, sf_dir):
    out = N.located_with_default(places(spark, sf_dir), "place", countries(spark, sf_dir))
    return out.select("c_custkey", *_filled("city", "country", "country_code"))


@query(
    "locations_by_position",
    f"""WITH {_SQL_PLACES} SELECT c_custkey, CASE WHEN form IN (0, 1, 3) THEN seg WHEN form = 2 THEN n_name WHEN form = 4 THEN 'Pune Remote-' || seg ELSE code END AS city,
      CASE form WHEN 0 THEN 'state x' WHEN 1 THEN lower(n_name) WHEN 4 THEN 'a' ELSE 'none' END AS state,
      CASE form WHEN 0 THEN n_name WHEN 4 THEN 'b' ELSE 'none' END AS country,
      CASE WHEN form IN (0, 1, 3) THEN seg WHEN form = 2 THEN n_name WHEN form = 4 THEN 'Pune' ELSE code END AS first_word,
      CASE WHEN form = 4 THEN 'India' ELSE 'none' END AS word_country, form = 4 AS mentions_city FROM places""",
)
def locations_by_position(spark, sf_dir):
    p = places(spark, sf_dir)
    pos, first = FD.location_by_position(F.col("place")), FD.location_first_word(F.col("place"))
    out = p.select(
        "c_custkey", pos["city"].alias("city"), pos["state"].alias("state"), pos["country"].alias("country"),
        first["city"].alias("first_word"), first["country"].alias("word_country"),
        P.mentions_city(F.col("place")).alias("mentions_city"),
    )
    names = ("city", "state", "country", "first_word", "word_country")
    return out.select("c_custkey", *_filled(*names), "mentions_city")


@query(
    "country_lookup",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 'none' ELSE n_name END AS known_name,
      CASE WHEN s_suppkey % 4 = 3 THEN 'none' ELSE 'N' || n_nationkey END AS known_code
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def country_lookup(spark, sf_dir):
    """Names in any case and codes both hit; other text misses."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    form = F.col("s_suppkey") % 4
    text = (
        F.when(form == 0, F.lower("n_name")).when(form == 1, F.col("n_name"))
        .when(form == 2, F.concat(F.lit(" n"), F.col("n_nationkey").cast("string"))).otherwise(F.col("s_name"))
    )
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", text.alias("text"))
    out = N.with_country(named, F.col("text"), countries(spark, sf_dir))
    return out.select("s_suppkey", *_filled("known_name", "known_code"))


@query(
    "date_to_iso",
    """SELECT o_orderkey, CASE o_orderkey % 9
        WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT09:05:00+00:00') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT23:59:58.250000+05:30')
        WHEN 7 THEN 'none' WHEN 8 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS date_posted FROM orders""",
)
def date_to_iso(spark, sf_dir):
    d, form = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 9
    day = F.date_format(d, "yyyy-MM-dd")
    text = (
        F.when(form == 0, day)
        .when(form == 1, F.concat(day, F.lit("T09:05Z")))
        .when(form == 2, F.concat(day, F.lit(" 23:59:58.25+0530")))
        .when(form == 3, F.date_format(d, "MMMM d, yyyy"))
        .when(form == 4, F.concat(F.lit("Posted on "), F.date_format(d, "d MMM yyyy")))
        .when(form == 5, F.date_format(d, "M/d/yyyy"))
        .when(form == 6, F.concat(F.lit("since "), F.date_format(d, "yyyy/MM/dd"), F.lit(" open")))
        .when(form == 7, F.concat(F.lit("Posted "), F.dayofmonth(d).cast("string"), F.lit(" Days Ago")))
        .otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-13-45")))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return o.select("o_orderkey", F.coalesce(FD.iso_date(F.col("text")), F.lit("none")).alias("date_posted"))


# --- listings and details ---------------------------------------------------


@query(
    "listing_detail_merge",
    """SELECT 'p' || p_partkey AS url, CASE WHEN p_size > 25 OR p_size % 5 = 0 THEN p_name ELSE p_name || '!' END AS title,
      CASE WHEN p_size > 25 THEN 'none' ELSE p_type END AS job_description FROM part""",
)
def listing_detail_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    url = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("url")
    listing = part.select(url, F.col("p_name").alias("title"))
    detail = part.where(F.col("p_size") <= 25).select(
        url,
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat("p_name", F.lit("!"))).alias("title"),
        F.col("p_type").alias("job_description"),
    )
    out = N.listing_with_detail(listing, detail, "url", ["title", "job_description"])
    return out.select("url", "title", *_filled("job_description"))


@query(
    "workday_records",
    """SELECT p_name AS title, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE 'R-' || p_partkey END AS job_id,
      CASE WHEN p_size % 3 = 0 THEN 'Mumbai' ELSE p_type END AS city, CASE WHEN p_size % 3 = 0 THEN 'IN' ELSE 'none' END AS country_code,
      'https://w.example.com/job/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN '2024-03-0' || (1 + p_size % 9) || 'T00:00:00' ELSE 'none' END AS date_posted,
      CASE WHEN p_size % 2 = 0 THEN '2024-03-0' || (1 + p_size % 9) ELSE 'Posted Today' END AS date_posted_text FROM part""",
)
def workday_records(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    posting = F.struct(
        F.col("p_name").alias("title"),
        F.concat(F.lit("/job/"), key).alias("externalPath"),
        F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("R-"), key))).alias("bulletFields"),
        F.when(size % 3 == 0, "Mumbai Remote").otherwise(F.concat("p_type", F.lit(", x"))).alias("locationsText"),
        F.when(size % 2 == 0, F.concat(F.lit("2024-03-0"), (size % 9 + 1).cast("string"))).otherwise("Posted Today").alias("postedOn"),
    )
    body = F.to_json(F.struct(F.lit(1).alias("total"), F.array(posting).alias("jobs")))
    out = N.inline_records(part.select(body.alias("body")), PO.workday(F.col("body"), F.lit("https://w.example.com")))
    return out.select(
        "title", "url", "date_posted_text", *_filled("job_id", "city", "country_code", "date_posted")
    )


_LEVER_SQL = """
  SELECT p_partkey AS listing_id, 'L' || p_partkey AS job_id, p_name AS title, 'https://l.example.com/' || p_partkey AS url,
    'https://l.example.com/' || p_partkey || '/apply' AS apply_url, p_type AS city,
    CASE WHEN p_size % 4 < 2 THEN p_brand ELSE 'none' END AS state, 'IN' AS country_code, 'Full & part' AS employment_type, 'Remote' AS work_type,
    CASE WHEN p_partkey % 2 = 0 THEN '2024-05-01T08:00:00+00:00' ELSE 'none' END AS date_posted FROM part"""


@query("lever_listing", _LEVER_SQL)
def lever_listing(spark, sf_dir):
    """JSON feed for even parts, HTML page for odd ones, told apart by the text."""
    part = spread(table(spark, sf_dir, "part"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    url = F.concat(F.lit("https://l.example.com/"), key)
    place = F.when(size % 4 < 2, F.concat("p_type", F.lit(" , "), "p_brand")).otherwise(F.col("p_type"))
    feed = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit("L"), key).alias("id"),
                F.col("p_name").alias("text"),
                url.alias("hostedUrl"),
                F.concat(url, F.lit("/apply")).alias("applyUrl"),
                F.struct(
                    place.alias("location"), F.lit("Full & part").alias("commitment"), F.lit("Remote").alias("workplaceTypes")
                ).alias("categories"),
                F.lit("2024-05-01T08:00Z").alias("postedAt"),
            )
        )
    )
    page = F.concat(
        F.lit('<div class="list"><div class="posting" data-qa-posting-id="L'), key, F.lit('"><div class="posting-apply"><a class="posting-btn-submit big" href="'),
        url, F.lit('/apply">Apply</a></div><a class="posting-title" href="'), url, F.lit('"><h5 data-qa="posting-name"> '), F.col("p_name"),
        F.lit('</h5><span class="sort-by location">'), place, F.lit('</span><span class="commitment">Full &amp; part</span>'),
        F.lit('<span class="workplaceTypes">Remote — </span></a></div></div>'),
    )
    pages = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n "), feed)).otherwise(page).alias("content"))
    out = N.inline_records(pages.withColumnRenamed("p_partkey", "listing_id"), PO.listing(F.col("content")), ["listing_id"])
    return out.select(
        "listing_id", "job_id", "title", "url", "apply_url", "city", "country_code", "employment_type", "work_type",
        *_filled("state", "date_posted"),
    )


_GREENHOUSE_SQL = """
  SELECT CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' II' END AS title, CAST(p_partkey AS VARCHAR) AS job_id,
    CASE WHEN p_size > 25 THEN p_type WHEN p_size % 2 = 0 THEN 'Hall' ELSE p_type END AS city,
    CASE WHEN p_size <= 25 AND p_size % 2 = 0 THEN 'Nation_1' ELSE 'India' END AS country,
    CASE WHEN p_size <= 25 AND p_size % 2 = 0 THEN 'N1' ELSE 'IN' END AS country_code,
    CASE WHEN p_size > 25 THEN 'none' ELSE p_brand || chr(10) || p_type END AS job_description,
    CASE WHEN p_size > 25 THEN 'none' ELSE '2024-01-09T00:00:00' END AS date_posted
  FROM part WHERE p_size % 3 <> 0"""


@query("greenhouse_records", _GREENHOUSE_SQL)
def greenhouse_records(spark, sf_dir):
    """One listing page per part; a known country other than the default is filtered out."""
    part = spread(table(spark, sf_dir, "part"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    url = F.concat(F.lit("https://g.example.com/acme/jobs/"), key)
    listing = part.select(
        F.concat(
            F.lit('<table><tr><td class="cell"><a href="'), url, F.lit('"><p class="body body--medium">'), F.col("p_name"),
            F.lit('</p><p class="body body__secondary body--metadata">'), F.when(size % 3 == 0, "nation_2").otherwise(F.col("p_type")),
            F.lit("</p></a></td></tr><tr><td class='cell'><a href=''>none</a></td></tr></table>"),
        ).alias("html")
    )
    detail = part.where(size <= 25).select(
        url.alias("url"),
        F.concat(
            F.lit('<meta name="date" content=" January 9, 2024 "><h1 class="section-header big">'), F.col("p_name"), F.lit(" II</h1>"),
            F.when(size % 2 == 0, '<div class="job__location"><svg></svg><div>Hall, Nation_1</div></div>').otherwise("").alias("loc"),
            F.lit('<div class="job__description body"><p>'), F.col("p_brand"), F.lit("</p><p>"), F.col("p_type"), F.lit("</p></div>"),
        ).alias("html"),
    )
    out = N.greenhouse_records(listing, detail, countries(spark, sf_dir))
    return out.select(
        "title", "job_id", *_filled("city", "country", "country_code", "job_description", "date_posted")
    )


@query(
    "smartrecruiters_records",
    """SELECT p_name AS title, CAST(p_partkey AS VARCHAR) AS job_id, p_type AS city, p_brand AS state, 'NATION_1' AS country,
      'remote' AS work_type, 'Full-time' AS employment_type, 'May 4, 2024' AS date_posted_text,
      CASE WHEN p_size % 2 = 0 THEN '2024-05-04T10:00:00.120000+00:00' ELSE '2024-05-04T00:00:00' END AS date_posted, p_type || 'x' AS job_description
    FROM part WHERE p_size <> 50""",
)
def smartrecruiters_records(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    url = F.concat(F.lit("https://s.example.com/Acme/"), key, F.lit("-some-role"))
    listing = part.select(
        F.concat(
            F.lit('<ul><li class="opening-job"><a class="link js-job-ad-link" href="'), url,
            F.lit('">x</a></li><li><a href="https://s.example.com/other">y</a></li></ul>'),
        ).alias("html")
    )
    detail = part.where(size != 50).select(
        url.alias("url"),
        F.concat(
            F.lit('<h1 class="job-title" itemprop="title"> '), F.col("p_name"),
            F.lit(' </h1><spl-job-location formattedaddress="'), F.col("p_type"), F.lit(", "), F.col("p_brand"),
            F.lit(', NATION_1" workplacetype="remote"></spl-job-location><li itemprop="employmentType">Full-time</li><time itemprop="datePosted" '),
            F.when(size % 2 == 0, 'datetime="2024-05-04T10:00:00.12Z"').otherwise(""),
            F.lit('>May 4, 2024</time><div itemprop="description"><p>'), F.col("p_type"), F.lit("</p>x</div>"),
        ).alias("html"),
    )
    out = N.smartrecruiters_records(listing, detail)
    return out.select(
        "title", "job_id", "city", "state", "country", "work_type", "employment_type", "date_posted_text", "date_posted", "job_description",
    )


@query(
    "generic_records",
    """SELECT page_id AS job_id, coalesce(nullif(trim(title), ''), 'none') AS title, 'de' AS city, 'NATION_3' AS country, 'N3' AS country_code,
      'Contract' AS employment_type, CASE WHEN page_id % 2 = 0 THEN 'Hybrid' ELSE 'none' END AS work_type, '10-20' AS salary_range,
      'Part oneof ' || page_id || 'é…' AS job_description, '2024-02-03T00:00:00' AS date_posted, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/apply?x=1&y=2' AS apply_url
    FROM (SELECT CAST(page_id AS VARCHAR) AS job_id, page_id, url,
      replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages)""".replace(
        "page_id AS job_id, coalesce", "job_id, coalesce"
    ),
)
def generic_records(spark, sf_dir):
    """Stored pages with the usual detail elements behind their own heading."""
    pages = table(spark, sf_dir, "pages")
    pid = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<h2>later heading</h2><p class=salary-range title="over > under">10-20</p><span class="job-location">de, NATION_3</span>'),
        F.lit("<div title='a > b' class='long job-description'><div>Part <i>one</i></div><p>of "), pid, F.lit("&eacute;&hellip;</p></div>"),
        F.when(F.col("page_id") % 2 == 0, '<div class="work-type">Hybrid</div>').otherwise(""),
        F.lit('<em class="job-type"><b>Contract</b></em><div class="posted-date">3 Feb 2024</div>'),
        F.lit('<a class="btn apply" href="/apply?x=1&amp;y=2">Apply</a>'),
    )
    url = F.concat(F.regexp_extract("url", "^([a-z]+://[^/]*)", 1), F.lit("/jobs/"), pid, F.lit("/x"))
    out = N.generic_records(
        pages.select(url.alias("url"), F.concat("html", extra).alias("html")), countries(spark, sf_dir)
    )
    return out.select(
        *_filled(
            "job_id", "title", "city", "country", "country_code", "employment_type", "work_type", "salary_range",
            "date_posted", "apply_url", "job_description",
        )
    )


@query(
    "combined_records",
    """SELECT 'S' || s_suppkey AS job_id, s_name AS title, 'https://x.example.com/jobs/' || s_suppkey AS url, 'India' AS country FROM supplier
      UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'https://y.example.com/jobs/Careers/' || c_custkey || '/role', 'India' FROM customer""",
)
def combined_records(spark, sf_dir):
    """A shape with few fields and link-only rows in one table, completed and defaulted."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    partial = s.select(
        F.concat(F.lit("S"), key).alias("job_id"), F.col("s_name").alias("title"),
        F.concat(F.lit("https://x.example.com/jobs/"), key).alias("url"),
    )
    c = table(spark, sf_dir, "customer")
    href = F.concat(F.lit("https://y.example.com/jobs/Careers/"), F.col("c_custkey").cast("string"), F.lit("/role"))
    linked = N.inline_records(c, F.array(PO.link_record(F.concat(F.lit(" "), "c_name"), href)))
    whole = N.with_defaults(Q.complete_records(N.combine([partial, linked])), {"country": M.DEFAULT_COUNTRY})
    return whole.select("job_id", "title", "url", "country")
