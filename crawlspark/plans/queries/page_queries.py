"""Links, endpoints, cleaned text and pagination controls of stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark import markers as M
from crawlspark.functions import html as H
from crawlspark.functions.binding import let
from crawlspark.functions import predicates as P
from crawlspark.functions import urls as U
from crawlspark.operators import keyed as K
from crawlspark.operators import links as L
from crawlspark.operators import verdicts as V
from crawlspark.plans.inputs import (
    SQL_LISTING_PAGES, SQL_SLUG, listing_pages, page_slug, sql_any, sql_authority,
    sql_host, sql_hrefs, sql_scheme, table,
)
from crawlspark.plans.registry import query

_ROOT = f"{sql_scheme('url')} || '://' || {sql_authority('url')}"
_GENERIC = list(M.GENERIC_SLUG_WORDS)
_NAV = list(M.NAV_SLUG_WORDS)


@query(
    "page_links",
    f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, hrefs[i] AS href
      FROM (SELECT page_id, hrefs, generate_subscripts(hrefs, 1) AS i FROM (SELECT page_id, {sql_hrefs('html')} AS hrefs FROM pages))
      WHERE hrefs[i] <> ''""",
)
def page_links(spark, sf_dir):
    links = L.page_links(table(spark, sf_dir, "pages"), ["page_id"])
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


_SQL_WORDS = """list_filter(string_split(replace(CASE WHEN len(seg) >= 2 AND regexp_matches(seg[-1], '^[0-9]+$')
  THEN seg[-2] ELSE seg[-1] END, '_', '-'), '-'), lambda w: w <> '')"""
_SQL_JOB_LINKS = f"""
job_links AS (
  SELECT DISTINCT page_id, domain, href FROM (
    SELECT *, {_SQL_WORDS} AS words FROM (
      SELECT *, list_filter(string_split(regexp_extract(href, '^(?:[a-z]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
      FROM (SELECT page_id, domain, unnest({sql_hrefs('html')}) AS href FROM listing_pages)
      WHERE {sql_any('lower(href)', M.JOB_LINK_WORDS)}))
  WHERE (len(words) = 1 AND list_contains({_GENERIC}, lower(words[1])))
    OR (len(words) >= 3 AND len(list_filter(words, lambda w: NOT list_contains({_GENERIC + _NAV}, lower(w)))) >= 2))"""


@query(
    "job_links",
    f"WITH {SQL_LISTING_PAGES}, {_SQL_JOB_LINKS} SELECT page_id, href FROM job_links",
)
def job_links(spark, sf_dir):
    return L.job_links(listing_pages(spark, sf_dir), ["page_id"])


@query(
    "resolved_links",
    f"""WITH {SQL_LISTING_PAGES} SELECT page_id, pos, href, link_url, {sql_host('link_url')} AS link_host FROM (
      SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, hrefs[i] AS href,
        CASE WHEN starts_with(hrefs[i], 'https://') THEN hrefs[i] ELSE {_ROOT} || hrefs[i] END AS link_url
      FROM (SELECT *, generate_subscripts(hrefs, 1) AS i FROM (SELECT page_id, url, {sql_hrefs('html')} AS hrefs FROM listing_pages))
      WHERE NOT starts_with(hrefs[i], 'mailto:') AND NOT contains(hrefs[i], '{{{{'))""",
)
def resolved_links(spark, sf_dir):
    links = L.resolved_links(listing_pages(spark, sf_dir), ["page_id"])
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "link_url", "link_host")


@query(
    "ats_link",
    f"""WITH {SQL_LISTING_PAGES} SELECT page_id, CASE WHEN starts_with(url, 'https://')
      THEN 'https://boards.greenhouse.io/' || slug END AS ats_link FROM listing_pages""",
)
def ats_link(spark, sf_dir):
    return listing_pages(spark, sf_dir).select("page_id", H.ats_link(F.col("html"), F.col("url")).alias("ats_link"))


@query(
    "denylist_anti",
    f"""SELECT page_id, url FROM pages WHERE NOT {sql_any(sql_host('url'), ('blog.', 'spam', 'pills'))}""",
)
def denylist_anti(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"))
    return L.drop_denied(pages, "host", ("blog.", "spam", "pills")).select("page_id", "url")


def _script_pages(spark, sf_dir):
    """Pages with a script whose literals come from the page's own URL and title."""
    pages = table(spark, sf_dir, "pages")
    slug, pid = page_slug(F.col("html")), F.col("page_id").cast("string")
    script = F.concat(
        F.lit('<script src="/static/app-'), pid, F.lit('.js"></script><script src="https://www.hotjar.com/jobs.js"></script>'),
        F.lit("<script src='"), F.regexp_extract("url", "^([^?#]*)", 1), F.lit("/main.js'></script>"),
        F.lit('<script>const a="/api/jobs/'), slug, F.lit('?id='), pid,
        F.lit('";b=\'https://api.example.org/search/'), slug,
        F.lit("';c=\"//cdn.example.net/positions/"), pid,
        F.lit('";d="/static/jobs.css";e="https://www.google-analytics.com/collect?job=1";f="/assets/'), slug,
        F.lit('"</script>'),
    )
    return pages.select(
        "page_id", "url", U.host(F.col("url")).alias("domain"), F.concat(script, "html").alias("html")
    )


@query(
    "endpoint_literals",
    f"""SELECT page_id, endpoint_url FROM (
      SELECT page_id, unnest([{_ROOT} || '/api/jobs/' || slug || '?id=' || page_id,
        'https://api.example.org/search/' || slug, 'https://cdn.example.net/positions/' || page_id]
        || CASE WHEN {sql_any("('/assets/' || slug)", M.API_URL_WORDS)} THEN [{_ROOT} || '/assets/' || slug] ELSE [] END)
        AS endpoint_url
      FROM (SELECT page_id, url, {SQL_SLUG} AS slug FROM pages))""",
)
def endpoint_literals(spark, sf_dir):
    return L.endpoint_candidates(_script_pages(spark, sf_dir), ["page_id"]).select("page_id", "endpoint_url")


@query(
    "script_bundles",
    f"""SELECT page_id, bundle_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS BIGINT) AS nth FROM (
      SELECT page_id, 1 AS n, {_ROOT} || '/static/app-' || page_id || '.js' AS bundle_url FROM pages
      UNION ALL SELECT page_id, 2, regexp_extract(url, '^([^?#]*)', 1) || '/main.js' FROM pages
      UNION ALL SELECT page_id, 3, 'https://static.' || {sql_host('url')} || '/late.js?v=1' FROM pages)""",
)
def script_bundles(spark, sf_dir):
    pages = _script_pages(spark, sf_dir).drop("domain").withColumn("domain", F.col("page_id"))
    host = U.host(F.col("url"))
    captured = pages.select(
        "domain",
        F.posexplode(
            F.array(
                F.concat(F.lit("https://static."), host, F.lit("/late.js?v=1")),
                F.lit("https://cdn.elsewhere.io/lib.js"),
                F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("/main.js")),
            )
        ).alias("seq", "url"),
    )
    bundles = L.script_bundles(pages, captured, k=12)
    ranked = K.top_k_per_key(bundles, ["domain"], [F.col("source_no"), F.col("seq")], 12, "nth")
    return ranked.select(
        F.col("domain").alias("page_id"), "bundle_url", F.col("nth").cast("long").alias("nth")
    )


# --- cleaned text -----------------------------------------------------------


def _sql_clean(h: str) -> str:
    for tag in M.STRIPPED_TAGS:
        pattern = f"<{tag}\\b[^>]*>" if tag in ("link", "meta") else f"<{tag}\\b[^>]*>.*?</{tag}\\s*>"
        h = f"regexp_replace({h}, '{pattern}', '', 'gis')"
    return h


def _sql_unescape(t: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return t


def _sql_text(h: str, joiner: str = "") -> str:
    flat = _sql_unescape(f"regexp_replace({h}, '(<[^>]+>)+', '{joiner}', 'g')")
    return f"nullif(regexp_replace({flat}, '^\\s+|\\s+$', '', 'g'), '')"


@query("clean_html", f"SELECT page_id, {_sql_clean('html')} AS cleaned FROM pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.clean(F.col("html")).alias("cleaned"))


@query(
    "element_text",
    f"""SELECT page_id, {_sql_text("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
      {_sql_text("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS heading,
      {_sql_text("regexp_extract(html, '(?is)<div class=.ad.>(.*?)</div>', 1)")} AS ad,
      {_sql_text("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)")} AS body,
      {_sql_text("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)", " ")} AS spaced_body FROM pages""",
)
def element_text(spark, sf_dir):
    """Texts of one token pass, put together without and with a blank."""
    texts = let(
        H.tokens(F.col("html")),
        lambda page: F.struct(
            H.text_in(page, "title").alias("title"),
            H.text_in(page, "h1").alias("heading"),
            H.text_in(page, "div", H.class_condition("ad")).alias("ad"),
            H.text_in(page, "article").alias("body"),
            H.text_in(page, "article", joiner=" ").alias("spaced_body"),
        ),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.inline(F.array(texts)))


@query(
    "evidence_sample",
    f"""WITH {SQL_LISTING_PAGES} SELECT page_id, substr(cleaned, 1, 8000) AS page_sample,
      CASE WHEN slug = '' THEN '(no sample)' ELSE substr(slug, 1, 8000) END AS slug_sample
    FROM (SELECT page_id, slug, {_sql_clean('html')} AS cleaned FROM listing_pages)""",
)
def evidence_sample(spark, sf_dir):
    pages = listing_pages(spark, sf_dir)
    slug = page_slug(F.col("html"))
    return pages.select(
        "page_id",
        H.sample_or_note(H.clean(F.col("html"))).alias("page_sample"),
        H.sample_or_note(slug).alias("slug_sample"),
    )


@query(
    "job_link_sample",
    f"""WITH {SQL_LISTING_PAGES}, {_SQL_JOB_LINKS},
    flags AS (SELECT page_id,
      bool_or(href = '/jobs/' || slug || '/' || page_id) AS a, bool_or(href = '/careers/' || slug || '?ref=' || page_id) AS b,
      bool_or(href = 'https://boards.greenhouse.io/' || slug || '/jobs/' || page_id) AS c
      FROM job_links JOIN (SELECT page_id, slug FROM listing_pages) USING (page_id) GROUP BY page_id),
    parts AS (SELECT page_id, html,
      CASE WHEN a THEN ['<li><a href="/jobs/' || slug || '/' || page_id || '">open</a></li>'] ELSE [] END
      || CASE WHEN b THEN ['<li><a href="/careers/' || slug || '?ref=' || page_id || '">role</a></li>'] ELSE [] END
      || CASE WHEN c THEN ['<a href=''https://boards.greenhouse.io/' || slug || '/jobs/' || page_id || '''>one</a>'] ELSE [] END AS found
      FROM listing_pages LEFT JOIN flags USING (page_id))
    SELECT page_id, substr(CASE WHEN len(found) > 0 THEN array_to_string(found, chr(10) || chr(10) || '---' || chr(10) || chr(10))
      ELSE {_sql_clean('html')} END, 1, 6000) AS snippet FROM parts""",
)
def job_link_sample(spark, sf_dir):
    return listing_pages(spark, sf_dir).select("page_id", H.job_link_sample(F.col("html")).alias("snippet"))


# --- pagination controls ----------------------------------------------------


def _control_pages(spark, sf_dir):
    """Pages whose language decides which control, and whether it was used."""
    pages = table(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    control = (
        F.when(lang == "fr", '<a rel="next" href="/p2">2</a>')
        .when(lang == "de", "<div class='list pagination-bar'>1 2</div>")
        .when(lang == "es", "<button>Load More</button>")
        .otherwise("<button>Save</button>")
    )
    interactions = F.array(
        F.struct(F.lit("scroll").alias("action"), F.lit("next").alias("target")),
        F.struct(
            F.when(F.startswith(F.col("url"), F.lit("https://")), "click").otherwise("hover").alias("action"),
            F.when(lang.isin("es", "fr"), "Load more jobs").otherwise("menu").alias("target"),
        ),
    )
    return pages.select(
        "page_id", lang.alias("lang"), F.concat("html", control).alias("html"), interactions.alias("interactions")
    )


@query(
    "rendered_pagination",
    """SELECT page_id, lang IN ('fr', 'de', 'es') AS has_control,
      CASE WHEN driven THEN 'confirmed' WHEN lang IN ('fr', 'de', 'es') THEN 'unknown' ELSE 'not_required' END AS status,
      CASE WHEN driven THEN 'load more / infinite scroll (driven in browser)' END AS mechanism
    FROM (SELECT page_id, lang, lang IN ('es', 'fr') AND starts_with(url, 'https://') AS driven
      FROM (SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages))""",
)
def rendered_pagination(spark, sf_dir):
    verdict = H.rendered_pagination(F.col("html"), F.col("interactions"))
    return _control_pages(spark, sf_dir).select(
        "page_id",
        H.has_pagination_control(F.col("html")).alias("has_control"),
        verdict["status"].alias("status"),
        verdict["mechanism"].alias("mechanism"),
    )


_LINK_SETS = f"""rendered AS (SELECT DISTINCT {sql_host('url')} AS host, unnest({sql_hrefs('html')}) AS href FROM pages),
  plain AS (SELECT DISTINCT {sql_host('url')} AS host, unnest({sql_hrefs('html')}) AS href FROM pages WHERE starts_with(url, 'https://'))"""


def _link_sets(spark, sf_dir):
    """Rendered: the links of all pages of a host; plain: those it also serves over TLS."""
    pages = table(spark, sf_dir, "pages").withColumn("host", U.host(F.col("url")))
    links = L.page_links(pages, ["host", "url"])
    return links, links.where(F.startswith(F.col("url"), F.lit("https://")))


@query(
    "link_survival",
    f"""WITH {_LINK_SETS} SELECT host, count(*) AS n_rendered, count(p.href) AS n_plain, count(p.href) AS n_common,
      count(p.href) > 0 AS survives FROM rendered r LEFT JOIN plain p USING (host, href) GROUP BY host""",
)
def link_survival(spark, sf_dir):
    rendered, plain = _link_sets(spark, sf_dir)
    return V.link_survival(rendered, plain, ["host"])


@query(
    "set_difference",
    f"""WITH {_LINK_SETS} SELECT host, count(*) FILTER (p.href IS NULL) AS only_left, CAST(0 AS BIGINT) AS only_right,
      count(p.href) AS common, count(*) = count(p.href) AS equal
    FROM rendered r LEFT JOIN plain p USING (host, href) GROUP BY host""",
)
def set_difference(spark, sf_dir):
    rendered, plain = _link_sets(spark, sf_dir)
    return V.set_difference(rendered, plain, ["host"], "href")


@query(
    "pdf_sources",
    """SELECT page_id, lang = 'fr' AS is_pdf, length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) >= 3000 AS is_usable
      FROM (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS body FROM pages)""",
)
def pdf_sources(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    content_type = F.when(lang == "fr", "Application/PDF; charset=binary").otherwise("text/html")
    return pages.select(
        "page_id",
        P.is_pdf(content_type).alias("is_pdf"),
        P.is_usable_pdf_text(H.element(F.col("html"), "article"), 3000).alias("is_usable"),
    )
