"""URL functions, ranking, de-duplication and choice over stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark import markers as M
from crawlspark.functions import predicates as P
from crawlspark.functions import urls as U
from crawlspark.operators import candidates as C
from crawlspark.operators import keyed as K
from crawlspark.operators import memory as ME
from crawlspark.plans.inputs import (
    SQL_LISTING_PAGES, listing_pages, sql_any, sql_authority, sql_host, sql_hrefs, sql_path,
    sql_query, sql_scheme, sql_segments, sql_slashes, table,
)
from crawlspark.plans.registry import query

TIER_0, TIER_1 = ("blog.",), ("www.", "m.")
U_ = "url"


@query(
    "url_parts",
    f"""SELECT page_id, {sql_scheme(U_)} AS scheme, {sql_host(U_)} AS host, {sql_path(U_)} AS path,
      len({sql_segments(U_)}) AS n_segments, {sql_slashes(U_)} AS slashes, length(url) AS url_length,
      regexp_extract({sql_host(U_)}, '([^.]*[.])?[^.]*$', 0) AS registrable,
      {sql_query(U_)} AS query, regexp_extract(url, '#(.*)$', 1) AS fragment
    FROM pages""",
)
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.scheme(url).alias("scheme"),
        U.host(url).alias("host"),
        U.path(url).alias("path"),
        F.size(U.segments(url)).cast("long").alias("n_segments"),
        U.slash_count(url).cast("long").alias("slashes"),
        F.length(url).cast("long").alias("url_length"),
        U.registrable_domain(U.host(url)).alias("registrable"),
        U.query(url).alias("query"),
        U.fragment(url).alias("fragment"),
    )


_REFS = (
    "detail.html", "?page=3", "#top", "//cdn.example.org/a.js", "/root/x?y=1",
    "../up/y", "./here/", "https://other.example.org/z?q=1", "",
)
_ROOT = f"{sql_scheme(U_)} || '://' || {sql_authority(U_)}"
_DIR = f"regexp_replace({sql_path(U_)}, '[^/]*$', '')"


@query(
    "url_resolve",
    f"""SELECT page_id, ref, CASE
        WHEN ref = '' THEN url
        WHEN starts_with(ref, 'https://') THEN ref
        WHEN starts_with(ref, '//') THEN {sql_scheme(U_)} || ':' || ref
        WHEN starts_with(ref, '?') THEN {_ROOT} || {sql_path(U_)} || ref
        WHEN starts_with(ref, '#') THEN regexp_replace(url, '#.*$', '') || ref
        WHEN starts_with(ref, '/') THEN {_ROOT} || ref
        WHEN starts_with(ref, '../') THEN {_ROOT} || regexp_replace({_DIR}, '[^/]+/$', '') || substr(ref, 4)
        WHEN starts_with(ref, './') THEN {_ROOT} || {_DIR} || substr(ref, 3)
        ELSE {_ROOT} || {_DIR} || ref END AS link_url
      FROM pages, (SELECT unnest({list(_REFS)}) AS ref)""",
)
def url_resolve(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    refs = pages.select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in _REFS])).alias("ref"))
    return refs.select("page_id", "ref", U.resolve(F.col("url"), F.col("ref")).alias("link_url"))


_PAIRS = f"list_filter(string_split({sql_query(U_)}, '&'), lambda p: regexp_matches(p, '^[^=]*=.'))"


@query(
    "url_with_params",
    f"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(
        list_transform(pairs, lambda p: CASE WHEN starts_with(p, 'page=') THEN 'page=7' ELSE p END)
        || CASE WHEN len(list_filter(pairs, lambda p: starts_with(p, 'page='))) = 0 THEN ['page=7'] ELSE [] END
        || ['q=a+b%26c'], '&') || regexp_extract(url, '(#.+)$', 1) AS probe_url,
        url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || page_id AS next_url
      FROM (SELECT page_id, url, {_PAIRS} AS pairs FROM pages)""",
)
def url_with_params(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.with_params(url, {"page": 7, "q": "a b&c"}).alias("probe_url"),
        U.append_param(url, "page", F.col("page_id")).alias("next_url"),
    )


@query(
    "query_params",
    f"""SELECT page_id, split_part(p, '=', 1) AS param, substr(p, instr(p, '=') + 1) AS val
      FROM (SELECT page_id, unnest({_PAIRS}) AS p FROM pages)""",
)
def query_params(spark, sf_dir):
    params = table(spark, sf_dir, "pages").select(
        "page_id", F.explode(U.query_params(F.col("url"))).alias("param", "vals")
    )
    return params.select("page_id", "param", F.explode("vals").alias("val"))


_SHAPE = (
    f"array_to_string(list_transform({sql_segments(U_)}, lambda s: "
    "CASE WHEN regexp_matches(s, '^[0-9]+$') THEN 'N' ELSE 'S' END), '/')"
)


@query(
    "url_shape",
    f"""SELECT host, string_agg(shape, ',' ORDER BY shape) AS shape
      FROM (SELECT DISTINCT {sql_host(U_)} AS host, {_SHAPE} AS shape FROM pages) GROUP BY host""",
)
def url_shape(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), "url")
    return ME.url_shapes(pages, ["host"])


_JOB_URLS = (
    "regexp_extract(url, '^([^?#]*)', 1) || '/jobs/' || page_id",
    "'https://x.example/a/jobs/' || page_id || '-senior-role/'",
    "'https://x.example/b/' || page_id || '-data-lead?src=feed'",
)


@query(
    "job_id_from_url",
    f"""SELECT page_id, job_url,
        CASE WHEN list_position(seg, 'jobs') > 0 THEN seg[list_position(seg, 'jobs') + 1] END AS after_word,
        CASE WHEN parts[-2] = 'jobs' THEN parts[-1] END AS last_after_word,
        list_filter(seg, lambda s: regexp_matches(s, '^[0-9]+$'))[1] AS first_number,
        split_part(parts[-1], '-', 1) AS before_dash,
        CASE WHEN len(dashed) >= 3 THEN dashed[-1] END AS last_dash_part
      FROM (SELECT page_id, job_url, {sql_segments('job_url')} AS seg,
          string_split(rtrim(job_url, '/'), '/') AS parts,
          string_split(split_part(string_split(job_url, '/')[-1], '?', 1), '-') AS dashed
        FROM (SELECT page_id, unnest([{', '.join(_JOB_URLS)}]) AS job_url FROM pages))""",
)
def job_id_from_url(spark, sf_dir):
    pid = F.col("page_id").cast("string")
    urls = F.array(
        F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("/jobs/"), pid),
        F.concat(F.lit("https://x.example/a/jobs/"), pid, F.lit("-senior-role/")),
        F.concat(F.lit("https://x.example/b/"), pid, F.lit("-data-lead?src=feed")),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(urls).alias("job_url"))
    u = F.col("job_url")
    return rows.select(
        "page_id",
        "job_url",
        U.id_after(u).alias("after_word"),
        U.id_last_after(u).alias("last_after_word"),
        U.id_first_number(u).alias("first_number"),
        U.id_before_dash(u).alias("before_dash"),
        U.id_last_dash_part(u).alias("last_dash_part"),
    )


# --- candidates -------------------------------------------------------------

_PATHS = list(M.COMMON_CAREERS_PATHS)
_TIER = f"""CASE WHEN {sql_any(sql_host(U_), TIER_0)} THEN 0
  WHEN {sql_any(sql_host(U_), TIER_1)} THEN 1 ELSE 2 END"""
_SQL_CANDIDATES = f"""
hits AS (SELECT {sql_host(U_)} AS domain, 0 AS source_no, page_id AS seq, url FROM pages),
guesses AS (
  SELECT domain, 1 AS source_no, i - 1 AS seq, 'https://' || domain || ({_PATHS})[i] AS url
  FROM (SELECT DISTINCT domain FROM hits), range(1, {len(_PATHS) + 1}) t(i)),
candidates AS (
  SELECT domain, url, source_no, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY domain, url ORDER BY source_no, seq) AS rn
    FROM (SELECT * FROM hits UNION ALL SELECT * FROM guesses)) WHERE rn = 1),
ranked AS (
  SELECT domain, url, source_no, seq, {_TIER} AS tier, {sql_slashes(U_)} AS slashes, length(url) AS url_length,
    row_number() OVER (PARTITION BY domain ORDER BY {_TIER}, {sql_slashes(U_)}, length(url), source_no, seq) AS rank
  FROM candidates)"""


def _candidates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hits = pages.select(U.host(F.col("url")).alias("domain"), F.col("page_id").alias("seq"), "url")
    guesses = C.guessed_urls(hits.select("domain").distinct())
    both = C.union_sources([hits, guesses], ["domain", "url"], "seq")
    return C.dedupe_first(both, ["domain"])


@query(
    "candidate_urls",
    f"WITH {_SQL_CANDIDATES} SELECT domain, url, source_no, CAST(seq AS BIGINT) AS seq FROM candidates",
)
def candidate_urls(spark, sf_dir):
    return _candidates(spark, sf_dir).select("domain", "url", F.col("source_no").cast("long").alias("source_no"), "seq")


@query(
    "rank_urls",
    f"WITH {_SQL_CANDIDATES} SELECT domain, url, tier, slashes, rank FROM ranked WHERE rank <= 8",
)
def rank_urls(spark, sf_dir):
    ranked = C.top_candidates(_candidates(spark, sf_dir), ["domain"], 8, first=TIER_0, second=TIER_1)
    return ranked.select(
        "domain", "url", F.col("tier").cast("long").alias("tier"),
        F.col("slashes").cast("long").alias("slashes"), F.col("rank").cast("long").alias("rank"),
    )


@query(
    "choose_url",
    f"""WITH {SQL_LISTING_PAGES}, {_SQL_CANDIDATES},
    answers AS (SELECT url, CASE WHEN starts_with(url, 'https://') THEN 200 ELSE 403 END AS status,
      CASE WHEN starts_with(url, 'https://') THEN 'https://boards.greenhouse.io/' || slug END AS ats_link FROM listing_pages),
    probed AS (SELECT r.*, a.ats_link, coalesce(a.status < 400, false) AS ok FROM ranked r LEFT JOIN answers a USING (url) WHERE rank <= 8),
    scan AS (SELECT *, coalesce(max(CASE WHEN rank = 1 AND tier < 2 AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY domain), 0) AS ends FROM probed),
    found AS (
      SELECT domain, max(CASE WHEN rank = 1 THEN url END) AS top, max(CASE WHEN rank = 1 AND tier < 2 THEN 1 ELSE 0 END) AS strong,
        arg_min(ats_link, rank) FILTER (WHERE ok AND ats_link IS NOT NULL AND (ends = 0 OR rank = 1)) AS link,
        arg_min(url, rank) FILTER (WHERE ok) AS first_ok
      FROM scan GROUP BY domain)
    SELECT domain, CASE WHEN link IS NOT NULL THEN link WHEN strong = 1 THEN top ELSE coalesce(first_ok, top) END AS careers_url,
      CASE WHEN link IS NOT NULL THEN 'follow_ats_link' WHEN strong = 1 THEN 'prefer_strong_careers_url'
        ELSE 'use_probed_candidate' END AS action
    FROM found""",
)
def choose_url(spark, sf_dir):
    stored = listing_pages(spark, sf_dir).withColumn(
        "status", F.when(F.startswith(F.col("url"), F.lit("https://")), 200).otherwise(403)
    )
    return C.choose_url(
        _candidates(spark, sf_dir), C.page_answers(stored), ["domain"], first=TIER_0, second=TIER_1
    )


@query(
    "dedupe_first",
    f"""SELECT registrable, lang, page_id, url FROM (
      SELECT *, row_number() OVER (PARTITION BY registrable, lang ORDER BY page_id) AS rn FROM (
        SELECT page_id, url, {sql_segments(U_)}[1] AS lang,
          regexp_extract({sql_host(U_)}, '([^.]*[.])?[^.]*$', 0) AS registrable FROM pages)) WHERE rn = 1""",
)
def dedupe_first(spark, sf_dir):
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        U.registrable_domain(U.host(url)).alias("registrable"),
        F.try_element_at(U.segments(url), F.lit(1)).alias("lang"),
    )
    return K.first_per_key(pages, ["registrable", "lang"], [F.col("page_id")])


_WORDS = ("en", "th", "er", "html", "page", "utm")
_HITS = " + ".join(f"CAST(contains(lower(url), '{w}') AS BIGINT)" for w in _WORDS)


@query(
    "topk_per_host",
    f"""SELECT host, url, marker_hits, rank FROM (
      SELECT {sql_host(U_)} AS host, url, {_HITS} AS marker_hits,
        row_number() OVER (PARTITION BY {sql_host(U_)} ORDER BY {_HITS} DESC, page_id) AS rank FROM pages)
      WHERE rank <= 15""",
)
def topk_per_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), "url", F.col("page_id").alias("seq"))
    top = C.top_by_marker_hits(pages, ["host"], 15, words=_WORDS)
    return top.select(
        "host", "url", F.col("marker_hits").cast("long").alias("marker_hits"), F.col("rank").cast("long").alias("rank")
    )


@query(
    "careers_url_filter",
    f"""SELECT page_id, contains(url, 'example') AND ({sql_any('lower(url)', ('en', 'feed'))}) AS is_careers,
      {_TIER} < 2 AS is_strong FROM pages""",
)
def careers_url_filter(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        P.is_careers_url(url, F.lit("example"), ("en", "feed")).alias("is_careers"),
        (P.host_tier(url, TIER_0, TIER_1) < 2).alias("is_strong"),
    )
