"""Inputs of the queries, derived by Spark from the given tables, and their SQL twins.

The tables hold no listings, probes or traces, so each input maps whole tables onto the
shape an operator expects. Every row takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlspark.functions import urls as U


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """The same rows dealt evenly over all cores.

    One task reads a small file or row group, however much work its rows become. For narrow rows that
    pages or payloads are made of: they pass the shuffle, the text does not.
    """
    return df.repartition(tasks_per_core * df.sparkSession.sparkContext.defaultParallelism)


# --- SQL pieces -------------------------------------------------------------


def sql_scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def sql_authority(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)"


def sql_host(u: str) -> str:
    return f"lower({sql_authority(u)})"


def sql_path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


def sql_query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def sql_segments(u: str) -> str:
    return f"list_filter(string_split({sql_path(u)}, '/'), lambda s: s <> '')"


def sql_slashes(u: str) -> str:
    return f"(length({sql_path(u)}) - length(replace({sql_path(u)}, '/', '')))"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# --- listing pages ----------------------------------------------------------

# A slug of the page title: letters only, so most titles read like a posting.
SQL_SLUG = (
    "trim(lower(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), "
    "'[^A-Za-z]+', '-', 'g')), '-')"
)


def page_slug(html: Column) -> Column:
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    return F.btrim(F.lower(F.regexp_replace(title, "[^A-Za-z]+", "-")), F.lit("-"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with posting, navigation, platform and unusable links put in front."""
    pages = table(spark, sf_dir, "pages")
    slug = page_slug(F.col("html"))
    pid = F.col("page_id").cast("string")
    links = F.concat(
        F.lit('<ul><li><a href="/jobs/'), slug, F.lit("/"), pid, F.lit('">open</a></li><li><a href="/careers/'),
        slug, F.lit("?ref="), pid, F.lit('">role</a></li><li><a href="/careers/global-'),
        F.substring_index(slug, "-", 1), F.lit('">where</a></li></ul>'),
        F.when(F.startswith(F.col("url"), F.lit("https://")), F.concat(
            F.lit("<a href='https://boards.greenhouse.io/"), slug, F.lit("/jobs/"), pid,
            F.lit("'>one</a><a href='https://boards.greenhouse.io/"), slug, F.lit("'>all</a>"),
        )).otherwise(""),
        F.lit('<a href="mailto:?body=https://boards.greenhouse.io/x">mail</a><a href="/jobs/{{shortUrl}}">t</a>'),
        F.lit('<!-- <a href="/jobs/old-data-role-gone">gone</a> -->'),
    )
    return pages.select("page_id", "url", U.host(F.col("url")).alias("domain"), F.concat(links, "html").alias("html"))


SQL_LISTING_PAGES = f"""
listing_pages AS (
  SELECT page_id, url, {sql_host('url')} AS domain, slug,
    '<ul><li><a href="/jobs/' || slug || '/' || page_id || '">open</a></li><li><a href="/careers/' || slug || '?ref='
    || page_id || '">role</a></li><li><a href="/careers/global-' || split_part(slug, '-', 1) || '">where</a></li></ul>'
    || CASE WHEN starts_with(url, 'https://') THEN
      '<a href=''https://boards.greenhouse.io/' || slug || '/jobs/' || page_id
      || '''>one</a><a href=''https://boards.greenhouse.io/' || slug || '''>all</a>' ELSE '' END
    || '<a href="mailto:?body=https://boards.greenhouse.io/x">mail</a><a href="/jobs/{{{{shortUrl}}}}">t</a>'
    || '<!-- <a href="/jobs/old-data-role-gone">gone</a> -->' || html AS html
  FROM (SELECT page_id, url, html, {SQL_SLUG} AS slug FROM pages)
)"""

# Anchors of a page: comments, scripts and styles out, then every href, entities decoded.
SQL_MARKUP = (
    "regexp_replace({h}, '<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'gis')"
)


def sql_hrefs(h: str) -> str:
    markup = SQL_MARKUP.format(h=h)
    raw = (
        f"regexp_extract_all({markup}, "
        "'(?is)<a(?:\\s[^>]*?)?\\shref\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1)"
    )
    return (
        f"list_transform({raw}, lambda x: replace(replace(replace(replace(replace("
        "regexp_replace(x, '^[\"'']|[\"'']$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
        "'&#39;', ''''), '&amp;', '&'))"
    )


# --- items of probes --------------------------------------------------------

# Event types play the part of probe answers of one source (the user).
SQL_BUCKET = "CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 25) AS INTEGER)"


def event_bucket() -> Column:
    k = F.try_variant_get(F.try_parse_json(F.col("props")), "$.k", "int")
    return F.floor(k / 25).cast("int")
