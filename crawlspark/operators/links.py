"""Link tables from stored pages. HTML is read once and never carried further."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.functions import html as H
from crawlspark.functions import predicates as P
from crawlspark.functions import urls as U
from crawlspark.operators import keyed as K


def page_links(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """One row per anchor: position from 0 and href; empty hrefs are dropped."""
    links = pages.select(*keep, F.posexplode(H.anchor_hrefs(F.col(html))).alias("pos", "href"))
    return links.where(F.col("href") != "")


def resolved_links(pages: DataFrame, keep: Sequence[str], url: str = "url", html: str = "html") -> DataFrame:
    """Followable links with their absolute form and host."""
    links = page_links(pages, [*keep, url], html).where(P.is_navigable(F.col("href")))
    out = links.withColumn("link_url", U.resolve(F.col(url), F.col("href")))
    return out.where(P.is_web_url(F.col("link_url"))).withColumn("link_host", U.host(F.col("link_url")))


def job_links(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """Distinct job-posting hrefs per page."""
    return pages.select(*keep, F.explode(H.job_links(F.col(html))).alias("href"))


def drop_denied(
    df: DataFrame, column: str, hosts: Sequence[str] = M.TRACKING_HOSTS
) -> DataFrame:
    """Rows whose URL or host holds none of the denied markers."""
    return df.where(~P.is_denied(F.col(column), hosts))


def endpoint_candidates(
    pages: DataFrame, keep: Sequence[str], url: str = "url", text: str = "html"
) -> DataFrame:
    return pages.select(
        *keep,
        F.posexplode(H.endpoint_literals(F.col(text), F.col(url))).alias("seq", "endpoint_url"),
    )


def script_bundles(
    pages: DataFrame,
    captures: DataFrame | None,
    key: str = "domain",
    url: str = "url",
    k: int | None = None,
) -> DataFrame:
    """Same-site script URLs of a page plus captured ones, first occurrence kept, in order."""
    inline = pages.select(
        key, F.lit(0).alias("source_no"), F.posexplode(H.bundle_urls(F.col("html"), F.col(url))).alias("seq", "bundle_url")
    )
    first = all_bundles(inline, pages, captures, key, url)
    order = [F.col("source_no"), F.col("seq")]
    return first if k is None else K.top_k_per_key(first, [key], order, k)


def all_bundles(
    inline: DataFrame, pages: DataFrame, captures: DataFrame | None, key: str = "domain", url: str = "url"
) -> DataFrame:
    """Script URLs found in pages (key, source_no, seq, bundle_url) and captured ones, each at its first place."""
    out = inline
    if captures is not None:
        sites = pages.select(key, U.registrable_domain(U.host(F.col(url))).alias("_site"))
        bare = F.lower(F.substring_index("bundle_url", "?", 1))
        # Only scripts meet the sites.
        seen = captures.select(key, "seq", F.col("url").alias("bundle_url")).where(F.endswith(bare, F.lit(".js")))
        seen = K.attach(seen, sites, [key])
        seen = seen.where((F.col("_site") != "") & F.contains(U.host(F.col("bundle_url")), F.col("_site")))
        out = inline.unionByName(
            seen.select(key, F.lit(1).alias("source_no"), F.col("seq").cast("int").alias("seq"), "bundle_url")
        )
    return K.first_per_key(out, [key, "bundle_url"], [F.col("source_no"), F.col("seq")])
