"""Ranking, de-duplicating and choosing candidate URLs per domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.functions import html as H
from crawlspark.functions import predicates as P
from crawlspark.functions import urls as U
from crawlspark.operators import keyed as K


def union_sources(sources: Sequence[DataFrame], columns: Sequence[str], seq: str) -> DataFrame:
    """Candidates of several sources as one list: all of the first before the second."""
    parts = [
        df.select(*columns, F.lit(i).alias("source_no"), F.col(seq).cast("long").alias(seq))
        for i, df in enumerate(sources)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def guessed_urls(domains: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, seq, url) of the common careers paths."""
    return domains.select(domain, F.posexplode(U.candidate_urls(F.col(domain))).alias("seq", "url"))


def rank_columns(
    url: Column,
    first: Sequence[str] = M.ATS_HOSTS,
    second: Sequence[str] = M.CAREERS_HOST_WORDS,
) -> dict[str, Column]:
    """Sort key of a candidate: host tier, then slashes, then length."""
    return {
        "tier": P.host_tier(url, first, second),
        "slashes": U.slash_count(url),
        "url_length": F.length(url),
    }


RANK_ORDER = ("tier", "slashes", "url_length")


def with_rank_key(
    df: DataFrame,
    url: str = "url",
    first: Sequence[str] = M.ATS_HOSTS,
    second: Sequence[str] = M.CAREERS_HOST_WORDS,
) -> DataFrame:
    return df.withColumns(rank_columns(F.col(url), first, second))


def dedupe_first(
    df: DataFrame, keys: Sequence[str], url: str = "url", order: Sequence[str] = ("source_no", "seq")
) -> DataFrame:
    """One row per (key, url): the first in order."""
    return K.first_per_key(df, [*keys, url], [F.col(c) for c in order])


def top_candidates(
    df: DataFrame,
    keys: Sequence[str],
    k: int = 8,
    url: str = "url",
    seq: Sequence[str] = ("source_no", "seq"),
    rank: str = "rank",
    first: Sequence[str] = M.ATS_HOSTS,
    second: Sequence[str] = M.CAREERS_HOST_WORDS,
) -> DataFrame:
    """The k best-ranked URLs of a domain; equal ranks keep their given order."""
    order = [F.col(c) for c in (*RANK_ORDER, *seq)]
    return K.top_k_per_key(with_rank_key(df, url, first, second), keys, order, k, rank)


def top_by_marker_hits(
    df: DataFrame,
    keys: Sequence[str],
    k: int = 15,
    url: str = "url",
    seq: Sequence[str] = ("seq",),
    words: Sequence[str] = M.API_URL_WORDS,
    rank: str = "rank",
) -> DataFrame:
    """The k URLs of a site that hold the most marker words."""
    hits = df.withColumn("marker_hits", P.marker_hits(F.col(url), words))
    return K.top_k_per_key(hits, keys, [F.col("marker_hits").desc(), *[F.col(c) for c in seq]], k, rank)


def choose_url(
    candidates: DataFrame,
    answers: DataFrame,
    keys: Sequence[str],
    url: str = "url",
    k: int = 8,
    seq: Sequence[str] = ("source_no", "seq"),
    first: Sequence[str] = M.ATS_HOSTS,
    second: Sequence[str] = M.CAREERS_HOST_WORDS,
) -> DataFrame:
    """The careers URL of every domain from ranked candidates and stored answers.

    ``answers`` holds (url, status, ats_link), one row per URL; compute ``ats_link`` while
    scanning the pages so that no HTML travels through the join. Only the k best
    candidates are looked at. A platform link found on the way wins, then the strongest
    candidate even if it did not answer, then the first that answered, then the best
    guess. A good answer of a strong top candidate ends the look-up, so links on later
    pages do not count.
    """
    ranked = top_candidates(candidates, keys, k, url, seq, "rank", first, second)
    probed = ranked.join(
        answers.select(F.col(url).alias("_url"), "status", "ats_link"),
        ranked[url] == F.col("_url"),
        "left",
    )
    ok = P.responded(F.col("status"))
    is_top = F.col("rank") == 1
    with_link = ok & F.col("ats_link").isNotNull()
    folded = probed.groupBy(*keys).agg(
        F.max(F.when(is_top, F.col(url))).alias("_top"),
        F.max(is_top & (F.col("tier") < 2)).alias("_strong"),
        F.max(is_top & (F.col("tier") < 2) & ok).alias("_ends"),
        F.max(F.when(is_top & ok, F.col("ats_link"))).alias("_top_link"),
        F.min_by(F.when(with_link, F.col("ats_link")), F.when(with_link, F.col("rank"))).alias("_link"),
        F.min_by(F.when(ok, F.col(url)), F.when(ok, F.col("rank"))).alias("_first_ok"),
    )
    link = F.when(F.col("_ends"), F.col("_top_link")).otherwise(F.col("_link"))
    action = (
        F.when(link.isNotNull(), "follow_ats_link")
        .when(F.col("_strong"), "prefer_strong_careers_url")
        .otherwise("use_probed_candidate")
    )
    chosen = (
        F.when(link.isNotNull(), link)
        .when(F.col("_strong"), F.col("_top"))
        .otherwise(F.coalesce("_first_ok", "_top"))
    )
    return folded.select(*keys, chosen.alias("careers_url"), action.alias("action"))


def page_answers(pages: DataFrame, url: str = "url") -> DataFrame:
    """(url, status, ats_link) from stored pages; HTML is dropped right here."""
    return pages.select(url, "status", H.ats_link(F.col("html"), F.col(url)).alias("ats_link"))
