"""Patterns remembered by platform shape, never by domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.functions import predicates as P
from crawlspark.functions import urls as U
from crawlspark.operators import keyed as K

LATEST = (
    "source_type", "pagination_mechanism", "pagination_param", "india_filter_mechanism", "ats_hint",
)


def platform_hint(host: Column, hints: Sequence[tuple[str, str]] = M.PLATFORM_HINTS) -> Column:
    """Description of the first platform whose marker the host holds."""
    out = None
    for marker, text in hints:
        held = F.contains(host, F.lit(marker))
        out = F.when(held, text) if out is None else out.when(held, text)
    return out


def already_on_platform(url: Column) -> Column:
    return P.contains_any(U.authority(url), M.ATS_HOSTS)


def site_signature(hint: Column, shape_keys: Column) -> Column:
    """First 16 hex digits of the hash over hint and shape; no domain goes in."""
    named = F.when(F.coalesce(hint, F.lit("")) != "", hint).otherwise("unknown")
    return F.substring(F.sha2(F.concat(named, F.lit("::"), shape_keys), 256), 1, 16)


def url_shapes(urls: DataFrame, keys: Sequence[str], url: str = "url") -> DataFrame:
    """Distinct path shapes of a source, sorted and comma-joined.

    Shapes are distinct before they are gathered; their number grows with path depth,
    not with the number of URLs.
    """
    shapes = urls.select(*keys, U.shape(F.col(url)).alias("_shape")).distinct()
    return shapes.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("_shape")), ",").alias("shape")
    )


def upsert(store: DataFrame, confirmed: DataFrame, at: str = "confirmed_at") -> DataFrame:
    """Store after a batch of confirmed patterns: latest values, hits added, last time seen.

    ``confirmed`` has a signature, the pattern columns and a time in epoch seconds. Both
    sides combine per signature before the join.
    """
    latest = F.struct(*[F.col(c) for c in LATEST])
    fresh = confirmed.groupBy("signature").agg(
        F.count(F.lit(1)).alias("_hits"),
        F.max(at).alias("_seen"),
        # Ties on time fall to the greater values, so reruns agree.
        F.max_by(latest, F.struct(F.col(at), latest)).alias("_new"),
    )
    merged = store.join(fresh, "signature", "full_outer")
    is_new = F.col("_new").isNotNull()
    return merged.select(
        "signature",
        *[F.when(is_new, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in LATEST],
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_hits", F.lit(0))).cast("long").alias("hit_count"),
        F.coalesce("_seen", "last_seen").alias("last_seen"),
    )


def lookup(sources: DataFrame, store: DataFrame) -> DataFrame:
    """Sources with the remembered parameter and filter, NULL when unknown.

    No broadcast is forced: the size of the store decides, before and during the run.
    """
    hints = store.select(
        "signature",
        F.col("pagination_param").alias("hint_param"),
        F.col("india_filter_mechanism").alias("hint_filter"),
    )
    return K.attach(sources, hints, ["signature"])
