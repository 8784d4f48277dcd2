"""Source tables to the flat record schema: lookups, listing with detail, completion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.functions import fields as FD
from crawlspark.functions import postings as PO
from crawlspark.functions import urls as U
from crawlspark.schema import RECORD_FIELDS


def country_keys(countries: DataFrame, name: str = "name", code: str = "code") -> DataFrame:
    """(lookup_key, country_name, country_code): every country by lower-cased name and code.

    Where two countries share a key the smaller name wins, so reruns agree.
    """
    keys = F.array_distinct(F.array(F.lower(F.trim(F.col(name))), F.lower(F.trim(F.col(code)))))
    named = countries.select(
        F.explode(keys).alias("lookup_key"),
        F.struct(F.col(name).alias("country_name"), F.col(code).alias("country_code")).alias("c"),
    )
    return named.groupBy("lookup_key").agg(F.min("c").alias("c")).select("lookup_key", "c.*")


def with_country(
    df: DataFrame, text: Column, keys: DataFrame, name: str = "known_name", code: str = "known_code"
) -> DataFrame:
    """Left join of the lookup; a miss is NULL.

    Not hinted: the optimiser broadcasts the lookup when its size allows and otherwise
    splits skewed keys of a sort-merge join.
    """
    side = keys.select(
        F.col("lookup_key"), F.col("country_name").alias(name), F.col("country_code").alias(code)
    )
    keyed = df.withColumn("_key", F.lower(F.trim(text)))
    return keyed.join(side, keyed["_key"] == side["lookup_key"], "left").drop("_key", "lookup_key")


def located_by_count(df: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """Adds city, state, country, country_code by number of parts."""
    split = df.withColumn("_where", FD.location_by_count(F.col(text)))
    found = with_country(split, F.col("_where.country"), keys)
    return found.select(
        *df.columns,
        *[F.col(f"_where.{c}").alias(c) for c in ("city", "state", "country")],
        F.col("known_code").alias("country_code"),
    )


def located_with_default(df: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """Adds city, state, country, country_code; a lone unknown name is a city of the default country."""
    found = with_country(df, FD.country_candidate(F.col(text)), keys)
    return found.withColumn(
        "_where", FD.location_with_lookup(F.col(text), F.col("known_name"), F.col("known_code"))
    ).select(*df.columns, *[F.col(f"_where.{c}").alias(c) for c in ("city", "state", "country", "country_code")])


def listing_with_detail(
    listing: DataFrame, detail: DataFrame, on: str, fields: Sequence[str]
) -> DataFrame:
    """Listing rows with the non-empty value of their detail page preferred.

    ``detail`` has one row per key. Listing rows without a detail page stay.
    """
    side = detail.select(F.col(on).alias("_on"), *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = listing.join(side, listing[on] == F.col("_on"), "left")
    others = [c for c in listing.columns if c not in fields]
    merged = [
        F.coalesce(
            F.nullif(F.col(f"_d_{f}"), F.lit("")), F.col(f) if f in listing.columns else F.lit(None)
        ).alias(f)
        for f in fields
    ]
    return joined.select(*others, *merged)


def inline_records(df: DataFrame, records: Column, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record of an array column."""
    return df.select(*keep, F.inline(records))


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(v)) for f, v in defaults.items()})


def combine(sources: Sequence[DataFrame]) -> DataFrame:
    """Records of several shapes in one table; fields a shape lacks are NULL."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def greenhouse_records(
    listing_pages: DataFrame,
    detail_pages: DataFrame,
    countries: DataFrame,
    country_code: str | None = M.DEFAULT_COUNTRY_CODE,
) -> DataFrame:
    """Listing links joined to their detail pages; the country filter reads the listing.

    ``listing_pages`` has html; ``detail_pages`` has (url, html), one row per URL.
    """
    listed = listing_pages.select(F.inline(PO.greenhouse_listing(F.col("html"))))
    listed = located_with_default(
        listed.withColumn("location_text", F.coalesce("location_text", F.lit(""))), "location_text", countries
    )
    if country_code is not None:
        listed = listed.where(F.col("country_code") == country_code)
    # Fields come out while the pages are scanned, so the join carries records, not HTML.
    detail = detail_pages.select("url", F.inline(F.array(PO.greenhouse_detail(F.col("html")))))
    fields = ["title", "location_text", "job_description", "date_posted", "date_posted_text"]
    merged = listing_with_detail(
        listed.select("url", "title", "location_text"), detail, "url", fields
    )
    located = located_with_default(merged, "location_text", countries)
    values = {c: F.col(c) for c in located.columns if c in RECORD_FIELDS}
    return located.select(
        F.inline(
            F.array(
                PO.record(**{**values, "job_id": U.id_last_after(F.col("url")), "apply_url": F.col("url")})
            )
        )
    )


def smartrecruiters_records(listing_pages: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Records of the detail pages that the listings link to."""
    links = listing_pages.select(F.explode(PO.smartrecruiters_links(F.col("html"))).alias("_link"))
    # Fields come out while the pages are scanned, so the join carries records, not HTML.
    detail = detail_pages.select(F.inline(F.array(PO.smartrecruiters_detail(F.col("html"), F.col("url")))))
    # Both sides grow with the pages and their sizes are guessed from files, so neither may be sent whole to every executor.
    return links.hint("merge").join(detail, F.col("_link") == F.col("url"), "inner").drop("_link")


def generic_records(detail_pages: DataFrame, countries: DataFrame) -> DataFrame:
    """Records of detail pages of unknown make, one row per page."""
    fields = detail_pages.select(F.inline(F.array(PO.generic_detail(F.col("html"), F.col("url")))))
    located = located_by_count(fields, "location_text", countries)
    return located.select(
        F.inline(F.array(PO.record(**{c: F.col(c) for c in located.columns if c in RECORD_FIELDS})))
    )
