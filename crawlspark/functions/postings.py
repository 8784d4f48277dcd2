"""Source shapes read into array<struct> of the flat record fields.

Each reader turns one stored payload into its records inside the row; the operators
``inline`` the array, so a listing is never gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crawlspark import markers as M
from crawlspark.functions import fields as FD
from crawlspark.functions import html as H
from crawlspark.functions import payload as J
from crawlspark.functions import urls as U
from crawlspark.functions.binding import let
from crawlspark.functions.jsontext import valid_json
from crawlspark.schema import RECORD_FIELDS


def record(**values: Column) -> Column:
    """struct of all record fields in order; fields not given are NULL text."""
    return F.struct(
        *[
            (values[f].cast("string") if f in values else F.lit(None).cast("string")).alias(f)
            for f in RECORD_FIELDS
        ]
    )


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _filled(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


# --- JSON -------------------------------------------------------------------

_WORKDAY = (
    "struct<title:string,externalPath:string,bulletFields:array<string>,"
    "locationsText:string,postedOn:string>"
)
_LEVER = (
    "struct<id:string,text:string,hostedUrl:string,applyUrl:string,"
    "categories:struct<location:string,commitment:string,workplaceTypes:string>,postedAt:string>"
)


def workday(json: Column, base_url: Column) -> Column:
    """Records of a search answer whose list sits at the root, in ``jobs`` or in a member."""

    def one(r: Column) -> Column:
        where = FD.location_first_word(r["locationsText"])
        return let(
            where,
            lambda w: record(
                title=r["title"],
                job_id=F.try_element_at(r["bulletFields"], F.lit(1)),
                city=w["city"],
                country=w["country"],
                country_code=F.when(w["country"].isNotNull(), M.DEFAULT_COUNTRY_CODE),
                url=F.when(_filled(r["externalPath"]).isNotNull(), F.concat(base_url, r["externalPath"])),
                date_posted=FD.iso_date(r["postedOn"]),
                date_posted_text=_filled(r["postedOn"]),
            ),
        )

    items = F.transform(J.record_list_at_root(json), lambda i: F.from_json(i, _WORKDAY))
    return F.transform(items, one)


def lever_feed(json: Column) -> Column:
    """Records of a JSON feed; text that is not a JSON array has none."""

    def one(r: Column) -> Column:
        parts = FD.comma_parts(_filled(r["categories"]["location"]))
        return record(
            job_id=r["id"],
            title=r["text"],
            url=r["hostedUrl"],
            apply_url=r["applyUrl"],
            city=F.try_element_at(parts, F.lit(1)),
            state=F.try_element_at(parts, F.lit(2)),
            country=F.lit(M.DEFAULT_COUNTRY),
            country_code=F.lit(M.DEFAULT_COUNTRY_CODE),
            employment_type=r["categories"]["commitment"],
            work_type=r["categories"]["workplaceTypes"],
            date_posted=FD.iso_date(r["postedAt"]),
            date_posted_text=_filled(r["postedAt"]),
        )

    entries = F.from_json(valid_json(json), f"array<{_LEVER}>")
    return F.transform(entries, one)


# --- HTML -------------------------------------------------------------------


def lever_page(html: Column) -> Column:
    """Records of an HTML listing: one element per posting."""

    def one(page: Column, start: Column) -> Column:
        return let(H.inside(page, start), lambda block: fields(block, start))

    def fields(block: Column, start: Column) -> Column:
        work = H.text_in(block, "span", H.class_condition("workplaceTypes"))
        return let(
            let(H.text_in(block, "span", H.class_condition("location")), lambda t: FD.comma_parts(t)),
            lambda parts: record(
                job_id=H.attribute(start["piece"], "data-qa-posting-id"),
                title=H.text_in(block, "h5", H.attr_condition("data-qa", "posting-name")),
                url=H.attribute_in(block, "a", "href", H.class_condition("posting-title")),
                apply_url=H.attribute_in(block, "a", "href", H.class_condition("posting-btn-submit")),
                city=F.try_element_at(parts, F.lit(1)),
                state=F.try_element_at(parts, F.lit(2)),
                country=F.lit(M.DEFAULT_COUNTRY),
                country_code=F.lit(M.DEFAULT_COUNTRY_CODE),
                employment_type=H.text_in(block, "span", H.class_condition("commitment")),
                work_type=_trim(F.regexp_replace(work, "[—\\- ]+$", "")),
            ),
        )

    return let(H.tokens(html), lambda page: F.transform(H.openings(page, "div", r"data-qa-posting-id\s*="), lambda start: one(page, start)))


def listing(content: Column) -> Column:
    """Records of a listing that is a JSON feed or an HTML page, told apart by its start."""
    is_json = F.startswith(F.regexp_replace(content, r"^\s+", ""), F.lit("["))
    return F.when(is_json, lever_feed(content)).otherwise(lever_page(content))


def greenhouse_listing(html: Column) -> Column:
    """array<struct<url, title, location_text>> of links within table cells."""

    def one(block: Column) -> Column:
        return F.struct(
            H.attribute_in(block, "a", "href", r"href\s*=").alias("url"),
            H.text_in(block, "p", H.class_condition("body--medium"), " ").alias("title"),
            H.text_in(block, "p", H.class_condition("body--metadata"), " ").alias("location_text"),
        )

    def rows(page: Column) -> Column:
        return F.transform(H.openings(page, "td", H.class_condition("cell")), lambda start: let(H.inside(page, start), one))

    return F.filter(let(H.tokens(html), rows), lambda r: F.coalesce(r["url"], F.lit("")) != "")


def greenhouse_detail(html: Column) -> Column:
    """struct of the fields of a detail page; texts are joined with one blank."""

    def fields(page: Column) -> Column:
        place = H.inside(page, H.opening(page, "div", H.class_condition("job__location")))
        stamp = _trim(H.attribute_in(page, "meta", "content", H.attr_condition("name", "date")))

        def described(body: Column) -> Column:
            paragraphs = F.transform(H.openings(body, "p"), lambda p: F.coalesce(H.text(H.inside(body, p), " "), F.lit("")))
            return let(paragraphs, lambda ps: F.when(F.size(ps) > 0, F.array_join(ps, "\n")).otherwise(H.text(body, " ")))

        date_text = F.coalesce(_filled(stamp), H.text_in(page, "time", joiner=" "))
        return let(
            date_text,
            lambda date: F.struct(
                H.text_in(page, "h1", H.class_condition("section-header"), " ").alias("title"),
                let(place, lambda block: H.text_in(block, "div", joiner=" ")).alias("location_text"),
                let(H.inside(page, H.opening(page, "div", H.class_condition("job__description"))), described).alias("job_description"),
                date.alias("date_posted_text"),
                FD.iso_date(date).alias("date_posted"),
            ),
        )

    return let(H.tokens(html), fields)


def smartrecruiters_links(html: Column) -> Column:
    """Hrefs of the job-ad links of a listing, in order."""
    tags = let(H.tokens(html), lambda page: H.openings(page, "a", H.class_condition("js-job-ad-link")))
    return F.filter(F.transform(tags, lambda t: H.attribute(t["piece"], "href")), lambda h: F.coalesce(h, F.lit("")) != "")


def smartrecruiters_detail(html: Column, url: Column) -> Column:
    posted = H.attr_condition("itemprop", "datePosted")

    def fields(page: Column) -> Column:
        parts = F.struct(
            H.opening(page, "spl-job-location")["piece"].alias("place"),
            H.text_in(page, "time", posted).alias("date_text"),
            H.attribute_in(page, "time", "datetime", posted).alias("stamp"),
        )
        return let(parts, lambda part: let(let(_filled(H.attribute(part["place"], "formattedaddress")), lambda t: FD.location_by_position(t)), lambda where: one(page, part, where)))

    def one(page: Column, part: Column, where: Column) -> Column:
        return record(
            title=H.text_in(page, "h1", H.attr_condition("itemprop", "title")),
            job_id=U.id_before_dash(url),
            city=where["city"],
            state=where["state"],
            country=where["country"],
            url=url,
            apply_url=url,
            date_posted=let(F.coalesce(_filled(part["stamp"]), part["date_text"]), lambda t: FD.iso_date(t)),
            date_posted_text=part["date_text"],
            job_description=H.text_in(page, "div", H.attr_condition("itemprop", "description")),
            employment_type=H.text_in(page, "li", H.attr_condition("itemprop", "employmentType")),
            work_type=H.attribute(part["place"], "workplacetype"),
        )

    return let(H.tokens(html), fields)


# Opening tags that hold a field on a detail page of unknown make.
def _by_class(*names: str, tag: str = r"[A-Za-z][^\s/>]*") -> str:
    return "^" + H.having(H.class_condition("|".join(names)), tag)


GENERIC_TAGS = {
    "title": r"^<h[12][\s/>]|" + _by_class("job-title", "title"),
    "job_description": "|".join(
        [
            _by_class("job-description", "description"),
            "^" + H.having(H.id_condition("jobDescription")),
            "^" + H.having(H.attr_condition("data-test", "jobDescription"), "div"),
            _by_class("job-details", tag="section"),
        ]
    ),
    "date_posted_text": r"^<time[\s/>]|" + _by_class("date-posted", "posted-date")
    + "|^" + H.having(H.attr_condition("property", "article:published_time"), "meta"),
    "employment_type": _by_class("employment-type", "employmentType", "job-type"),
    "work_type": _by_class("work-type", "workType", "location-type", "job-location-type"),
    "salary_range": _by_class("salary-range", "salary", "compensation", "pay-range"),
    "location_text": _by_class("location", "job-location", "city-state-country"),
    "apply_tag": _by_class("apply", "btn-apply", tag="a")
    + "|^" + H.having(H.attr_condition("data-test", "applyButton"), "a") + "|^" + H.having(H.attr_condition("data-qa", "apply"), "a"),
    "page_title": r"^<title[\s/>]",
}
_TELLING_TAGS = ("h1", "h2", "time", "title")


def generic_detail(html: Column, url: Column) -> Column:
    """struct of the fields of a detail page; location still as text.

    Each field takes the first tag, in page order, that fits any of its alternatives; tags without an
    attribute, other than headings, times and titles, fit none and are left out first.
    """

    def first(tags: Column, name: str) -> Column:
        return F.try_element_at(F.filter(tags, lambda t: t["piece"].rlike("(?is)" + GENERIC_TAGS[name])), F.lit(1))

    def fields(page: Column, found: Column) -> Column:
        def text(name: str) -> Column:
            return H.text(H.inside(page, found[name]))

        date_tag = found["date_posted_text"]
        date_text = F.when(date_tag["name"] == "meta", _filled(_trim(H.attribute(date_tag["piece"], "content")))).otherwise(text("date_posted_text"))
        apply_href = F.coalesce(H.attribute(found["apply_tag"]["piece"], "href"), F.lit(""))
        return let(
            date_text,
            lambda date: F.struct(
                url.alias("url"),
                F.coalesce(text("title"), text("page_title")).alias("title"),
                U.id_after(url).alias("job_id"),
                F.when(found["apply_tag"].isNotNull(), let(apply_href, lambda href: U.resolve(url, href))).alias("apply_url"),
                date.alias("date_posted_text"),
                FD.iso_date(date).alias("date_posted"),
                *[
                    text(n).alias(n)
                    for n in ("job_description", "employment_type", "work_type", "salary_range", "location_text")
                ],
            ),
        )

    def chosen(page: Column) -> Column:
        opens = page_tags(page)
        firsts = let(opens, lambda tags: F.struct(*[first(tags, n).alias(n) for n in GENERIC_TAGS]))
        return let(firsts, lambda found: fields(page, found))

    def page_tags(page: Column) -> Column:
        return F.filter(
            page,
            lambda t: t["name"].isin(*_TELLING_TAGS)
            | (F.startswith(t["piece"], F.lit("<")) & F.contains(t["piece"], F.lit("=")) & ~t["name"].isin("", "!", "?", "/", "script", "style")),
        )

    return let(H.tokens(html), chosen)


def link_record(title: Column, href: Column) -> Column:
    """A record of which only the link is known."""
    return record(
        title=_filled(_trim(title)), job_id=U.id_first_number(href), url=href, apply_url=href
    )
