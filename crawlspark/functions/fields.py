"""Dates and locations of records as Column expressions."""

from __future__ import annotations

import calendar
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from crawlspark import markers as M
from crawlspark.functions.binding import let

# Absolute dates as they occur in text, and the formats that read them.
_ISO = (
    r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,6}))?)?"
    r"\s?(Z|[+-][0-9]{2}:?[0-9]{2})?)?\s*$"
)
_WORDED = (
    r"([A-Za-z]{3,9}\.? [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} [A-Za-z]{3,9}\.?,? [0-9]{4}"
    r"|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
)
_MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name}


def _iso_parts(text: Column) -> Column:
    """struct<day, time, rest> of ISO text: seconds filled in, fraction only when not zero, offset kept."""
    seconds = F.regexp_extract(text, _ISO, 3)
    fraction = F.rpad(F.regexp_extract(text, _ISO, 4), 6, "0")
    offset = F.regexp_extract(text, _ISO, 5)
    time = let(F.regexp_extract(text, _ISO, 2), lambda m: F.concat(F.when(m == "", "00:00").otherwise(m), F.lit(":"), F.when(seconds == "", "00").otherwise(seconds)))
    zone = let(offset, lambda o: F.when(o == "Z", "+00:00").otherwise(F.regexp_replace(o, "^([+-][0-9]{2})([0-9]{2})$", "$1:$2")))
    micros = let(fraction, lambda f: F.when(f.rlike("[1-9]"), F.concat(F.lit("."), f)).otherwise(""))
    return F.struct(F.regexp_extract(text, _ISO, 1).alias("day"), time.alias("time"), F.concat(micros, zone).alias("rest"))


def _worded_parts(text: Column) -> Column:
    """The same struct of the first date in words or figures; the shape tells which part is what."""
    months = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])

    def day(t: Column) -> Column:
        named = F.concat_ws("-", F.right(t, F.lit(4)), F.coalesce(F.try_element_at(months, F.lower(F.regexp_extract(t, "[A-Za-z]+", 0))).cast("string"), F.lit("none")), F.regexp_extract(t, "[0-9]+", 0))
        figures = F.regexp_replace(F.regexp_replace(t, "^([0-9]{4})/([0-9]{1,2})/", "$1-$2-"), "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2")
        return F.when(t.rlike("[A-Za-z]"), named).otherwise(figures)

    found = F.regexp_replace(F.regexp_extract(text, _WORDED, 1), r"[.,]", "")
    return F.struct(let(found, day).alias("day"), F.lit("00:00:00").alias("time"), F.lit("").alias("rest"))


def iso_date(text: Column) -> Column:
    """ISO form of an absolute date within the text, else NULL.

    "3 days ago" has no date of its own, so relative text stays NULL and the raw text is
    what remains. The text's shape gives year, month and day; one parse then tells whether there is such a day.
    """

    def known(part: Column) -> Column:
        stamp = F.try_to_timestamp(F.concat(part["day"], F.lit(" "), part["time"]), F.lit("yyyy-M-d HH:mm:ss"))
        return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), part["rest"])

    return let(text, lambda t: let(F.when(t.rlike(_ISO), _iso_parts(t)).when(t.rlike(_WORDED), _worded_parts(t)), known))


# --- locations --------------------------------------------------------------


def comma_parts(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def _location(city: Column, state: Column, country: Column) -> Column:
    return F.struct(city.alias("city"), state.alias("state"), country.alias("country"))


def location_by_count(text: Column) -> Column:
    """Three parts are city, state, country; two city, country; one country; else nothing."""
    none = F.lit(None).cast("string")

    def split(parts: Column) -> Column:
        n = F.size(parts)
        return (
            F.when(n == 3, _location(parts[0], parts[1], parts[2]))
            .when(n == 2, _location(parts[0], none, parts[1]))
            .when(n == 1, _location(none, none, parts[0]))
            .otherwise(_location(none, none, none))
        )

    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, _location(none, none, none)).otherwise(let(comma_parts(text), split))


def location_by_position(text: Column) -> Column:
    """City, state and country by position; what is missing is NULL."""
    return let(
        comma_parts(text),
        lambda p: _location(*[F.try_element_at(p, F.lit(i)) for i in (1, 2, 3)]),
    )


def location_first_word(
    text: Column,
    cities: Sequence[str] = M.DEFAULT_COUNTRY_CITIES,
    country: str = M.DEFAULT_COUNTRY,
) -> Column:
    """First word of the first part is the city; a listed city implies the country."""
    head = F.regexp_replace(F.substring_index(text, ",", 1), r"^\s+|\s+$", "")
    word = F.regexp_extract(head, r"^(\S+)", 1)
    none = F.lit(None).cast("string")
    return let(
        F.when(word != "", word),
        lambda c: _location(c, none, F.when(c.isin(*cities), country)),
    )


def country_candidate(text: Column) -> Column:
    """The part that may name a country: behind the first comma, else the whole text."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    rest = F.regexp_replace(F.regexp_extract(trimmed, r"(?s)^[^,]*,(.*)$", 1), r"^\s+|\s+$", "")
    return F.when(F.contains(trimmed, F.lit(",")), rest).otherwise(trimmed)


def location_with_lookup(
    text: Column,
    known_name: Column,
    known_code: Column,
    country: str = M.DEFAULT_COUNTRY,
    code: str = M.DEFAULT_COUNTRY_CODE,
) -> Column:
    """struct<city, state, country, country_code> given the lookup of ``country_candidate``.

    Without a comma the text is a country if known and a city otherwise; a city alone
    belongs to the default country.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    comma = F.contains(trimmed, F.lit(","))
    head = F.regexp_replace(F.substring_index(trimmed, ",", 1), r"^\s+|\s+$", "")
    city = F.when(comma, F.nullif(head, F.lit(""))).when(
        known_name.isNull(), F.nullif(trimmed, F.lit(""))
    )
    named = F.when(comma, F.nullif(country_candidate(text), F.lit(""))).otherwise(known_name)
    defaulted = city.isNotNull() & named.isNull()
    return F.struct(
        city.alias("city"),
        F.lit(None).cast("string").alias("state"),
        F.when(defaulted, country).otherwise(named).alias("country"),
        F.when(defaulted, code).when(named.isNotNull(), known_code).alias("country_code"),
    )
