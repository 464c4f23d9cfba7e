"""Dates of pages and sitemaps; the present moment is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W3C = {
    r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:?\d{2}$": "yyyy-MM-dd'T'HH:mm:ssxx", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}[+-]\d{2}:?\d{2}$": "yyyy-MM-dd'T'HH:mmxx", r"^\d{4}-\d{2}$": "yyyy-MM", r"^\d{4}$": "yyyy",
}


def w3c_date(raw: Column) -> Column:
    """(parsed, valid) of a sitemap's lastmod in the six W3C forms; empty is valid without a date, and
    without a zone it is UTC (the session's zone is to be UTC)."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    zoned = F.regexp_replace(F.replace(text, F.lit("Z"), F.lit("+0000")), r"([+-]\d{2}):(\d{2})$", "$1$2")
    parsed = F.lit(None).cast("timestamp")
    for shape, form in W3C.items():
        parsed = F.coalesce(parsed, F.when(zoned.rlike(shape), F.try_to_timestamp(zoned, F.lit(form))))
    return F.struct(parsed.alias("parsed"), ((text == "") | parsed.isNotNull()).alias("valid"))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
CLOCK = r"(\d{1,2}):(\d{1,2}):(\d{1,2})"
#: shape, and the groups that hold year, month and day; in the order in which they are tried
SHAPES = (
    (r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", 1, 3, 4),
    (r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", 3, 2, 1),
    (r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$", 3, 1, 2),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1),
    (r"^(\d{4})-(\d{1,2})()$", 1, 2, 3),
    (r"^(\d{4})()()$", 1, 2, 3),
)
MAIL = rf"^[A-Za-z]{{3}}, (\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {CLOCK} (UTC|GMT|Z|[+-]\d{{2}}:?\d{{2}})$"


def _month(text: Column) -> Column:
    """Two digits of a month's number, full name or first three letters; '01' for nothing."""
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(text))
    short = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.lower(text))
    number = F.when(text == "", F.lit("1")).when(text.rlike(r"^\d+$"), text).otherwise(F.greatest(named, short).cast("string"))
    return F.lpad(number, 2, "0")


def parse_date(raw: Column) -> Column:
    """The moment of a date: ISO forms first, then the fixed shapes in order. Texts without a zone are UTC,
    those shorter than four characters none. ISO week and ordinal dates aren't read."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    iso = F.regexp_replace(F.regexp_replace(text, r"^(\S{10})[T ](\d{2}):?(\d{2})?:?(\d{2})?", "$1T$2:$3:$4"), r":(?=:|$|[Z+-])", ":00")
    iso = F.regexp_replace(F.replace(F.regexp_replace(iso, r"::", ":00:"), F.lit(","), F.lit(".")), r"([+-]\d{2})(?::?(\d{2}))?$", "$1:$2")
    zoned = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")),
    ).when(iso.rlike("(?:Z|[+-]\\d{2}:\\d{2})$"), iso).when(iso.rlike("[+-]\\d{2}:$"), F.concat(iso, F.lit("00"))).otherwise(F.concat(iso, F.lit("Z")))
    found = [F.when(text.rlike(ISO), zoned.try_cast("timestamp"))]
    for shape, year, month, day in SHAPES:
        part = lambda k, shape=shape: F.regexp_extract(text, shape, k)
        days = F.when(part(day) == "", "01").otherwise(F.lpad(part(day), 2, "0"))
        found.append(F.when(text.rlike(shape), F.concat(part(year), F.lit("-"), _month(part(month)), F.lit("-"), days, F.lit("T00:00:00Z")).try_cast("timestamp")))
    part = lambda k: F.regexp_extract(text, MAIL, k)
    two = lambda k: F.lpad(part(k), 2, "0")
    zone = F.when(part(7).rlike("^[A-Z]"), "Z").otherwise(F.regexp_replace(part(7), r"^(...):?(..)$", "$1:$2"))
    mail = F.concat(part(3), F.lit("-"), _month(part(2)), F.lit("-"), two(1), F.lit("T"), two(4), F.lit(":"), two(5), F.lit(":"), two(6), zone)
    found.append(F.when(text.rlike(MAIL), mail.try_cast("timestamp")))
    return F.when(F.length(text) >= 4, F.coalesce(*found))


def age_days(moment: Column, now: Column) -> Column:
    """Whole periods of 24 hours that have passed."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(moment)) / 86400)


def header(headers: Column, name: str) -> Column:
    """A header by name, whatever its case; null if absent."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name.lower())), F.lit(0))
