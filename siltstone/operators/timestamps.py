"""Timestamps of mixed formats, precisions and zones, brought to one UTC instant.

A value's instant depends on three things only: the raw text, the zone its writer lives in and the
writer's locale. The distinct triples therefore form a dictionary that is parsed once, kept as a
Parquet table that later runs extend, and joined back to the rows.

Defined results: null, blank, impossible and non-date texts have a null instant and an empty format;
repeated rows keep their number; an unknown or null zone makes texts without an offset of their own
undeterminable; an empty table gives an empty table; columns other than the three named are kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import discard, scratch_dir, shared_folder, written

# Month names by language.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
}
# Short forms that are no prefix of exactly one month's names in all languages.
SHORT_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12, "mär": 3,
    "mrt": 3, "mai": 5, "mei": 5, "okt": 10, "dez": 12, "fév": 2, "févr": 2, "avr": 4, "juil": 7, "déc": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
    "fev": 2, "set": 9, "out": 10, "gen": 1, "mag": 5, "giu": 6, "lug": 7, "ott": 10,
}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MONTHS = SHORT_MONTHS | {n: i for names in MONTH_NAMES.values() for i, n in enumerate(names.split(), 1)}

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICRO = 1_000_000
#: raised when what a form means changes
VERSION = 2

DATE = r"(?P<Y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})"
CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap]\.?m\.?))?(?:\s*(?:uhr|h))?"
ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?)|\s*(?P<abbr>[a-z]{1,5}))?(?:\s*\[(?P<zone>[A-Za-z0-9_+/-]+)\])?"
NAME = r"(?P<mon>[^\W\d_]{3,10})"

#: Every written form, each tried on the whole text; the name is reported with the instant.
FORMS = [
    (name, re.compile(pattern, re.IGNORECASE))
    for name, pattern in (
        ("digits", r"(?P<n>\d+)"),
        ("decimal_epoch", r"(?P<n>\d{9,10})\.(?P<nf>\d{1,9})"),
        ("year_first", DATE + r"(?:(?:\s*t\s*|\s+|\s*,\s*)" + CLOCK + ZONE + ")?"),
        ("year_month", r"(?P<Y>\d{4})[-/.](?P<m>\d{1,2})"),
        ("ordinal", r"(?P<Y>\d{4})-(?P<j>\d{3})(?:t" + CLOCK + ZONE + ")?"),
        ("iso_week", r"(?P<Y>\d{4})-?w(?P<w>\d{2})(?:-?(?P<wd>[1-7]))?"),
        ("basic", r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t(?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?" + ZONE),
        ("year_last", r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<Y>\d{4})(?:(?:\s*,\s*|\s+|t)" + CLOCK + ZONE + ")?"),
        ("mail", r"(?:(?P<wn>[a-z]{3,9})\.?,?\s+)?(?P<d>\d{1,2})[\s-]" + NAME + r"\.?[\s-](?P<Y>\d{4})\s+" + CLOCK + ZONE),
        ("day_name_year", r"(?:(?P<wn>[^\W\d_]{2,10})\.?,?\s+)?(?P<d>\d{1,2})(?:\.|er|st|nd|rd|th|º)?\s+(?:de\s+|of\s+)?" + NAME + r"\.?,?\s+(?:de\s+|del\s+)?(?P<Y>\d{4})(?:(?:\s*,\s*|\s+)(?:(?:à|um|om|at|alle|às|a las)\s+)?(?:(?P<Hh>\d{1,2})h(?P<Mh>\d{2})?|" + CLOCK + ZONE + "))?"),
        ("name_day_year", r"(?:(?P<wn>[a-z]{3,9})\.?,?\s+)?" + NAME + r"\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<Y>\d{4})(?:(?:\s*,\s*|\s+)(?:at\s+)?" + CLOCK + ZONE + ")?"),
        ("asctime", r"(?P<wn>[a-z]{3})\s+" + NAME + r"\s+(?P<d>\d{1,2})\s+" + CLOCK + r"(?:\s+(?P<abbr2>[a-z]{2,5}))?\s+(?P<Y>\d{4})"),
    )
]


@lru_cache(maxsize=4096)
def zone_of(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def letters_of(name: str) -> dict[str, int]:
    """Offset in seconds of each letter code that the zone itself uses, the latest use first."""
    zone, out = zone_of(name), {}
    for year in range(2037, 1969, -1):
        for month in range(1, 13):
            at = datetime(year, month, 15, 12, tzinfo=zone)
            out.setdefault((at.tzname() or "").upper(), round(at.utcoffset().total_seconds()))
    return out


def _fraction(digits: str | None) -> int:
    return int((digits or "0")[:6].ljust(6, "0"))


def _moment(form: str, g: dict, tz: str | None, locale: str | None) -> int | None:
    """Microseconds since 1970 of one match; ValueError or None where it names no moment."""
    if "n" in g and g["n"]:
        n, k = g["n"], len(g["n"])
        if form == "decimal_epoch":
            return int(n) * MICRO + _fraction(g["nf"])
        if k == 4:
            g = {"Y": n}
        elif k == 8:
            g = {"Y": n[:4], "m": n[4:6], "d": n[6:]}
        elif k in (12, 14) and n[:2] in ("19", "20") and (k == 14 or int(n[4:6]) in range(1, 13)):
            g = {"Y": n[:4], "m": n[4:6], "d": n[6:8], "H": n[8:10], "M": n[10:12], "S": n[12:]}
        else:
            scale = {9: MICRO, 10: MICRO, 12: 1000, 13: 1000, 15: 1, 16: 1}.get(k)
            return int(n) * scale if scale else int(n) // 1000 if k in (18, 19) else None
    year, get = int(g["Y"]), g.get
    month, day = int(get("m") or 1), int(get("d") or 1)
    if get("mon"):
        month = MONTHS[g["mon"].lower()]
    if get("a"):
        first, second = int(g["a"]), int(g["b"])
        month, day = (first, second) if (locale or "").replace("_", "-").lower() == "en-us" else (second, first)
    if get("j"):
        at = date(year, 1, 1) + timedelta(days=int(g["j"]) - 1)
        if at.year != year or g["j"] == "000":
            return None
        month, day = at.month, at.day
    if get("w"):
        at = date.fromisocalendar(year, int(g["w"]), int(get("wd") or 1))
        year, month, day = at.year, at.month, at.day
    if year < 1000:
        return None
    hour, minute, second = int(get("H") or get("Hh") or 0), int(get("M") or get("Mh") or 0), int(get("S") or 0)
    if get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"][0] in "pP")
    later = timedelta()
    if hour == 24 and minute == 0 and second == 0 and not get("ap"):
        hour, later = 0, timedelta(days=1)
    if second == 60:
        second, later = 59, later + timedelta(seconds=1)
    wall = datetime(year, month, day, hour, minute, second, _fraction(get("f"))) + later
    if get("wn") and g["wn"][:3].lower() in WEEKDAYS and date(year, month, day).weekday() != WEEKDAYS.index(g["wn"][:3].lower()):
        return None
    if get("off"):
        digits = g["off"][1:].replace(":", "").ljust(4, "0")
        if int(digits[2:]) > 59 or int(digits) > 1800:
            return None
        seconds = (int(digits[:2]) * 60 + int(digits[2:])) * 60 * (-1 if g["off"][0] == "-" else 1)
    elif letters := (get("abbr") or get("abbr2") or "").upper():
        if letters in ("Z", "UTC", "GMT", "UT"):
            seconds = 0
        elif tz and zone_of(tz) and letters in (known := letters_of(tz)):
            seconds = known[letters]
        else:
            return None
    else:
        zone = zone_of(get("zone") or tz)
        if zone is None:
            return None
        # fold 0 is the first pass of a repeated hour and the earlier offset in a skipped one
        seconds = round(wall.replace(tzinfo=zone, fold=0).utcoffset().total_seconds())
    past = wall.replace(tzinfo=timezone.utc) - EPOCH
    return (past.days * 86400 + past.seconds - seconds) * MICRO + past.microseconds


def parse(raw: str | None, tz: str | None, locale: str | None) -> tuple[int | None, str]:
    """Microseconds since 1970 and the name of the form; (None, '') for what determines no moment.

    Every form is tried; should two of them read a text as different moments, it determines none.
    """
    text = (raw or "").strip().strip("﻿​ ").strip()
    if not text:
        return None, ""
    found = {}
    for form, pattern in FORMS:
        if match := pattern.fullmatch(text):
            try:
                at = _moment(form, match.groupdict(), tz, locale)
            except (ValueError, KeyError, OverflowError):
                continue
            if at is not None and abs(at) < 253_402_300_800 * MICRO:
                found.setdefault(at, form)
    return next(iter(found.items())) if len(found) == 1 else (None, "")


DICTIONARY = T.StructType([
    T.StructField("raw", T.StringType()), T.StructField("tz", T.StringType()), T.StructField("locale", T.StringType()),
    T.StructField("instant", T.TimestampType()), T.StructField("form", T.StringType()),
])


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [b.column(i).to_pylist() for i in range(3)]
        parsed = [parse(*k) for k in zip(*keys, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array([p[0] for p in parsed], pa.timestamp("us", "UTC")), pa.array([p[1] for p in parsed], pa.string())],
            ["raw", "tz", "locale", "instant", "form"],
        )


class StampDictionary:
    """The written dictionary of distinct (raw, tz, locale), without nulls. Each update adds one folder of
    new keys. Two updates at a time may both add a key; readers see it once."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_dir(spark)

    @classmethod
    def kept(cls, spark: SparkSession) -> StampDictionary:
        """The dictionary in the shared folder that every run extends. Its name has a digest of the forms, so
        that other rules or another zone database begin a new one."""
        rules = repr(([(n, p.pattern) for n, p in FORMS], sorted(MONTHS.items()), WEEKDAYS, tzdata_version(), VERSION))
        return cls(spark, f"{shared_folder(spark)}/siltstone-stamps-{hashlib.blake2b(rules.encode(), digest_size=8).hexdigest()}")

    def _folders(self) -> list[str]:
        """The updates that are whole; an interrupted one counts for nothing."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        every = [f"{self.path}/{x.getPath().getName()}" for x in files.listStatus(at) if x.isDirectory()]
        return sorted(x for x in every if files.exists(path(f"{x}/_SUCCESS")))

    def known(self) -> DataFrame | None:
        folders = self._folders()
        return self.spark.read.schema(DICTIONARY).parquet(*folders) if folders else None

    def update(self, keys: DataFrame) -> DataFrame:
        """Parses the keys (raw, tz, locale) not known yet, adds them, and returns one row a key. Each update
        writes a folder of its own, so that none disturbs another."""
        new = stamp_keys(keys).distinct()
        known = self.known()
        if known is not None:
            new = new.join(known, ["raw", "tz", "locale"], "left_anti")
        added = written(new.mapInArrow(_parse_batches, DICTIONARY), f"{self.path}/{uuid.uuid4().hex}")
        if known is not None and added.isEmpty():
            discard(added)
        return self.known().groupBy("raw", "tz", "locale").agg(F.first("instant").alias("instant"), F.first("form").alias("form"))


def stamp_keys(keys: DataFrame) -> DataFrame:
    return keys.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("raw", "tz", "locale")))


def tzdata_version() -> str:
    """Tells zone databases apart by the offsets of a few zones whose rules change often."""
    zones = ("Africa/Casablanca", "Asia/Gaza", "America/Mexico_City", "Europe/Moscow", "Asia/Amman")
    days = (datetime(y, m, 15) for y in (2015, 2021, 2022, 2023, 2025) for m in (1, 4, 7, 10))
    return repr([[d.replace(tzinfo=zone_of(z)).utcoffset() for z in zones if zone_of(z)] for d in days])


def normalise(df: DataFrame, raw: str, tz: str, locale: str, dictionary: StampDictionary | None = None) -> DataFrame:
    """df with `instant` (UTC) and `form` of the text in column raw; both replace columns so named.

    Texts without a digit name no moment and take no part in the dictionary, so the commonest fillers
    never meet the join. The join's hot keys are split by AQE (the dictionary has one row a key).
    """
    df = df.drop("instant", "form")
    dated = F.col(raw).rlike("[0-9]")
    keys = df.where(dated).select(F.col(raw).alias("raw"), F.col(tz).alias("tz"), F.col(locale).alias("locale"))
    d = (dictionary or StampDictionary(df.sparkSession)).update(keys)
    d = d.where("instant is not null").withColumnsRenamed({"raw": "_raw", "tz": "_tz", "locale": "_locale"})
    on = (F.when(dated, F.col(raw)) == F.col("_raw")) & (F.coalesce(F.col(tz), F.lit("")) == F.col("_tz")) & (F.coalesce(F.col(locale), F.lit("")) == F.col("_locale"))
    return df.join(d, on, "left").drop("_raw", "_tz", "_locale").withColumn("form", F.coalesce("form", F.lit("")))
