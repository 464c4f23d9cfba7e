"""Families of hosts, and normal forms of names, telephone numbers and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed

# Fixed value: words of legal form that names are compared without.
LEGAL_FORMS = "inc|llc|ltd|limited|corp|corporation|gmbh|bv|plc|co|sa|ag"


def host_family(host: Column) -> Column:
    """The first family one of whose suffixes ends the host, with or without a dot before it."""
    h = F.regexp_replace(F.lower(host), "^www\\.", "")
    out = F.when(host.isNull(), F.lit(None).cast("string"))
    for name, pattern in family_patterns():
        out = out.when(h.rlike(pattern), name)
    return out.otherwise("other")


def family_patterns() -> list[tuple[str, str]]:
    """One pattern a family: a suffix at the host's end, or the host itself without the suffix's first dot."""
    quoted = [(name, [s.replace(".", r"\.") for s in suffixes]) for name, suffixes in fixed.HOST_FAMILIES]
    return [(name, "(?:" + "|".join([*q, *("^" + s.removeprefix(r"\.") for s in q if s.startswith(r"\."))]) + ")$") for name, q in quoted]


def name_form(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b(?:{LEGAL_FORMS})\b", " "), " +", " "))


def phone_form(phone: Column) -> Column:
    return F.right(F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", ""), F.lit(10))


def bare_type(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/#:]*)$", 1)
