"""Signals in raw markup, as native column expressions; null markup counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.urls import let


def _in(html: Column, pattern: str) -> Column:
    return F.coalesce(html, F.lit("")).rlike(f"(?iU){pattern}")


def _count(html: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(f"(?iU){pattern}"))


def named(html: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(_in(html, p), F.lit(n)) for n, p in patterns.items())))


def frameworks(html: Column) -> Column:
    return named(html, fixed.FRAMEWORKS)


def state_blobs(html: Column) -> Column:
    return named(html, fixed.STATE_BLOBS)


def empty_mount(html: Column) -> Column:
    return _in(html, fixed.EMPTY_MOUNT) | _in(html, fixed.CLOSED_MOUNT)


def skeletons(html: Column) -> Column:
    return _count(html, fixed.SKELETON)


def lazy_markers(html: Column) -> Column:
    return _count(html, fixed.LAZY)


def client_routing(html: Column) -> Column:
    return _in(html, fixed.HASH_ROUTE) & _in(html, fixed.CLIENT_ROUTER)


def attributes(tag: Column) -> Column:
    """Map of a tag's key="value" attributes, the last of equal keys; bare attributes aren't seen."""
    pairs = F.regexp_extract_all(tag, F.lit(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(0))
    entry = lambda p: F.struct(
        F.lower(F.trim(F.regexp_extract(p, r"^([\w:-]+)", 1))).alias("k"),
        F.regexp_replace(F.regexp_extract(p, r"=\s*([\s\S]*)$", 1), r"^[\"']|[\"']$", "").alias("v"),
    )
    entries = F.transform(F.coalesce(pairs, F.array().cast("array<string>")), entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def image_counts(html: Column) -> Column:
    """(images, unsized): images, and those without both dimensions or an aspect ratio."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    sized = lambda t: (t.rlike(r"(?i)\bwidth\s*=") & t.rlike(r"(?i)\bheight\s*=")) | t.rlike("(?i)aspect-ratio")
    return F.struct(F.size(tags).alias("images"), F.size(F.filter(tags, lambda t: ~sized(t))).alias("unsized"))


def head_counts(html: Column) -> Column:
    """(sync_scripts, stylesheets) of the head: up to </head>, else of the first 8,000 characters."""
    all_ = F.coalesce(html, F.lit(""))
    end = F.locate("</head>", F.lower(all_))
    head = F.when(end > 0, F.substring(all_, F.lit(1), end - 1)).otherwise(F.substring(all_, 1, 8000))
    scripts = F.filter(
        F.regexp_extract_all(head, F.lit(r"(?i)<script\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"(?i)\bsrc\s*=") & ~t.rlike(r"(?i)\b(?:async|defer)\s*=|type\s*=\s*[\"']module"),
    )
    sheets = F.filter(F.regexp_extract_all(head, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?stylesheet"))
    return F.struct(F.size(scripts).alias("sync_scripts"), F.size(sheets).alias("stylesheets"))


def forms(html: Column) -> Column:
    """(fields, unlabelled, required) of each of the first forms with a field; a form that isn't closed
    reaches to the end."""
    all_ = F.coalesce(html, F.lit(""))
    closed = F.regexp_extract_all(all_, F.lit(r"(?is)<form\b[^>]*>(.*?)</form\s*>"), F.lit(1))
    rest = F.when(all_.rlike(r"(?i)<form\b[^>]*>"), F.array(F.regexp_extract(all_, r"(?is)<form\b[^>]*>(.*)$", 1))).otherwise(F.array().cast("array<string>"))
    blocks = F.slice(F.when(F.size(closed) > 0, closed).otherwise(rest), 1, fixed.MOST_FORMS)

    def counted(block: Column) -> Column:
        labels = F.regexp_extract_all(block, F.lit(r"(?i)<label\b[^>]*\bfor\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
        tags = F.regexp_extract_all(block, F.lit(r"(?i)<(?:input|select|textarea)\b[^>]*>"), F.lit(0))

        def field(tag: Column) -> Column:
            some = lambda a, *names: F.array_max(F.array(*(F.coalesce(a[n], F.lit("")) != "" for n in names)))
            read = lambda a: F.struct(
                ((~tag.rlike("(?i)^<input") | ~F.lower(F.coalesce(a["type"], F.lit("text"))).isin(*fixed.NO_FIELDS)) & a["hidden"].isNull()).alias("field"),
                (a["required"].isNotNull() | F.coalesce(a["aria-required"] == "true", F.lit(False))).alias("required"),
                (F.coalesce(F.array_contains(labels, a["id"]), F.lit(False)) | some(a, "aria-label", "aria-labelledby", "placeholder", "title")).alias("labelled"),
            )
            return let(attributes(tag), read)

        def sums(found: Column) -> Column:
            size = lambda keep: F.size(F.filter(found, lambda f: f["field"] & keep(f)))
            return F.struct(size(lambda f: F.lit(True)).alias("fields"), size(lambda f: ~f["labelled"]).alias("unlabelled"), size(lambda f: f["required"]).alias("required"))

        return let(F.transform(tags, field), sums)

    return F.filter(F.transform(blocks, counted), lambda f: f["fields"] > 0)


def layers_before(html: Column) -> Column:
    """(strong, weak): names of the signs that something stands before the page."""
    return F.struct(named(html, fixed.STRONG_LAYERS).alias("strong"), named(html, fixed.WEAK_LAYERS).alias("weak"))


def breadcrumb(html: Column) -> Column:
    return _in(html, fixed.BREADCRUMB)
