"""Marker counts and other functions of texts, as native column expressions.

Patterns are matched with Unicode classes and without regard to case. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.urls import let


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?iU){pattern}"))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?iU){pattern}")


def genre_counts(text: Column) -> list[Column]:
    """One count a genre, and the marketing hedges."""
    return [*(count_of(text, p).alias(f"n_{name}") for name, (p, _) in fixed.GENRES.items()), count_of(text, fixed.HEDGE).alias("n_hedge")]


def genres(names: tuple[str, ...]) -> Column:
    """Those of the genres whose count, in columns n_..., reaches its threshold."""
    return F.array_compact(F.array(*(F.when(F.col(f"n_{g}") >= fixed.GENRES[g][1], F.lit(g)) for g in names)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def word_band(words: Column) -> Column:
    """The bin of a word count, as 'low-high', with its mean influence."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("band"), F.lit(0.0).alias("influence")))
    for low, high, influence in fixed.WORD_BINS:
        out = out.when(words.between(low, high), F.struct(F.lit(f"{low}-{high}" if high < 10**9 else ">3000").alias("band"), F.lit(influence).alias("influence")))
    return out.otherwise(F.struct(F.lit("unknown").alias("band"), F.lit(None).cast("double").alias("influence")))


def quartile(metric: str, value: Column) -> Column:
    low, high = fixed.QUARTILES[metric]
    return F.when(value <= low, "bottom_quartile").when(value >= high, "top_quartile").otherwise("mid_range")


def claims(text: Column, least: int = 25, most: int = 400, keep: int = 12) -> Column:
    """Up to `keep` sentences of suitable length with a statistic or else a superlative, as (kind, sentence)."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?U:\s+)|\n+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    kind = lambda s: F.when(has(s, fixed.STATISTIC), "statistic").when(has(s, fixed.SUPERLATIVE), "superlative")
    sized = F.filter(parts, lambda s: F.length(s).between(least, most))
    found = F.filter(F.transform(sized, lambda s: F.struct(kind(s).alias("kind"), s.alias("sentence"))), lambda c: c["kind"].isNotNull())
    return F.slice(found, 1, keep)


def text_dates(text: Column, keep: int = 5) -> Column:
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iU){fixed.TEXT_DATE}"), F.lit(0)), 1, keep)


def snippet(text: Column, size: int) -> Column:
    """White space collapsed; longer texts cut to size, the last character an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…")))


def lead(text: Column, words: int = 150) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""), 1, words), " ")


def boilerplate_ratio(main: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.greatest(F.lit(0.0), (total - main) / total), 4)).otherwise(0.0)


def update_language(text: Column) -> Column:
    return has(text, fixed.UPDATE_LANGUAGE)


def lead_signals(text: Column) -> Column:
    """(lead_words, marketing, evidence) of the first words."""
    counts = lambda t: F.struct(
        word_count(t).alias("lead_words"), count_of(t, fixed.MARKETING).alias("marketing"),
        (count_of(t, fixed.DEFINITION) + count_of(t, fixed.NUMERIC) + count_of(t, fixed.COMPARISON)).alias("evidence"),
    )
    return let(lead(text, fixed.LEAD_WORDS), counts)


def soft_404(title: Column, words: Column, text: Column) -> Column:
    """Whether the title, or the first 1,200 characters of a short text, say that nothing is there."""
    return has(title, fixed.SOFT_404) | ((words < 120) & has(F.substring(text, 1, 1200), fixed.SOFT_404))


def with_examples(text: Column, urls: Column, limit: int = 3) -> Column:
    """The text with its first examples and how many more there are."""
    shown = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")) != "")
    first, more = F.slice(shown, 1, limit), F.size(urls) - limit
    tail = F.when(F.size(shown) > limit, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(first) == 0, text).otherwise(F.concat(text, F.lit(" (e.g. "), F.array_join(first, ", "), tail, F.lit(")")))


def ambiguous_brand(token: Column, words: tuple[str, ...] = ()) -> Column:
    """Whether a brand's token names many things: it is one of the words given, short, or ends generically."""
    t = F.lower(token)
    listed = t.isin(*words) if words else F.lit(False)
    return listed | t.rlike("^[a-z]{1,4}$") | t.rlike(fixed.BRAND_SUFFIXES)


def brand_named(token: Column, text: Column, title: Column) -> Column:
    """Whether a token occurs in the text or the title; an empty one does in none."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (F.coalesce(token, F.lit("")) != "") & (F.contains(low(text), low(token)) | F.contains(low(title), low(token)))


def render_gap(words: Column, text_chars: Column, script_chars: Column, html_chars: Column) -> Column:
    """(text_to_html, script_to_text, likely): whether a page's text is made by its scripts."""
    ratio = F.round(text_chars / F.greatest(F.lit(1), html_chars), 4)
    script = F.round(script_chars / F.greatest(F.lit(1), text_chars), 2)
    return F.struct(ratio.alias("text_to_html"), script.alias("script_to_text"), ((words < fixed.GAP_WORDS) & ((ratio < 0.05) | (script > 3.0))).alias("likely"))


def score_notes(words: Column, qa: Column, genre_count: Column, hedges: Column) -> Column:
    """Names of the remarks on a score: questions without evidence, too short, asserted only."""
    least = fixed.GENRES["qa"][1]
    return F.array_compact(F.array(
        F.when((qa >= least) & (genre_count == 0), "qa_without_evidence"), F.when(words < fixed.LEAST_ABSORBABLE_WORDS, "below_absorbable_length"),
        F.when((hedges >= fixed.HEDGES) & (genre_count <= 1), "asserted_not_substantiated"),
    ))
