"""Aggregates, windows and samples over a site's pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import fixed, scores
from siltstone.session import small

# The corpus's thin-page threshold and its bounds by site.
THIN_WORDS, MOST_THIN, LEAST_SAMPLE = 170, 600, 3


def at_positions(df: DataFrame, key: str, value: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, names): of each name, the element at the position (of the number of values, from 0) in the
    key's sorted values. They come from counts by value; a task holds a key's distinct values, not its rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(key)
    run = counts.withColumn("_seen", F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    here = lambda at: (F.col("_seen") > at) & (F.col("_seen") - F.col("_n") <= at)
    return run.groupBy(key).agg(*(F.max(F.when(here(f(F.col("_all"))), F.col(value))).alias(n) for n, f in positions.items()))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the element at n // 2 of the sorted values."""
    return at_positions(df, key, value, {"median": lambda n: F.floor(n / 2)})


def before(df: DataFrame, key: str, order: str, sums: dict[str, Column], block_rows: int = 100_000) -> DataFrame:
    """df with, of each name, the sum of the column over the key's rows that come before in the (numeric)
    order. The order's range is cut into blocks of about so many rows, which are summed first, so that no
    task orders all rows of a key."""
    span = df.groupBy(key).agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    b = F.floor((F.col(order) - F.col("_low")) * F.col("_blocks") / (F.col("_high") - F.col("_low") + 1))
    each = df.join(small(span), key).withColumn("_block", b).drop("_low", "_high", "_blocks")
    for n, c in sums.items():
        each = each.withColumn(f"_v_{n}", F.coalesce(c, F.lit(0)))
    totals = each.groupBy(key, "_block").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums))
    so_far = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(key, "_block", *(F.coalesce(F.sum(f"_s_{n}").over(so_far), F.lit(0)).alias(f"_s_{n}") for n in sums))
    inside = W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = each.join(totals, [key, "_block"])
    return out.select(*df.columns, *((F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n) for n in sums))


def score_rollup(scored: DataFrame, site: str = "site", score: str = "score") -> DataFrame:
    """Per site: pages, mean, upper median, extremes and the number in each rating."""
    s = F.col(score)
    bands = [F.count_if(scores.rating(s) == name).alias(name) for name in (*(n for n, _ in fixed.RATINGS), "very_weak")]
    totals = scored.groupBy(site).agg(
        F.count(s).alias("pages"), F.round(F.avg(s), 4).alias("mean"), F.min(s).alias("lowest"), F.max(s).alias("highest"),
        F.count_if(s < 0.45).alias("weak_or_worse"), *bands,
    )
    return totals.join(upper_median(scored, site, score), site, "left")


def calibration(pages: DataFrame, site: str = "site", words: str = "words", headings: str = "headings", strictness: str = "standard") -> DataFrame:
    """Per site with three pages or more: median, low quartile, extremes and spread of word counts, and
    the thresholds derived from them (half-even rounding)."""
    rows = pages.where(F.col(words).isNotNull())
    stats = rows.groupBy(site).agg(F.count(F.lit(1)).alias("pages"), F.min(words).alias("min_words"), F.max(words).alias("max_words"))
    middle = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}
    of_words = at_positions(rows, site, words, middle | {"p25_words": lambda n: F.greatest(F.lit(0), F.floor(n / 4) - 1)})
    of_headings = at_positions(rows, site, headings, middle)
    mean = lambda: ((F.col("_low") + F.col("_high")) / 2.0).cast("double")
    stats = stats.join(of_words.select(site, "p25_words", mean().alias("median_words")), site, "left").join(of_headings.select(site, mean().alias("median_headings")), site, "left")
    stats = stats.select(site, "pages", "median_words", "p25_words", "min_words", "max_words", "median_headings")
    thin = F.greatest(F.lit(float(THIN_WORDS)), F.least(F.col("median_words") * 0.5, F.lit(float(MOST_THIN))))
    thin = F.least(thin, F.lit(float(THIN_WORDS))) if strictness == "lenient" else F.greatest(thin, F.col("median_words") * 0.6) if strictness == "strict" else thin
    return stats.where(F.col("pages") >= LEAST_SAMPLE).select(
        "*", F.round(F.col("max_words") / F.greatest(F.lit(1), F.col("min_words")), 2).alias("spread"),
        F.bround(thin).cast("int").alias("thin_words"), F.when(F.col("median_headings") >= 4, 2).otherwise(1).alias("min_headings"),
    )


def round_robin(candidates: DataFrame, limit: int, site: str = "site", kind: str = "page_type", order: str = "ordinal") -> DataFrame:
    """At most `limit` candidates a site: all if they are no more; else one homepage, then one of each
    type in turn, types by name with 'other' last. Extra homepages are left out."""
    # no more than `limit` of a type can be picked; cut there, Spark keeps as few before the shuffle
    c = candidates.withColumn("_turn", F.row_number().over(W.partitionBy(site, kind).orderBy(order))).where(F.col("_turn") <= limit)
    home = F.col(kind) == "homepage"
    totals = candidates.groupBy(site).agg(F.count(F.lit(1)).alias("_n"))
    c = c.join(totals, site).where((F.col("_n") <= limit) | ~home | (F.col("_turn") == 1))
    c = c.withColumn("pick", F.row_number().over(W.partitionBy(site).orderBy(~home, F.col("_turn"), F.col(kind) == "other", kind, order)))
    return c.where(F.col("pick") <= limit).drop("_n", "_turn")


def budgeted(df: DataFrame, size: Column, most: int, site: str = "site", order: str = "ordinal") -> DataFrame:
    """The rows in order until the sizes before a row have used up the budget."""
    return before(df, site, order, {"used_before": size}).where(F.col("used_before") < most)


def affordable(most: Column, total: Column, elapsed: Column, delay: Column) -> Column:
    """Pages that the time left allows at the delay between requests."""
    return F.when(delay <= 0, most).otherwise(F.greatest(F.lit(1), F.least(most, F.floor(F.greatest(F.lit(0.0), total - elapsed) / delay).cast("int"))))


def every_kth(df: DataFrame, keep: int, key: str = "site", order: str = "ordinal") -> DataFrame:
    """Rows at equal steps, the first `keep` of them."""
    step = df.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / keep)).alias("_step"))
    r = before(df, key, order, {"_r": F.lit(1)}).join(step, key)
    return r.where((F.col("_r") % F.col("_step") == 0) & (F.col("_r") / F.col("_step") < keep)).select(*df.columns)


def chrome_links(links: DataFrame, site: str = "site", page: str = "page_id", href: str = "href") -> DataFrame:
    """(site, href, n_pages) of links on at least four fifths of a site's pages, and two at least."""
    each = links.select(site, page, href).distinct()
    of_site = each.select(site, page).distinct().groupBy(site).agg(F.count(F.lit(1)).alias("_pages"))
    counts = each.groupBy(site, href).agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.join(of_site, site).where(F.col("n_pages") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * fixed.CHROME_SHARE))).drop("_pages")


def first_seen(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(W.partitionBy("_key").orderBy(*order))).where("_r = 1").drop("_key", "_r")


def bins(df: DataFrame, value: str, table: DataFrame) -> DataFrame:
    """(band, n) of a range join to a short table of (band, low, high); empty bins count 0."""
    found = df.select(value).join(small(table), F.col(value).between(F.col("low"), F.col("high"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return table.select("band").join(found, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def contextual_links(links: DataFrame, site: str = "site", page: str = "page_id", own: str = "own", href: str = "href") -> DataFrame:
    """(page, n_links): distinct targets of a page's links (with its own address in `own`) that are neither
    the page itself nor on most pages of the site; pages without one have no row."""
    each = links.select(site, page, own, href).distinct()
    rest = each.join(chrome_links(each, site, page, href).select(site, href), [site, href], "left_anti").where(F.col(href) != F.col(own))
    return rest.groupBy(page).agg(F.count(F.lit(1)).alias("n_links"))
