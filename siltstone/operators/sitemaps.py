"""Sitemap files and entries: parsing, statistics, problems and pages that no sitemap lists.

Counts and medians are aggregates by site; medians come from counts by value, so no site's entries are
gathered into one list. Repeated rows count as repeated entries; null locs are no entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import dates, urls

# The sitemap namespace and the limits of one file.
NAMESPACE, MOST_URLS, MOST_BYTES = "http://www.sitemaps.org/schemas/sitemap/0.9", 50_000, 50 * 1024 * 1024


def _tag(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?i)<{name}>\s*([^<]+?)\s*</{name}>", 1)


def parse_files(files: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """files with (namespace, is_index, children, entries, errors); entries are (loc, lastmod, changefreq,
    priority). Locs outside url elements are salvaged with an error."""
    text = F.coalesce(F.col(xml), F.lit(""))
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    locs = F.regexp_extract_all(text, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    bare = (F.size(blocks) == 0) & F.contains(F.lower(text), F.lit("<loc>"))
    is_index = F.contains(F.lower(text), F.lit("<sitemapindex"))
    used = F.when(bare, F.transform(locs, lambda x: F.concat(F.lit("<loc>"), x, F.lit("</loc>")))).otherwise(blocks)
    entry = lambda b: F.struct(*(_tag(b, n).alias(n) for n in ("loc", "lastmod", "changefreq", "priority")))
    entries = F.filter(F.transform(F.when(is_index, F.array().cast("array<string>")).otherwise(used), entry), lambda e: e["loc"] != "")
    namespace = F.regexp_extract(text, "(?i)xmlns\\s*=\\s*[\"']([^\"']+)[\"']", 1)
    errors = F.array_compact(F.array(
        F.when(namespace == "", "no xmlns declared").when(namespace != NAMESPACE, F.concat(F.lit("declares namespace "), namespace)),
        F.when(bare & ~is_index, "loc elements are not wrapped in url elements"), F.when(F.octet_length(text) > MOST_BYTES, "exceeds the size limit"), F.when(F.size(entries) > MOST_URLS, "contains too many URLs"),
    ))
    return files.select(
        "*", namespace.alias("namespace"), is_index.alias("is_index"),
        F.when(is_index, locs).otherwise(F.array().cast("array<string>")).alias("children"), entries.alias("entries"), errors.alias("errors"),
    )


def lastmod_stats(entries: DataFrame, now: Column, site: str = "registrable_domain") -> DataFrame:
    """Per site: entries, dated ones, coverage, age of the upper median, oldest and newest, stale and
    future ones. The median comes from (site, age) counts: ages are whole days, so a site's distribution
    has few rows however many entries it has."""
    parsed = dates.w3c_date(F.col("lastmod"))
    e = entries.select(F.col(site).alias("site"), parsed.alias("p")).select("site", F.col("p.parsed").alias("at"), F.col("p.valid").alias("valid"))
    # greatest() skips nulls, so undated entries are kept apart
    e = e.withColumn("age", F.when(F.col("at").isNotNull(), F.greatest(F.lit(0), dates.age_days(F.col("at"), now)).cast("bigint")))
    by_age = e.groupBy("site", "age").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("at") > now).alias("future"))
    dated = F.col("age").isNotNull()
    summary = by_age.groupBy("site").agg(
        F.sum("n").alias("entries"), F.coalesce(F.sum(F.when(dated, F.col("n"))), F.lit(0)).alias("dated"), F.sum("invalid").alias("invalid"), F.sum("future").alias("future"), F.coalesce(F.sum(F.when(F.col("age") > 365, F.col("n"))), F.lit(0)).alias("stale"),
        F.min("age").alias("newest_age"), F.max("age").alias("oldest_age"), F.array_sort(F.collect_list(F.when(dated, F.struct("age", "n")))).alias("ages"),
    )
    # the first age at which more than half of the dated entries have been passed
    half = F.floor(F.col("dated") / 2)
    walk = F.aggregate(
        "ages", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("median")),
        lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["median"].isNull() & (a["seen"] + x["n"] > half), x["age"]).otherwise(a["median"]).alias("median")),
    )
    return summary.select(
        "site", "entries", "dated", F.round(F.col("dated") / F.col("entries"), 3).alias("coverage"), "invalid", "future", "stale",
        walk["median"].alias("median_age"), "newest_age", "oldest_age",
    )


def problems(entries: DataFrame, now: Column, site: str = "registrable_domain", scheme: str = "https") -> DataFrame:
    """(site, code, n) of the problems that a site's entries show."""
    loc, domain = F.col("loc"), F.col(site)
    host = urls.host_of(loc)
    outside = (host == "") | ~urls.same_scope(host, domain)
    flags = entries.where("loc is not null").select(
        domain.alias("site"), loc, outside.alias("off_scope"), (~outside & (urls.scheme_of(loc) != scheme)).alias("scheme_mismatch"),
        F.contains(loc, F.lit("#")).alias("fragments"), "lastmod",
    )
    counts = flags.groupBy("site").agg(
        F.count_if("off_scope").alias("sitemap_off_scope"), F.count_if("scheme_mismatch").alias("sitemap_scheme_mismatch"),
        F.count_if("fragments").alias("sitemap_fragments"),
    )
    # distinct locs by a first sum over (site, loc), so that one site's locs are spread over tasks
    distinct = flags.groupBy("site", "loc").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg((F.sum("n") - F.count(F.lit(1))).alias("sitemap_duplicates"))
    stats = lastmod_stats(entries.where("loc is not null"), now, site)
    uniform = flags.where("lastmod is not null").groupBy("site", "lastmod").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg(
        F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"),
    )
    all_ = counts.join(distinct, "site").join(stats, "site").join(uniform, "site", "left")
    c = F.col
    found = {
        "sitemap_duplicates": c("sitemap_duplicates"), "sitemap_off_scope": c("sitemap_off_scope"), "sitemap_scheme_mismatch": c("sitemap_scheme_mismatch"), "sitemap_fragments": c("sitemap_fragments"), "sitemap_bad_lastmod": c("invalid"), "sitemap_future_lastmod": c("future"),
        "sitemap_stale": F.when((c("median_age") > 365) & (c("dated") >= 5), c("median_age")), "sitemap_uniform_lastmod": F.when((c("values") == 1) & (c("rows") >= 10) & (c("dated") >= 10), c("rows")), "sitemap_no_lastmod": F.when(c("dated") == 0, c("entries")),
    }
    rows = F.array(*(F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n")) for code, n in found.items()))
    return all_.select("site", F.inline(rows)).where("n > 0")


def orphans(pages: DataFrame, entries: DataFrame, url: str = "url", loc: str = "loc") -> DataFrame:
    """pages whose URL, without a last slash, no entry lists: a left anti join."""
    key = lambda c: F.rtrim(F.col(c), F.lit("/"))
    listed = entries.where(F.col(loc).isNotNull()).select(key(loc).alias("_listed")).distinct()
    return pages.join(listed, key(url) == F.col("_listed"), "left_anti")
