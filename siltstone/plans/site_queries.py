"""Queries of the site-corpus operators over the driver's tables; `oracles` has SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import dates, fixed, hosts, markup, scores, text, urls
from siltstone.operators import entities, findings, html, jsonnodes, render, robots, sitemaps, sites
from siltstone.session import spread, table, written

Query = Callable[[SparkSession, str], DataFrame]
#: The moment that ages are counted to.
NOW = "2026-06-01 00:00:00"
ROBOTS = "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /docs/\nAllow: /docs/*/public\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /news/*-1$\nDisallow: /products/\nAllow: /products/*and*\nCrawl-delay: soon\nSitemap: https://x.example/sitemap.xml\n"
AGENTS = ("GPTBot", "ClaudeBot", "PerplexityBot", "Googlebot")
VARIANTS = (
    "{u}", "  <{u}>", "{p}", "//{p}", "ftp://{p}", "https://user:pw@{p}", "https://{h}:22/", "https://localhost/a", "https://10.0.0.7/a",
    "https://0x7f000001/", "https://2130706433/", "https://-{h}/", "https://{h}.internal/", "https://single/", "",
)


def _now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u, v = F.col("url"), table(spark, d, "validated_urls")
    return v.select(
        "page_id", urls.scheme_of(u).alias("scheme"), urls.host_of(u).alias("host"), urls.port_of(u).alias("port"), urls.path_of(u).alias("path"),
        urls.path_depth(u).alias("depth"), urls.registrable_domain(urls.host_of(u)).alias("domain"), urls.canonical(u).alias("canonical"),
        urls.dedupe_key(u).alias("dedupe_key"), urls.href_key(u).alias("href_key"), urls.page_type(u).alias("page_type"),
    )


def url_reject_codes(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validated_urls").select("page_id", F.regexp_replace("url", r"\.(?:test|example|invalid)\b", ".com").alias("u"))
    v = v.withColumn("p", F.regexp_replace("u", "^https?://", "")).withColumn("h", urls.host_of(F.col("u")))
    made = [F.concat(*(F.col(x[1]) if x in ("{u}", "{p}", "{h}") else F.lit(x) for x in _pieces(t))) if t else F.lit("") for t in VARIANTS]
    rows = v.select("page_id", F.posexplode(F.array(*made)).alias("variant", "raw"))
    return rows.select("page_id", "variant", F.coalesce(urls.reject_code(F.col("raw")), F.lit("ok")).alias("code"))


def _pieces(template: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\{[uph]\})", template) if x]


def page_type_mix(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validated_urls")
    return v.groupBy("registrable_domain", urls.page_type(F.col("url")).alias("page_type")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(urls.is_crawlable(F.col("url"), F.col("registrable_domain"))).alias("crawlable"),
    )


def genre_profile(spark: SparkSession, d: str) -> DataFrame:
    counted = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", *text.genre_counts(F.col("text")))
    return counted.withColumn("genre_count", F.size(text.genres(fixed.POSITIVE_GENRES)))


def genre_matrix(spark: SparkSession, d: str) -> DataFrame:
    counted = spread(table(spark, d, "documents").select("source", "text")).select("source", *text.genre_counts(F.col("text")))
    return counted.groupBy("source").agg(*(F.count_if(F.col(f"n_{g}") >= n).alias(g) for g, (_, n) in fixed.GENRES.items()), F.count(F.lit(1)).alias("documents"))


def word_bins(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([(f"{a}-{b}" if b < 10**9 else ">3000", a, b) for a, b, _ in fixed.WORD_BINS], "band string, low long, high long")
    words = table(spark, d, "documents").select(text.word_count(F.col("text")).alias("words"))
    return sites.bins(words, "words", bands)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    h = spread(table(spark, d, "html_docs").select("page_id", "main_text", "headings")).select(
        "page_id", text.word_count(F.col("main_text")).alias("words"), F.coalesce(F.array_size("headings"), F.lit(0)).alias("headings"),
        *text.genre_counts(F.col("main_text")),
    )
    site = table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site"))
    return h.join(site, "page_id").withColumn("score", scores.readiness(F.col("words"), F.col("headings"), F.col("n_definition"), F.col("n_numeric"), F.col("n_comparison")))


def readiness_pages(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select(
        "page_id", "words", "headings", F.round("score", 3).alias("score"), scores.rating(F.col("score")).alias("rating"),
        text.word_band(F.col("words"))["band"].alias("band"), text.quartile("word_count", F.col("words")).alias("quartile"),
    )


def readiness_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = sites.score_rollup(written(_scored(spark, d)))
    return r.select(
        "site", "pages", F.round("lowest", 3).alias("lowest"), F.round("median", 3).alias("median"), F.round("highest", 3).alias("highest"),
        "weak_or_worse", "strong", "adequate", "weak", "very_weak", F.round("mean", 3).alias("mean"),
    )


def site_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return sites.calibration(written(_scored(spark, d))).select(
        "site", "pages", "median_words", "p25_words", "min_words", "max_words", "median_headings", "thin_words", "min_headings",
    )


def claim_sentences(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(text.claims(F.col("text"))).alias("no", "claim"))
    return c.select("doc_id", "no", "claim.kind", "claim.sentence")


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(
        F.lit("Made on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(", sent "), F.date_format("o_orderdate", "d MMM yyyy"),
        F.lit("; seen "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", not 2024."),
    )
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(text.text_dates(made)).alias("no", "date"))


def raw_signals(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", "body"))
    return f.select(
        "page_id", F.array_join(markup.frameworks(b), ",").alias("frameworks"), F.array_join(markup.state_blobs(b), ",").alias("state_blobs"),
        markup.empty_mount(b).alias("empty_mount"), markup.skeletons(b).alias("skeletons"), markup.lazy_markers(b).alias("lazy_markers"),
        markup.client_routing(b).alias("client_routing"), markup.image_counts(b)["images"].alias("images"),
        markup.head_counts(b)["stylesheets"].alias("stylesheets"),
    )


def html_structure(spark: SparkSession, d: str) -> DataFrame:
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", "body", "final_url"))
    p = html.parsed(f).select("page_id", html.structure(F.col("doc")).alias("s"), F.size("doc.meta").alias("meta_keys"), F.col("doc.lang").alias("lang"))
    return p.select("page_id", "s.total_word_count", "s.heading_count", "s.paragraph_count", "s.list_item_count", "meta_keys", F.coalesce("lang", F.lit("")).alias("lang"))


def html_headings(spark: SparkSession, d: str) -> DataFrame:
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", "body", "final_url"))
    p = html.parsed(f)
    shown = F.transform("doc.headings", lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["text"]))
    return p.select("page_id", html.heading_skips(F.col("doc.headings")).alias("heading_skips"), F.array_join(shown, "\n").alias("headings"))


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Title and main region of each served page, as the parser sees them."""
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", "body", "final_url"))
    return html.parsed(f).select(
        "page_id", F.col("doc.title").alias("title"), F.col("doc.main_text").alias("main_text"), F.size("doc.json_ld").alias("json_ld"),
        F.size("doc.json_ld_errors").alias("json_ld_errors"),
    )


def render_faults(spark: SparkSession, d: str) -> DataFrame:
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", "body")).select(
        "page_id", "body", render.trapped_chars(F.col("body")).alias("trapped"), F.inline(F.array(render.signals(F.col("body")))),
    )
    h = table(spark, d, "html_docs").select(
        "page_id", text.word_count(F.col("text")).alias("words"), F.length("text").alias("text_chars"), "inline_script_chars", "noscript_chars",
        "title", F.col("meta")["description"].alias("description"), F.coalesce(F.array_size("paragraphs"), F.lit(0)).alias("paragraphs"), "images",
        "images_missing_alt",
    )
    return render.faults(f.drop("body").join(h, "page_id")).select("page_id", F.inline("faults"))


def link_profile(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "html_docs").select("page_id", F.explode("links").alias("l")).join(table(spark, d, "validated_urls").select("page_id", "registrable_domain"), "page_id")
    return links.groupBy("registrable_domain").agg(
        F.count(F.lit(1)).alias("links"), F.count_if("l.internal").alias("internal"), F.count_if("l.nofollow").alias("nofollow"),
        F.countDistinct("l.href").alias("targets"), F.count_if(hosts.host_family(urls.host_of(F.col("l.href"))) != "other").alias("known_hosts"),
    )


def chrome_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "html_docs").select("page_id", F.explode("links.href").alias("raw")).join(
        table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id",
    )
    return sites.chrome_links(links.withColumn("href", urls.href_key(F.col("raw"))))


def host_families(spark: SparkSession, d: str) -> DataFrame:
    known = [s for _, suffixes in fixed.HOST_FAMILIES for s in suffixes]
    suffix = F.get(F.array(*map(F.lit, known)), (F.col("page_id") % len(known)).cast("int"))
    label = F.regexp_extract("host", r"^([^.]+)", 1)
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("www."), suffix)).when(F.col("page_id") % 3 == 1, F.concat(label, suffix)).otherwise(F.col("host"))
    return table(spark, d, "validated_urls").select("page_id", made.alias("made_host")).withColumn("family", hosts.host_family(F.col("made_host")))


def robots_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validated_urls").where("registrable_domain is not null")
    files = v.select(F.col("registrable_domain").alias("site")).distinct().withColumn("text", F.lit(ROBOTS))
    directives = robots.lines(files)
    agents = spark.createDataFrame([(a,) for a in AGENTS], "agent string")
    paths = v.select(F.col("registrable_domain").alias("site"), urls.path_of(F.col("url")).alias("path"))
    return robots.verdicts(robots.rules(directives), robots.agent_groups(directives, agents), paths)


def sitemap_lastmod_stats(spark: SparkSession, d: str) -> DataFrame:
    return sitemaps.lastmod_stats(table(spark, d, "sitemap_entries"), _now()).drop("coverage")


def sitemap_problems(spark: SparkSession, d: str) -> DataFrame:
    return sitemaps.problems(table(spark, d, "sitemap_entries"), _now())


def sitemap_orphans(spark: SparkSession, d: str) -> DataFrame:
    return sitemaps.orphans(table(spark, d, "validated_urls").select("page_id", "url"), table(spark, d, "sitemap_entries"))


def sample_round_robin(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validated_urls").select(
        "page_id", F.col("registrable_domain").alias("site"), urls.page_type(F.col("url")).alias("page_type"), F.col("page_id").alias("ordinal"),
    )
    return sites.round_robin(v, 8).select("site", "page_id", "pick")


def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetch_results").where("raw_bytes is not null").select("page_id", "raw_bytes").join(
        table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id",
    )
    return sites.budgeted(f, F.col("raw_bytes"), 40_000, order="page_id").select("site", "page_id", "used_before")


def liveness_stride(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "sitemap_entries").select("entry_id", "registrable_domain")
    return sites.every_kth(e, 5, "registrable_domain", "entry_id")


def discovery_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of sitemaps and page links, first seen by source and order."""
    a = table(spark, d, "sitemap_entries").where("loc is not null").select(F.col("loc").alias("url"), F.lit(0).alias("source_rank"), F.col("entry_id").alias("ordinal"))
    b = table(spark, d, "validated_urls").select("url", F.lit(1).alias("source_rank"), F.col("page_id").alias("ordinal"))
    return sites.first_seen(a.unionByName(b), urls.dedupe_key(F.col("url")), "source_rank", "ordinal", "url").select("source_rank", "ordinal", "url")


def page_dates(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "html_docs").select("page_id", "meta", "time_elements")
    raw = lambda keys: F.array_compact(F.array(*(F.col("meta")[k] for k in keys)))
    kinds = lambda c, k: F.transform(c, lambda x: F.struct(F.lit(k).alias("k"), x.alias("raw")))
    none = F.array().cast("array<string>")
    each = h.select(
        "page_id",
        F.explode_outer(F.concat(kinds(F.concat(raw(fixed.PUBLISHED_META), F.coalesce("time_elements", none)), "p"), kinds(raw(fixed.MODIFIED_META), "m"))).alias("e"),
    )
    nodes = entities.top_level_nodes(table(spark, d, "html_docs"))
    of = lambda keys: F.array_compact(F.array(*(entities.prop(F.col("node"), k, "string") for k in keys)))
    declared = nodes.select("page_id", F.explode(F.concat(kinds(of(fixed.PUBLISHED_LD), "p"), kinds(of(fixed.MODIFIED_LD), "m"))).alias("e"))
    each = each.unionByName(declared)
    each = each.select("page_id", "e.k", dates.parse_date(F.col("e.raw")).alias("at"))
    found = each.groupBy("page_id").agg(F.min(F.when(F.col("k") == "p", F.col("at"))).alias("published"), F.max(F.when(F.col("k") == "m", F.col("at"))).alias("modified"))
    found = found.withColumn("latest", F.greatest("published", "modified"))
    return found.select("page_id", *(F.unix_timestamp(c).alias(c) for c in ("published", "modified", "latest")), dates.age_days(F.col("latest"), _now()).alias("age_days"))


def response_profile(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetch_results").join(table(spark, d, "validated_urls").select("page_id", "registrable_domain"), "page_id")
    return f.groupBy("registrable_domain").agg(
        F.count(F.lit(1)).alias("fetches"), F.count_if(F.col("status").between(200, 299)).alias("ok"),
        F.count_if(F.col("status") >= 400).alias("errors"), F.count_if(F.col("status").isNull()).alias("failed"),
        F.count_if(F.coalesce(F.array_size("redirect_chain"), F.lit(0)) > 0).alias("redirected"),
        F.count_if(dates.header(F.col("headers"), "Cache-Control") == "no-store").alias("no_store"), F.sum("raw_bytes").alias("bytes"),
    )


def jsonld_types(spark: SparkSession, d: str) -> DataFrame:
    """The types of JSON-LD nodes by frequency, each node's type by the last part of its name."""
    values = jsonnodes.json_values(table(spark, d, "html_docs")).where(F.col("value_path").rlike(r"/@?type(?:/\d+)?$") & (F.col("kind") == "string"))
    return values.groupBy(hosts.bare_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("page_id").alias("pages"))


def findings_report(spark: SparkSession, d: str) -> DataFrame:
    """Thin, unstructured and unevidenced pages as findings by site, reviewed, merged and numbered."""
    # scored once; all that follows reads the numbers
    s = written(_scored(spark, d).join(table(spark, d, "validated_urls").select("page_id", "url"), "page_id"))
    thresholds = sites.calibration(s).select("site", "thin_words", F.col("min_headings").alias("least_headings"))
    s = s.join(thresholds, "site").withColumn("page_type", urls.page_type(F.col("url")))
    checks = {
        "thin_content": (F.col("words") < F.col("thin_words"), 1, "high"),
        "unstructured_page": (F.col("headings") < F.col("least_headings"), 1, "medium"),
        "no_evidence_genre": (F.size(text.genres(fixed.POSITIVE_GENRES)) == 0, 2, "medium"),
    }
    flagged = s.select("site", "url", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, (c, _, _) in checks.items())))).alias("check_id"))
    totals = s.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    # the twelve first addresses by a ranked window, which Spark cuts before the shuffle
    ranked = flagged.select("site", "check_id", "url").withColumn("r", F.row_number().over(W.partitionBy("site", "check_id").orderBy("url"))).where("r <= 12")
    shown = ranked.groupBy("site", "check_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    f = flagged.groupBy("site", "check_id").agg(F.count(F.lit(1)).alias("n")).join(shown, ["site", "check_id"]).join(totals, "site")
    level, severity = F.lit(1), F.lit("low")
    for k, (_, lv, sv) in checks.items():
        level, severity = F.when(F.col("check_id") == k, lv).otherwise(level), F.when(F.col("check_id") == k, sv).otherwise(severity)
    observed = F.format_string("%d of %d pages", "n", "pages")
    f = f.select(
        "site", "check_id", F.replace("check_id", F.lit("_"), F.lit(" ")).alias("title"), severity.alias("severity"), level.alias("claim_level"),
        F.lit("high").alias("confidence"),
        F.concat(observed, F.lit(" of the site show this, for example "), F.element_at("urls", 1)).alias("evidence"), observed.alias("observed"),
        F.lit("").alias("expected"), F.col("pages").cast("int").alias("sample_size"), "urls",
        F.lit("Extend or merge the pages named here.").alias("action"), F.lit("").alias("mechanism"), severity.alias("priority"),
        F.lit("absorption").alias("layer"), F.xxhash64("site", "check_id").alias("finding_no"),
    )
    kept = findings.review(f, s.select("url", "page_type")).where("drop_reason is null")
    return findings.numbered(findings.merged(kept)).select("site", "id", "check_id", "severity", "claim_level", "confidence", "observed", "priority")


def events_by_window(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of an hour by event type; the same plan runs on a stream."""
    from siltstone.streaming.pages import windowed

    return windowed(table(spark, d, "events"), "1 hour").select(F.col("window.start").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def queries() -> dict[str, Query]:
    own = (
        url_parts, url_reject_codes, page_type_mix, genre_profile, genre_matrix, word_bins, readiness_pages, readiness_rollup, site_thresholds,
        claim_sentences, text_dates, raw_signals, html_structure, html_headings, html_pages, render_faults, link_profile, chrome_links, host_families,
        robots_verdicts, sitemap_lastmod_stats, sitemap_problems, sitemap_orphans, sample_round_robin, byte_budget, liveness_stride, discovery_union,
        page_dates, response_profile, jsonld_types, findings_report, events_by_window,
    )
    return {f.__name__: f for f in own}
