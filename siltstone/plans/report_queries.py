"""Queries on sites: addresses, sources, links, dates, thresholds and reports, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import fixed, hosts, text, urls
from siltstone.operators import findings, render, reports, robots, sitemaps, sites
from siltstone.plans import oracles, site_queries
from siltstone.plans.oracles import _q
from siltstone.session import spread, table, written
from siltstone.sources import pages

SQL: dict[str, str] = {}

# Addresses and the code that each must get.
VECTORS = (
    ("http://localhost/", "blocked_host"), ("http://127.0.0.1/", "private_ip"), ("http://[::1]/", "blocked_host"), ("http://169.254.169.254/latest/meta-data/", "blocked_host"), ("http://metadata.google.internal/", "blocked_host"), ("http://100.100.100.200/", "blocked_host"),
    ("http://192.168.1.1/", "private_ip"), ("http://10.0.0.5/", "private_ip"), ("http://172.16.0.1/", "private_ip"), ("http://100.64.1.1/", "private_ip"), ("http://[fd00::1]/", "private_ip"), ("http://[::ffff:127.0.0.1]/", "private_ip"), ("http://[64:ff9b::7f00:1]/", "private_ip"),
    ("http://[64:ff9b::a9fe:a9fe]/", "private_ip"), ("http://[64:ff9b::c0a8:101]/", "private_ip"), ("http://2130706433/", "obfuscated_ip_decimal"), ("http://0x7f000001/", "obfuscated_ip_hex"), ("http://0177.0.0.1/", "obfuscated_ip_octal"), ("file:///etc/passwd", "bad_scheme"), ("gopher://x.com/", "bad_scheme"),
    ("javascript:alert(1)", "not_fqdn"), ("http://user:pw@example.com/", "embedded_credentials"), ("http://foo.internal/", "reserved_suffix"), ("http://box.local/", "reserved_suffix"), ("http://example.com:22/", "bad_port"), ("http://0.0.0.0/", "blocked_host"), ("http://singlelabel/", "not_fqdn"), ("", "empty"),
    ("https://[fe80::1]/", "private_ip"), ("https://[::ffff:10.0.0.1]/", "private_ip"), ("https://a..com/", "bad_idna"), ("https://-a.com/", "bad_label"), ("example.com", "ok"), ("https://www.adobe.com/products", "ok"), ("http://neverssl.com/", "ok"), ("https://sub.domain.co.uk/a?q=1", "ok"), ("  https://example.com  ", "ok"), ("http://[64:ff9b::23be:6b3]/", "ok"),
)


def url_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that must be refused, or not, with their code."""
    rows = spark.createDataFrame([(u,) for u, _ in VECTORS], "url string")
    return rows.select("url", F.coalesce(urls.reject_code(F.col("url")), F.lit("ok")).alias("code"))


SQL["url_vectors"] = "SELECT * FROM (VALUES " + ", ".join(f"({_q(u)}, {_q(c)})" for u, c in VECTORS) + ") t(url, code)"


def url_variants(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "validated_urls").select(
        "page_id", urls.robots_url(u).alias("robots"), urls.other_scheme(u).alias("other_scheme"),
        urls.other_host(urls.host_of(u)).alias("other_host"),
    )


SQL["url_variants"] = f"""
SELECT page_id, {oracles.SCHEME} || '://' || lower({oracles.AUTHORITY}) || '/robots.txt' AS robots, CASE WHEN {oracles.SCHEME} = 'https' THEN 'http' || url[6:] ELSE 'https' || url[5:] END AS other_scheme, CASE WHEN starts_with({oracles.HOST}, 'www.') THEN ({oracles.HOST})[5:] ELSE 'www.' || {oracles.HOST} END AS other_host FROM validated_urls
"""
_CODES = (
    "ok", "ok", "ok", "ok", "bad_scheme", "embedded_credentials", "bad_port", "blocked_host", "private_ip", "obfuscated_ip_hex",
    "obfuscated_ip_decimal", "bad_label", "reserved_suffix", "not_fqdn", "empty",
)
SQL["url_reject_codes"] = f"SELECT page_id, CAST(i AS INTEGER) AS variant, {list(_CODES)}[i + 1] AS code FROM validated_urls, (SELECT unnest(range({len(_CODES)})) AS i)"


def saved_page_notes(spark: SparkSession, d: str) -> DataFrame:
    """What a scan of the saved pages leaves out, by reason, beside the pages that it gets."""
    f = table(spark, d, "fetch_results").select("page_id", "status", "body")
    got, notes = pages.saved(f.select("page_id", "status"), f.select("page_id", "body"))
    return got.groupBy().agg(F.lit("page").alias("note"), F.count(F.lit(1)).alias("n")).unionByName(notes.groupBy("note").agg(F.count(F.lit(1)).alias("n")))


SQL["saved_page_notes"] = """
SELECT CASE WHEN status BETWEEN 200 AND 299 AND body IS NOT NULL THEN 'page' WHEN status BETWEEN 200 AND 299 THEN 'missing body' ELSE 'status ' || coalesce(CAST(status AS VARCHAR), 'none') END AS note, count(*) AS n FROM fetch_results GROUP BY 1
"""


def latest_fetches(spark: SparkSession, d: str) -> DataFrame:
    """The latest fetch of each address and the name of its run."""
    f = table(spark, d, "fetch_results").where("url is not null").select("url", "page_id", "fetched_at")
    run = F.concat(urls.slug(urls.host_of(F.col("url"))), F.lit("-"), F.date_format("fetched_at", "yyyyMMdd'T'HHmmss'Z'"))
    return pages.latest(f, "url", "fetched_at", "page_id").select("url", "page_id", run.alias("run"))


SQL["latest_fetches"] = f"""
SELECT url, page_id, substr(trim(regexp_replace(lower({oracles.HOST}), '[^a-z0-9.-]+', '-', 'g'), '-'), 1, 60) || '-' || strftime(fetched_at, '%Y%m%dT%H%M%SZ') AS run FROM fetch_results WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, page_id DESC) = 1
"""


def page_and_byte_budget(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetch_results").where("raw_bytes is not null").select("page_id", "raw_bytes").join(
        table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id",
    )
    return pages.budgeted(f, 12, 60_000, F.col("raw_bytes")).select("site", "page_id", "used_before")


SQL["page_and_byte_budget"] = """
WITH f AS (SELECT registrable_domain AS site, page_id, row_number() OVER w AS turn, coalesce(sum(raw_bytes) OVER (PARTITION BY registrable_domain ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM fetch_results JOIN validated_urls USING (page_id) WHERE raw_bytes IS NOT NULL WINDOW w AS (PARTITION BY registrable_domain ORDER BY page_id))
SELECT site, page_id, CAST(used_before AS BIGINT) AS used_before FROM f WHERE turn <= 12 AND used_before < 60000
"""


def decoded_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies packed and encoded in several ways, and read again: their length must be the text's."""
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", "body"))
    latin = (F.col("page_id") % 3 == 0) & ~F.col("body").rlike(r"[^\x00-\xff]")
    raw = F.when(latin, F.encode("body", "ISO-8859-1")).otherwise(F.encode("body", "UTF-8"))
    kind = F.when(latin, "text/html; charset=ISO-8859-1").when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8").otherwise("text/html")
    packed = pages.inflated(f.select("page_id", raw.alias("raw"), kind.alias("content_type"), F.lit("identity").alias("encoding")))
    return packed.select("page_id", F.length(pages.decoded(F.col("body_bytes"), F.col("content_type"))).alias("chars"), "note")


SQL["decoded_bodies"] = "SELECT page_id, length(body) AS chars, '' AS note FROM fetch_results WHERE body IS NOT NULL"


def affordable_samples(spark: SparkSession, d: str) -> DataFrame:
    """Pages that each site's time allows, at a delay of 0 to 4 seconds between requests."""
    v = table(spark, d, "validated_urls").groupBy(F.col("registrable_domain").alias("site")).agg(F.count(F.lit(1)).cast("int").alias("pages"))
    v = v.select("site", "pages", F.explode(F.array(*(F.lit(x / 2.0) for x in range(9)))).alias("delay"))
    return v.select("site", "delay", sites.affordable(F.col("pages"), F.lit(60.0), F.lit(12.0), F.col("delay")).alias("affordable"))


SQL["affordable_samples"] = "SELECT site, delay, CAST(CASE WHEN delay <= 0 THEN pages ELSE greatest(1, least(pages, floor(48.0 / delay))) END AS INTEGER) AS affordable FROM (SELECT registrable_domain AS site, count(*) AS pages FROM validated_urls GROUP BY 1), (SELECT unnest(range(9)) / 2.0::DOUBLE AS delay)"


def sitemap_files(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as files and parsed again; every fourth has its loc bare."""
    e = table(spark, d, "sitemap_entries").where("loc is not null").select(
        "entry_id", "loc", F.coalesce("lastmod", F.lit("")).alias("lastmod"),
    ).where(~F.col("loc").rlike(r"[<&]|^\s|\s$") & ~F.col("lastmod").rlike(r"[<&]|^\s|\s$"))
    loc = F.concat(F.lit("<loc> "), "loc", F.lit(" </loc>"))
    xml = F.concat(
        F.lit(f'<urlset xmlns="{sitemaps.NAMESPACE}">'),
        F.when(F.col("entry_id") % 4 == 0, loc).otherwise(F.concat(F.lit("<url>"), loc, F.lit("<lastmod>"), "lastmod", F.lit("</lastmod></url>"))),
        F.lit("</urlset>"),
    )
    p = sitemaps.parse_files(e.select("entry_id", xml.alias("xml"), F.lit("u").alias("url")))
    return p.select("entry_id", F.explode("entries").alias("e"), F.size("errors").alias("errors")).select("entry_id", "e.loc", "e.lastmod", "errors")


SQL["sitemap_files"] = """
SELECT entry_id, loc, CASE WHEN entry_id % 4 = 0 THEN '' ELSE coalesce(lastmod, '') END AS lastmod, CASE WHEN entry_id % 4 = 0 THEN 1 ELSE 0 END AS errors FROM sitemap_entries WHERE loc IS NOT NULL AND NOT regexp_matches(loc, '[<&]|^\\s|\\s$') AND NOT regexp_matches(coalesce(lastmod, ''), '[<&]|^\\s|\\s$')
"""


def robots_reports(spark: SparkSession, d: str) -> DataFrame:
    """What each agent's group is called by, how long it should wait, and whether it may read anything; the
    rules differ by the length of the site's name."""
    v = table(spark, d, "validated_urls").where("registrable_domain is not null").select(F.col("registrable_domain").alias("site")).distinct()
    some = F.length("site") % 3
    file = F.concat(
        F.lit("User-agent: GPTBot\nCrawl-delay: "), some.cast("string"), F.lit("\nDisallow: /"), F.when(some == 1, "\nAllow: /a").otherwise(""),
        F.when(some == 2, "").otherwise("\nUser-agent: *\nDisallow: /x\n"),
    )
    lines = robots.lines(v.select("site", file.alias("text")))
    agents = spark.createDataFrame([("GPTBot",), ("Other",)], "agent string")
    groups = robots.agent_groups(lines, agents).join(robots.blocks_everything(robots.rules(lines)), ["site", "group_no"], "left")
    return groups.join(robots.delays(lines), ["site", "group_no"], "left").select("site", "agent", "explicitly_named", "delay", "blocks_all")


SQL["robots_reports"] = """
WITH v AS (SELECT DISTINCT registrable_domain AS site, length(registrable_domain) % 3 AS k FROM validated_urls WHERE registrable_domain IS NOT NULL)
SELECT site, 'GPTBot' AS agent, true AS explicitly_named, k::DOUBLE AS delay, k <> 1 AS blocks_all FROM v UNION ALL SELECT site, 'Other', false, NULL, false FROM v WHERE k <> 2
"""


# --- links, dates and shape of sites
def external_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Per site, distinct hosts outside it, their families, and those that corroborate or amplify. Every
    fifth link leads to a known host."""
    known = [s for _, suffixes in fixed.HOST_FAMILIES for s in suffixes]
    links = table(spark, d, "html_docs").select("page_id", F.posexplode("links.href").alias("i", "href")).join(
        table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id",
    )
    pick = ((F.col("page_id") + F.col("i")) % len(known)).cast("int")
    host = F.when((F.col("page_id") + F.col("i")) % 5 == 0, F.ltrim(F.get(F.array(*map(F.lit, known)), pick), F.lit("."))).otherwise(urls.host_of(F.col("href")))
    each = links.select("site", host.alias("host")).where((F.col("host") != "") & ~urls.same_scope(F.col("host"), F.col("site"))).distinct().withColumn(
        "family", hosts.host_family(F.col("host")),
    )
    of = each.groupBy("site").agg(F.count(F.lit(1)).alias("hosts"), F.collect_set("family").alias("f"))
    both = lambda names: F.array_join(F.array_sort(F.array_intersect("f", F.array(*map(F.lit, names)))), ",")
    return of.select("site", "hosts", both(fixed.CORROBORATING).alias("corroborating"), both(fixed.AMPLIFYING).alias("amplifying"))


_KNOWN = [s for _, suffixes in fixed.HOST_FAMILIES for s in suffixes]
SQL["external_hosts"] = f"""
WITH l AS (SELECT h.page_id, registrable_domain AS site, CAST(i - 1 AS BIGINT) AS i, links[i].href AS url FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM html_docs) h JOIN validated_urls v ON v.page_id = h.page_id),
e AS (SELECT DISTINCT site, CASE WHEN (page_id + i) % 5 = 0 THEN ltrim([{', '.join(map(_q, _KNOWN))}][CAST((page_id + i) % {len(_KNOWN)} AS INTEGER) + 1], '.') ELSE {oracles.HOST.replace('url', 'l.url')} END AS host FROM l),
f AS (SELECT site, host, {oracles._FAMILY.replace('{h}', 'host')} AS family FROM e WHERE host <> '' AND host <> site AND NOT ends_with(host, '.' || site))
SELECT site, count(*) AS hosts, coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER (WHERE family IN {fixed.CORROBORATING})), ','), '') AS corroborating, coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER (WHERE family IN {fixed.AMPLIFYING})), ','), '') AS amplifying FROM f GROUP BY site
"""


def contextual_links(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site"), urls.href_key(F.col("url")).alias("own"))
    links = table(spark, d, "html_docs").select("page_id", F.explode("links").alias("l")).where("l.internal").select("page_id", urls.href_key(F.col("l.href")).alias("href"))
    return sites.contextual_links(links.join(v, "page_id"))


SQL["contextual_links"] = f"""
WITH l AS (SELECT page_id, l.href AS url FROM (SELECT page_id, unnest(links) AS l FROM html_docs) WHERE l.internal),
e AS (SELECT DISTINCT registrable_domain AS site, l.page_id, {oracles._HREF.replace('url', 'v.url')} AS own, {oracles._HREF.replace('url', 'l.url')} AS href FROM l JOIN validated_urls v ON v.page_id = l.page_id),
n AS (SELECT site, count(DISTINCT page_id) AS pages FROM e GROUP BY site), c AS (SELECT site, href FROM e JOIN n USING (site) GROUP BY site, href, pages HAVING count(*) >= greatest(2, ceil(pages * 0.8)))
SELECT page_id, count(*) AS n_links FROM e WHERE href <> own AND NOT EXISTS (SELECT 1 FROM c WHERE c.site = e.site AND c.href = e.href) GROUP BY page_id
"""


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Per site: pages, dated ones and their share, median, oldest and newest age."""
    p = written(site_queries.page_dates(spark, d).join(table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id"))
    out = p.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.count("latest").alias("dated"), F.min("age_days").alias("newest"), F.max("age_days").alias("oldest"))
    return out.join(sites.upper_median(p, "site", "age_days"), "site", "left").withColumn("coverage", F.round(F.col("dated") / F.col("pages"), 3))


SQL["freshness"] = f"""
WITH p AS ({oracles.PAGE_DATES}), s AS (SELECT p.*, registrable_domain AS site FROM p JOIN validated_urls USING (page_id))
SELECT site, count(*) AS pages, count(latest) AS dated, min(age_days) AS newest, max(age_days) AS oldest, list_sort(list(age_days) FILTER (WHERE age_days IS NOT NULL))[CAST(count(latest) // 2 AS INTEGER) + 1] AS median, round(count(latest) / count(*), 3) AS coverage FROM s GROUP BY site
"""


def shared_days(spark: SparkSession, d: str) -> DataFrame:
    """Times at which three pages of a site or more were changed that were published in different years; the
    month of the fetch stands for the day of the change, which these pages don't declare."""
    p = site_queries.page_dates(spark, d).where("published is not null").select("page_id", F.year(F.timestamp_seconds("published")).alias("year"))
    f = table(spark, d, "fetch_results").select("page_id", F.date_format("fetched_at", "yyyy-MM").alias("day")).join(p, "page_id")
    j = f.join(table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id")
    return j.groupBy("site", "day").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("year").alias("years")).where("pages >= 3 and years >= 2")


SQL["shared_days"] = f"""
WITH p AS (SELECT page_id, year(to_timestamp(published)) AS y FROM ({oracles.PAGE_DATES}) WHERE published IS NOT NULL)
SELECT registrable_domain AS site, strftime(fetched_at, '%Y-%m') AS day, count(*) AS pages, count(DISTINCT y) AS years FROM fetch_results JOIN p USING (page_id) JOIN validated_urls USING (page_id) GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT y) >= 2
"""


def fetch_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Every address with whether it was read: skipped where robots close it to all."""
    verdict = site_queries.robots_verdicts(spark, d).where("agent = 'Googlebot'").select("site", "path", "allowed")
    v = table(spark, d, "validated_urls").select("page_id", "url", F.col("registrable_domain").alias("site"), urls.path_of(F.col("url")).alias("path"))
    f = table(spark, d, "fetch_results").select("page_id", "status")
    state = F.when(~F.coalesce("allowed", F.lit(True)), "skipped").when(F.col("status").isNull(), "failed").otherwise("read")
    return v.join(verdict, ["site", "path"], "left").join(f, "page_id", "left").select("page_id", state.alias("state"))


SQL["fetch_inventory"] = f"""
WITH r AS ({oracles.ROBOTS_VERDICTS}), v AS (SELECT page_id, registrable_domain AS site, {oracles.PATH} AS path FROM validated_urls)
SELECT page_id, CASE WHEN NOT coalesce(allowed, true) THEN 'skipped' WHEN status IS NULL THEN 'failed' ELSE 'read' END AS state FROM v LEFT JOIN (SELECT * FROM r WHERE agent = 'Googlebot') r USING (site, path) LEFT JOIN fetch_results f USING (page_id)
"""


def render_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per site: pages with faults, with blocking ones, and their share."""
    f = site_queries.render_faults(spark, d).groupBy("page_id").agg(F.collect_list(F.struct("code", "severity")).alias("faults"))
    h = table(spark, d, "fetch_results").where("body is not null").select("page_id").join(
        table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id",
    ).join(f, "page_id", "left")
    s = render.summary(h.withColumn("faults", F.coalesce("faults", F.array().cast("array<struct<code:string,severity:string>>"))))
    return s.select("site", "pages", "faulted", "blocking", "fault_rate", F.coalesce(F.to_json("by_code"), F.lit("{}")).alias("by_code"))


def threshold_provenance(spark: SparkSession, d: str) -> DataFrame:
    t = sites.calibration(written(site_queries._scored(spark, d))).select("site", "thin_words", "min_headings")
    return reports.thresholds(t, {"absorption_floor": 0.3})


SQL["threshold_provenance"] = f"""
WITH t AS ({oracles.SITE_THRESHOLDS}), e AS (SELECT site, unnest(['thin_words', 'min_headings', 'low_paragraphs', 'absorption_floor', 'render_gap_words']) AS name, unnest([thin_words::DOUBLE, min_headings::DOUBLE, 8.34, 0.3, 120.0]::DOUBLE[]) AS value, unnest(['site-calibrated', 'site-calibrated', 'paper', 'operator', 'paper']) AS source FROM t)
SELECT site, name, value, source, name || '=' || regexp_replace(printf('%.6f', value), '\\.?0+$', '') || ' (' || source || ')' AS provenance FROM e
"""


def exempt_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages by whether they count for a site's score."""
    v = table(spark, d, "validated_urls").select("page_id", urls.page_type(F.col("url")).alias("page_type"))
    scored, exempt = reports.exempt_split(v)
    return scored.select("page_id", F.lit("").alias("reason")).unionByName(exempt.select("page_id", "reason"))


SQL["exempt_pages"] = f"SELECT page_id, CASE WHEN {oracles.TYPE} = 'legal' THEN 'pages of type legal are exempt' ELSE '' END AS reason FROM validated_urls"


# --- reports
NOW = "2026-06-01T00:00:00Z"


def _made(spark: SparkSession, d: str) -> DataFrame:
    """One finding a site and page type, some of them faulty, in two layers with other columns."""
    n = table(spark, d, "validated_urls").groupBy(F.col("registrable_domain").alias("site"), urls.page_type(F.col("url")).alias("check_id")).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col("n") % by + 1).cast("int"))
    f = n.select(
        "site", "check_id", F.concat(F.lit("Pages of type "), "check_id").alias("title"), pick((*fixed.SEVERITIES, "odd"), 6).alias("severity"), (F.col("n") % 4 + 1).cast("int").alias("claim_level"), pick(("high", "medium", "low"), 3).alias("confidence"),
        F.when(F.col("n") % 7 == 0, "").otherwise(F.concat(F.col("n").cast("string"), F.lit(" pages"))).alias("evidence"), pick(("critical", "high", "medium", "low", "none"), 5).alias("priority"), pick(("absorption", "trust"), 2).alias("layer"),
        F.when(F.col("n") % 11 == 0, "").otherwise("Look at them.").alias("action"), F.col("n").cast("int").alias("sample_size"),
    )
    a, b = f.where("layer = 'absorption'"), f.where("layer = 'trust'").drop("sample_size")
    return findings.numbered(reports.rehydrated(reports.concatenated(a, b)))


_TYPES_SQL = f"SELECT registrable_domain AS site, {oracles.TYPE} AS check_id, count(*) AS n FROM validated_urls GROUP BY 1, 2"
_RANK = lambda c, names: f"coalesce(list_position([{', '.join(map(_q, names))}], {c}), 99)"
_CAP = lambda s, lv: f"CASE WHEN {_RANK(  # noqa: E731
    s, fixed.SEVERITIES,
)} < CASE {lv} WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 5 END THEN CASE {lv} WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'info' END ELSE {s} END"
MADE = f"""
n AS ({_TYPES_SQL}),
r AS (SELECT site, check_id, 'Pages of type ' || check_id AS title, ['critical', 'high', 'medium', 'low', 'info', 'odd'][n % 6 + 1] AS raw, CAST(n % 4 + 1 AS INTEGER) AS claim_level, ['high', 'medium', 'low'][n % 3 + 1] AS confidence, CASE WHEN n % 7 = 0 THEN '' ELSE n || ' pages' END AS evidence,
  ['critical', 'high', 'medium', 'low', 'none'][n % 5 + 1] AS priority, ['absorption', 'trust'][n % 2 + 1] AS layer, CASE WHEN n % 11 = 0 THEN '' ELSE 'Look at them.' END AS action FROM n),
c AS (SELECT *, {_CAP('raw', 'claim_level')} AS severity FROM r),
made AS (SELECT *, 'F-' || lpad(CAST(row_number() OVER (PARTITION BY site ORDER BY {_RANK('severity', fixed.SEVERITIES)}, {_RANK('layer', findings.LAYERS)}, {_RANK('confidence', findings.CONFIDENCES)}, title, check_id) AS VARCHAR), 3, '0') AS id FROM c)"""


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("site", "id", "check_id", "severity", "claim_level", "confidence", "layer", F.col("sample_size").isNull().alias("no_size"))


SQL["report_rows"] = f"WITH {MADE} SELECT site, id, check_id, severity, claim_level, confidence, layer, layer = 'trust' AS no_size FROM made"


def report_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Counts by severity with zeros, and each site's scores."""
    s = reports.summaries(_made(spark, d), F.lit(NOW))
    return reports.site_scores(site_queries.readiness_rollup(spark, d).select("site", "median"), s).select("site", "audited_at", "total_findings", *fixed.SEVERITIES, "median")


SQL["report_summaries"] = f"WITH {MADE}, s AS (SELECT site, '{NOW}' AS audited_at, count(*) AS total_findings, {', '.join(f'count(*) FILTER (WHERE severity = {_q(x)}) AS {x}' for x in fixed.SEVERITIES)} FROM made GROUP BY site) SELECT s.*, median FROM s LEFT JOIN (SELECT site, median FROM ({oracles.READINESS_ROLLUP})) USING (site)"


def report_errors(spark: SparkSession, d: str) -> DataFrame:
    f = _made(spark, d)
    s = reports.summaries(f, F.lit(NOW)).withColumn("high", F.col("high") + F.when(F.length("site") % 2 == 0, 1).otherwise(0))
    return reports.row_errors(f).unionByName(reports.summary_errors(f, s))


_PRI = _RANK("priority", findings.PRIORITIES)
_ERRORS = {
    "no evidence": "evidence = ''", "no action": "action = ''", "unknown severity": "severity = 'odd'", "unknown priority": "priority = 'none'",
    "causal claim": "claim_level = 4", "priority above severity": f"least({_PRI}, 5) < least({_RANK('severity', fixed.SEVERITIES)}, 6)",
}
SQL["report_errors"] = f"""
WITH {MADE} SELECT site, id, error FROM (SELECT site, id, unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {_q(n)} END' for n, c in _ERRORS.items())}], lambda e: e IS NOT NULL)) AS error FROM made)
UNION ALL SELECT DISTINCT site, NULL, 'count of high differs' FROM made WHERE length(site) % 2 = 0
"""


def _dropped(f: DataFrame) -> DataFrame:
    return f.where("check_id = 'article'").select("site", "check_id")


def report_verdicts(spark: SparkSession, d: str) -> DataFrame:
    f = _made(spark, d)
    return reports.verdicts(f, reports.summaries(f, F.lit(NOW)), _dropped(f))


SQL["report_verdicts"] = f"""
WITH {MADE}, e AS (SELECT site, unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {_q(n)} END' for n, c in (_ERRORS | {'dropped': "check_id = 'article'"}).items())}], lambda e: e IS NOT NULL)) AS error FROM made),
k AS (SELECT site, count(*) AS issues, count(*) FILTER (WHERE error NOT IN ('no evidence', 'no action', 'unknown severity')) AS repairable FROM e GROUP BY site)
SELECT site, coalesce(issues, 0) AS issues, coalesce(repairable, 0) AS repairable, CASE WHEN coalesce(issues, 0) = 0 THEN 'ACCEPT' WHEN issues = repairable THEN 'REPAIR' ELSE 'REGENERATE' END AS verdict FROM (SELECT DISTINCT site FROM made) LEFT JOIN k USING (site)
"""


def report_repaired(spark: SparkSession, d: str) -> DataFrame:
    f = _made(spark, d)
    return reports.repaired(f, _dropped(f)).select("site", "id", "check_id", "severity", "claim_level", "priority")


SQL["report_repaired"] = f"""
WITH {MADE}, k AS (SELECT *, CASE WHEN severity = 'info' THEN 'low' ELSE severity END AS most FROM made WHERE check_id <> 'article' AND claim_level < 4),
p AS (SELECT site, check_id, title, layer, confidence, severity, claim_level, CASE WHEN priority = 'none' OR least({_PRI}, 5) < least({_RANK('most', findings.PRIORITIES)}, 5) THEN most ELSE priority END AS priority FROM k)
SELECT site, 'F-' || lpad(CAST(row_number() OVER (PARTITION BY site ORDER BY {_RANK('severity', fixed.SEVERITIES)}, {_RANK('layer', findings.LAYERS)}, {_RANK('confidence', findings.CONFIDENCES)}, title, check_id) AS VARCHAR), 3, '0') AS id, check_id, severity, claim_level, priority FROM p
"""


def report_charts(spark: SparkSession, d: str) -> DataFrame:
    """The series of a report's charts."""
    v = table(spark, d, "validated_urls")
    mix = v.groupBy(F.col("registrable_domain").alias("site"), urls.page_type(F.col("url")).alias("label")).agg(F.count(F.lit(1)).alias("value"))
    s = written(site_queries._scored(spark, d))
    each = s.groupBy("site").agg(*(F.count_if(F.col(f"n_{g}") >= fixed.GENRES[g][1]).alias(g) for g in fixed.POSITIVE_GENRES))
    genre = each.select("site", F.inline(F.array(*(F.struct(F.lit(g).alias("label"), F.col(g).alias("value")) for g in fixed.POSITIVE_GENRES))))
    medians = sites.upper_median(s, "site", "score").select("site", F.lit("median").alias("label"), F.round("median", 3).alias("value"))
    return reports.chart_series(_made(spark, d), mix, genre, medians)


SQL["report_charts"] = f"""
WITH {MADE}, {oracles.SCORED.strip()}, st AS (SELECT DISTINCT site FROM made)
SELECT st.site, 'severity' AS chart, label, count(m.id)::DOUBLE AS value FROM (SELECT site, unnest([{', '.join(map(_q, fixed.SEVERITIES))}]) AS label FROM st) st LEFT JOIN made m ON m.site = st.site AND m.severity = label GROUP BY 1, 2, 3
UNION ALL SELECT st.site, 'layer', label, count(m.id)::DOUBLE FROM (SELECT site, unnest([{', '.join(map(_q, findings.LAYERS))}]) AS label FROM st) st LEFT JOIN made m ON m.site = st.site AND m.layer = label GROUP BY 1, 2, 3
UNION ALL SELECT site, 'page_type', check_id, n::DOUBLE FROM n
UNION ALL SELECT site, 'genre', label, value::DOUBLE FROM (SELECT site, unnest([{', '.join(map(_q, fixed.POSITIVE_GENRES))}]) AS label, unnest([{', '.join(f'count(*) FILTER (WHERE n_{g} >= {fixed.GENRES[g][1]})' for g in fixed.POSITIVE_GENRES)}]) AS value FROM scored GROUP BY site)
UNION ALL SELECT site, 'median_score', 'median', round(list_sort(list(score))[CAST(count(*) // 2 AS INTEGER) + 1], 3) FROM scored GROUP BY site
"""


def report_rejections(spark: SparkSession, d: str) -> DataFrame:
    f = _made(spark, d).withColumn("drop_reason", F.when(F.col("evidence") == "", "no evidence"))
    return reports.rejection_rate(f)


SQL["report_rejections"] = f"WITH {MADE} SELECT site, count(*) AS given, count(*) FILTER (WHERE evidence = '') AS dropped, round(count(*) FILTER (WHERE evidence = '') / count(*), 3) AS rate FROM made GROUP BY site"


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each site's report as JSON, Markdown and HTML."""
    f = _made(spark, d).drop("id", "position")
    s = reports.summaries(f, F.lit(NOW))
    return reports.as_json(f, s).join(reports.as_markdown(f, s), "site").join(reports.as_html(f, s), "site")


def report_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What is in the reports' texts: findings in the JSON, headings in the Markdown, rows in the HTML."""
    t = report_texts(spark, d)
    return t.select(
        "site", F.size(F.try_variant_get(F.try_parse_json("json"), "$.findings", "array<variant>")).alias("in_json"),
        F.regexp_count("markdown", F.lit("(?m)^### F-[0-9]{3} ")).alias("in_markdown"), F.regexp_count("html", F.lit("<tr><td>F-")).alias("in_html"),
    )


SQL["report_sizes"] = f"WITH {MADE} SELECT site, count(*)::INTEGER AS in_json, count(*)::INTEGER AS in_markdown, count(*)::INTEGER AS in_html FROM made GROUP BY site"


def evidence_texts(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with its first examples."""
    f = table(spark, d, "validated_urls").select("page_id", "url", "notes")
    return f.select("page_id", text.with_examples(F.lit("See"), F.array_repeat("url", (F.col("page_id") % 6).cast("int"))).alias("evidence"))


SQL["evidence_texts"] = "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'See' ELSE 'See (e.g. ' || array_to_string(list_resize([url, url, url], least(3, page_id % 6)::INTEGER), ', ') || CASE WHEN page_id % 6 > 3 THEN ' and ' || (page_id % 6 - 3) || ' more' ELSE '' END || ')' END AS evidence FROM validated_urls"


def run_limitations(spark: SparkSession, d: str) -> DataFrame:
    """What the errors of fetching mean for the reader of a site's report."""
    f = table(spark, d, "fetch_results").join(table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id")
    return reports.limitations(f.select("site", F.col("error_code").alias("note")))


_MEANING = "CASE " + " ".join(f"WHEN contains(lower(error_code), {_q(p)}) THEN {_q(m)}" for p, m in reports.LIMITATIONS.items()) + " ELSE error_code END"
SQL["run_limitations"] = f"SELECT DISTINCT registrable_domain AS site, {_MEANING} AS limitation FROM fetch_results JOIN validated_urls USING (page_id) WHERE error_code IS NOT NULL"


def liveness(spark: SparkSession, d: str) -> DataFrame:
    """Per site, answers of a good, a broken and a redirecting sort, and the share of broken ones."""
    f = table(spark, d, "fetch_results").where("status is not null").select("page_id", "status", F.coalesce(F.array_size("redirect_chain"), F.lit(0)).alias("hops")).join(
        table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site")), "page_id",
    )
    out = f.groupBy("site").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") >= 400).alias("broken"), F.count_if(F.col("hops") > 0).alias("redirecting"))
    return out.withColumn("rate", F.round(F.col("broken") / F.col("checked"), 3))


SQL["liveness"] = "SELECT registrable_domain AS site, count(*) AS checked, count(*) FILTER (WHERE status >= 400) AS broken, count(*) FILTER (WHERE len(redirect_chain) > 0) AS redirecting, round(count(*) FILTER (WHERE status >= 400) / count(*), 3) AS rate FROM fetch_results JOIN validated_urls USING (page_id) WHERE status IS NOT NULL GROUP BY 1"


def sitemap_uniques(spark: SparkSession, d: str) -> DataFrame:
    """Per site, the locs of its sitemaps once each, and how many more there are."""
    each = table(spark, d, "sitemap_entries").where("loc is not null").groupBy(F.col("registrable_domain").alias("site"), "loc").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("site").agg(F.count(F.lit(1)).alias("locs"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"), F.min("loc").alias("first"))


SQL["sitemap_uniques"] = "SELECT registrable_domain AS site, count(DISTINCT loc) AS locs, count(*) - count(DISTINCT loc) AS repeated, min(loc) AS first FROM sitemap_entries WHERE loc IS NOT NULL GROUP BY 1"


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Each document's beginning, and whether it claims causes and hedges."""
    t = spread(table(spark, d, "documents").select("doc_id", "text"))
    low = F.coalesce("text", F.lit(""))
    return t.select(
        "doc_id", text.snippet(F.col("text"), 60).alias("snippet"), low.rlike(f"(?i){findings.CAUSAL}").alias("causal"),
        low.rlike(f"(?i){findings.HEDGED}").alias("hedged"),
    )


_FLAT = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1680}\\x{0085}]+', ' ', 'g'), ' ')"
SQL["snippets"] = f"SELECT doc_id, CASE WHEN length({_FLAT}) <= 60 THEN {_FLAT} ELSE rtrim(({_FLAT})[:59], ' ') || '…' END AS snippet, regexp_matches(coalesce(text, ''), {_q('(?i)' + findings.CAUSAL)}) AS causal, regexp_matches(coalesce(text, ''), {_q('(?i)' + findings.HEDGED)}) AS hedged FROM documents"

_PLAIN = (
    "s", "thin_content", "Thin", "high", 1, "high", "5 of 9 pages have under 170 words, for example https://a.com/1", "5 of 9 pages", "", 9,
    ["https://a.com/1"], "Write more on these pages.", "", "high", "absorption",
)
# A finding's changed fields, and what the gates must make of it: reason, severity, level, confidence, priority.
REVIEWS = (
    ({}, (None, "high", 1, "high", "high")),
    ({"evidence": "short"}, ("evidence too short", "high", 1, "high", "high")),
    ({"evidence": "Many pages of this site have next to no words on them.", "urls": []}, ("no URL", "high", 1, "high", "high")),
    ({"evidence": "Many pages have next to no words, such as https://a.com/", "observed": ""}, ("no observed value", "high", 1, "high", "high")),
    ({"action": "Write."}, ("action too vague", "high", 1, "high", "high")),
    ({"observed": "2000 ms", "expected": "under 3000 ms", "evidence": "The median response of this site was 2000 ms at https://a.com/1"}, ("expectation is met", "high", 1, "high", "high")),
    ({"check_id": "slow_response", "observed": "2500 ms", "expected": "", "evidence": "The median response of this site was 2500 ms at https://a.com/1"}, ("within the expectation", "high", 1, "high", "high")),
    ({"check_id": "noindex_on_public_page", "urls": ["https://a.com/cart", "https://a.com/login"]}, ("noindex is right on these routes", "high", 1, "high", "high")),
    ({"check_id": "sitemap_orphans", "observed": "1 of 2 pages"}, ("too few crawled pages", "high", 1, "high", "high")),
    ({"claim_level": 4}, ("causal prescription", "info", 4, "high", "low")),
    ({"sample_size": 2}, (None, "medium", 1, "low", "medium")),
    ({"sample_size": 2, "observed": "two pages", "evidence": "Both pages of the site have under 170 words: https://a.com/1"}, ("sample too small", "medium", 1, "low", "medium")),
    ({"evidence": "This will increase reach on 5 of 9 pages such as https://a.com/1"}, (None, "medium", 3, "high", "medium")),
    ({"evidence": "This may well increase reach on 5 of 9 pages such as https://a.com/1"}, (None, "high", 1, "high", "high")),
    ({"severity": "critical", "claim_level": 2}, (None, "high", 2, "high", "high")),
    ({"severity": "low", "priority": "critical"}, (None, "low", 1, "high", "low")),
)


def _reviewed(spark: SparkSession, changes: list[dict]) -> DataFrame:
    rows = [(i, *(c.get(n, v) for n, v in zip(reports.COLUMNS, _PLAIN, strict=True))) for i, c in enumerate(changes)]
    kinds = {"claim_level": "int", "sample_size": "int", "urls": "array<string>"}
    return spark.createDataFrame(rows, "finding_no bigint, " + ", ".join(f"{n} {kinds.get(n, 'string')}" for n in reports.COLUMNS))


def review_gates(spark: SparkSession, d: str) -> DataFrame:
    """What the review makes of findings that differ in one point."""
    return findings.review(_reviewed(spark, [c for c, _ in REVIEWS])).select("finding_no", "drop_reason", "severity", "claim_level", "confidence", "priority")


_V = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else _q(x)
SQL["review_gates"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {', '.join(map(_V, w))})" for i, (_, w) in enumerate(REVIEWS)) + ") t(finding_no, drop_reason, severity, claim_level, confidence, priority)"


def merged_findings(spark: SparkSession, d: str) -> DataFrame:
    """Symptoms that their cause absorbs: those whose pages all are among the cause's."""
    both = ["https://a.com/1", "https://a.com/2"]
    f = _reviewed(
        spark,
        [{"check_id": "empty_shell", "title": "Shell", "severity": "critical", "priority": "critical", "urls": both}, {}, {"urls": ["https://a.com/9"], "title": "Other"}, {"check_id": "no_evidence_genre", "title": "Bare", "urls": both}, {"site": "t"}],
    )
    return findings.numbered(findings.merged(f)).select("site", "id", "finding_no", F.array_join("consequences", ",").alias("consequences"))


SQL["merged_findings"] = "SELECT * FROM (VALUES ('s', 'F-001', 0::BIGINT, 'Bare,Thin'), ('s', 'F-002', 2::BIGINT, NULL), ('t', 'F-001', 4::BIGINT, NULL)) t(site, id, finding_no, consequences)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        url_vectors, url_variants, saved_page_notes, latest_fetches, page_and_byte_budget, decoded_bodies, affordable_samples, sitemap_files, robots_reports, external_hosts, contextual_links, freshness, shared_days, fetch_inventory, render_summary,
        threshold_provenance, exempt_pages, report_rows, report_summaries, report_errors, report_verdicts, report_repaired, report_charts, report_rejections, report_texts, report_sizes, evidence_texts, run_limitations, liveness, sitemap_uniques, snippets, review_gates, merged_findings,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return SQL
