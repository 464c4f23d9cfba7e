from pyspark.sql import functions as F

from siltstone.operators import findings, render, reports, robots, sitemaps, sites

TEXT = "# c\nUser-agent: A\nUser-agent: b\nDisallow: /x\nAllow: /x/y$\nCrawl-delay: no\nUser-agent: *\nSitemap: https://s\nDisallow: /\nnonsense\n"


def test_robots(spark):
    d = robots.lines(spark.createDataFrame([("s", "Disallow: /early\n" + TEXT), ("none", None)], "site string, text string"))
    assert {(r.line, r.error) for r in robots.errors(d).collect()} == {(1, "before any group"), (7, "non-numeric crawl-delay"), (11, "unparseable")}
    agents = spark.createDataFrame([("Abc",), ("zzz",)], "agent string")
    g = robots.agent_groups(d, agents)
    assert {(r.agent, r.group_no, r.explicitly_named) for r in g.collect()} == {("Abc", 1, True), ("zzz", 2, False)}
    paths = spark.createDataFrame([("s", p) for p in ("/x", "/x/y", "/x/yz", "/q")], "site string, path string")
    got = {(r.agent, r.path): r.allowed for r in robots.verdicts(robots.rules(d), g, paths).collect()}
    assert got == {("Abc", "/x"): False, ("Abc", "/x/y"): True, ("Abc", "/x/yz"): False, ("Abc", "/q"): True, **{("zzz", p): False for p in ("/x", "/x/y", "/x/yz", "/q")}}
    assert {(r.group_no, r.blocks_all) for r in robots.blocks_everything(robots.rules(d)).collect()} == {(1, False), (2, True)}


def test_robots_patterns(spark):
    cases = [("/a", "/ab", True), ("/a$", "/ab", False), ("/a$", "/a", True), ("/*.pdf$", "/x/y.pdf", True), ("/*.pdf$", "/x/y.pdfx", False), ("/a_b", "/axb", False), ("/50%", "/50%x", True), ("/50%", "/50x", False), ("/a*b*c", "/a1b2c3", True), ("/a*", "/a", True), ("/ab*ba$", "/aba", False), ("", "/a", False), ("/" + "*a" * 20 + "$", "/" + "a" * 2000 + "b", False)]
    rows = spark.createDataFrame(cases, "rule string, path string, want boolean").select("want", robots.matches(F.col("rule"), F.col("path")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_sitemaps(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.com/1 </loc><lastmod>2024</lastmod></url><url><x/></url></urlset>'
    f = sitemaps.parse_files(spark.createDataFrame([("u", xml), ("v", "<loc>https://a.com/2</loc>"), ("w", "<sitemapindex><loc>c</loc></sitemapindex>"), ("n", None)], "url string, xml string"))
    got = {r.url: r for r in f.collect()}
    assert got["u"].entries[0].loc == "https://a.com/1" and got["u"].errors == [] and len(got["v"].entries) == 1 and got["w"].is_index and got["w"].children == ["c"] and got["n"].entries == []
    e = spark.createDataFrame([("a.com", "https://a.com/1", "2024-01-01"), ("a.com", "https://a.com/1", "2020-01-01"), ("a.com", "http://a.com/2#f", "bad"), ("a.com", "https://b.com/", None), ("a.com", None, None)], "registrable_domain string, loc string, lastmod string")
    now = F.to_timestamp(F.lit("2024-01-11"))
    r = sitemaps.lastmod_stats(e, now).first()
    assert (r.entries, r.dated, r.invalid, r.median_age, r.newest_age) == (5, 2, 1, 1471, 10)
    assert {(x.code, x.n) for x in sitemaps.problems(e, now).collect()} == {("sitemap_duplicates", 1), ("sitemap_off_scope", 1), ("sitemap_scheme_mismatch", 1), ("sitemap_fragments", 1), ("sitemap_bad_lastmod", 1)}
    pages = spark.createDataFrame([("https://a.com/1/",), ("https://a.com/9",)], "url string")
    assert [x.url for x in sitemaps.orphans(pages, e).collect()] == ["https://a.com/9"]
    assert sitemaps.lastmod_stats(e.where("false"), now).count() == 0


def test_render_faults(spark):
    html = ['<div id="root"></div>', "<p>" + "word " * 300 + "</p>", '<script>window.__NEXT_DATA__ = {"a": "' + "some text here " * 60 + '"}</script>', '<a href="#/x"></a> react-router react-dom/']
    p = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "id int, body string").select("id", render.trapped_chars(F.col("body")).alias("trapped"), F.inline(F.array(render.signals(F.col("body")))), F.lit("t").alias("title"), F.lit(None).cast("string").alias("description"), F.when(F.col("id") == 1, 300).otherwise(0).alias("words"), F.when(F.col("id") == 1, 1500).otherwise(0).alias("text_chars"), *(F.lit(0).alias(x) for x in ("inline_script_chars", "noscript_chars", "paragraphs", "images", "images_missing_alt")))
    got = {r.id: {f.code for f in r.faults} for r in render.faults(p).collect()}
    assert got == {0: {"empty_shell"}, 1: set(), 2: {"state_blob"}, 3: {"thin_served_html", "noscript_gap", "client_routing"}}


def test_samples_and_medians(spark):
    c = spark.createDataFrame([("s", t, i) for i, t in enumerate(["homepage", "homepage", "docs", "docs", "other", "article"])], "site string, page_type string, ordinal int")
    assert [(r.page_type, r.ordinal) for r in sites.round_robin(c, 4).orderBy("pick").collect()] == [("homepage", 0), ("article", 5), ("docs", 2), ("other", 4)]
    assert sites.round_robin(c, 6).count() == 6
    v = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 5), ("b", None)], "k string, v int")
    assert {tuple(r) for r in sites.upper_median(v, "k", "v").collect()} == {("a", 3), ("b", 5)}
    b = sites.budgeted(spark.createDataFrame([("s", i, 10) for i in range(5)], "site string, ordinal int, n int"), F.col("n"), 25)
    assert sorted(r.ordinal for r in b.collect()) == [0, 1, 2]


def finding(**over):
    base = {"site": "s", "check_id": "thin_content", "title": "Thin", "severity": "high", "claim_level": 1, "confidence": "high", "evidence": "5 of 9 pages have under 170 words, for example https://a.com/1", "observed": "5 of 9 pages", "expected": "", "sample_size": 9, "urls": ["https://a.com/1"], "action": "Write more on these pages.", "mechanism": "", "priority": "high", "layer": "absorption", "finding_no": 1}
    return base | over


SCHEMA = "site string, check_id string, title string, severity string, claim_level int, confidence string, evidence string, observed string, expected string, sample_size int, urls array<string>, action string, mechanism string, priority string, layer string, finding_no bigint"


def frame(spark, *rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(finding(**r)[n] for n in names) for r in rows], SCHEMA)


def test_review_gates(spark):
    got = {r.finding_no: r for r in findings.review(frame(spark, {"finding_no": 1}, {"finding_no": 2, "evidence": "short"}, {"finding_no": 3, "claim_level": 4}, {"finding_no": 4, "observed": "2000 ms", "expected": "under 3000 ms", "evidence": "The median response of this site was 2000 ms at https://a.com/1"}, {"finding_no": 5, "evidence": "This will increase reach on 5 of 9 pages such as https://a.com/1"}, {"finding_no": 6, "sample_size": 2}, {"finding_no": 7, "severity": "critical", "claim_level": 2}, {"finding_no": 8, "severity": "low", "priority": "critical"})).collect()}
    assert got[1].drop_reason is None and got[2].drop_reason == "evidence too short" and got[3].drop_reason == "causal prescription" and got[4].drop_reason == "expectation is met"
    assert (got[5].severity, got[5].claim_level) == ("medium", 3) and (got[6].severity, got[6].confidence) == ("medium", "low") and got[7].severity == "high" and got[8].priority == "low"


def test_merge_number_validate(spark):
    f = frame(spark, {"finding_no": 1, "check_id": "empty_shell", "title": "Shell", "severity": "critical", "priority": "critical", "urls": ["https://a.com/1", "https://a.com/2"]}, {"finding_no": 2}, {"finding_no": 3, "urls": ["https://a.com/9"], "title": "Other"})
    m = findings.merged(f)
    assert {(r.finding_no, tuple(r.consequences or ())) for r in m.collect()} == {(1, ("Thin",)), (3, ())}
    n = findings.numbered(m)
    assert {(r.finding_no, r.id) for r in n.collect()} == {(1, "F-001"), (3, "F-002")} and reports.row_errors(n).count() == 0
    c = findings.severity_counts(n).first()
    assert (c.critical, c.high, c.medium, c.low, c.info, c.total) == (1, 1, 0, 0, 0, 2)
    assert {r.error for r in reports.row_errors(n.withColumn("severity", F.lit("bad"))).collect()} >= {"unknown severity"}


def test_streams(spark, tmp_path):
    from siltstone.streaming.pages import page_features, windowed

    spark.createDataFrame([(1, "<p>a</p>", "https://www.a.com/docs/x")], "page_id int, body string, final_url string").write.parquet(str(tmp_path / "p"))
    q = page_features(spark.readStream.schema("page_id int, body string, final_url string").parquet(str(tmp_path / "p"))).writeStream.format("memory").queryName("pf").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r.site, r.page_type) for r in spark.sql("select * from pf").collect()] == [("a.com", "docs")]
    e = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'v' event_type, 1.0D value union all select timestamp'2024-01-01 00:50:00', 'v', 2.0D")
    assert [(r.n, r.value) for r in windowed(e, "1 hour").collect()] == [(2, 3.0)]
