import pytest
from pyspark.sql import functions as F

from siltstone.functions import dates, fixed, hosts, markup, scores, text, urls
from siltstone.operators import html


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        ("", "empty"), ("  ", "empty"), (None, "empty"), ("ftp://a.com/", "bad_scheme"), ("https://u:p@a.com/", "embedded_credentials"), ("https:///x", "no_host"), ("http://169.254.169.254/", "blocked_host"), ("http://localhost/", "blocked_host"), ("https://a.internal/", "reserved_suffix"),
        ("http://2130706433/", "obfuscated_ip_decimal"), ("http://0x7f000001/", "obfuscated_ip_hex"), ("http://0177.0.0.1/", "obfuscated_ip_octal"), ("http://192.168.1.1/", "private_ip"), ("http://100.64.0.1/", "private_ip"), ("https://single/", "not_fqdn"), ("https://-a.com/", "bad_label"), ("https://a.com:22/", "bad_port"),
        ("https://a.com/" + "x" * 2100, "too_long"), ("a.com", None), ("//a.com/x", None), ("<https://a.com>", None), ("http://[fd00::1]/", "private_ip"), ("http://[fe80::1]/", "private_ip"), ("http://[::1]/", "blocked_host"), ("http://[::ffff:127.0.0.1]/", "private_ip"), ("http://[64:ff9b::7f00:1]/", "private_ip"), ("http://[64:ff9b::a9fe:a9fe]/", "private_ip"), ("http://[64:ff9b::c0a8:101]/", "private_ip"), ("http://[2606:4700::1111]/", None), ("http://100.100.100.200/", "blocked_host"), ("http://172.16.0.1/", "private_ip"), ("file:///etc/passwd", "bad_scheme"), ("gopher://x.com/", "bad_scheme"), ("javascript:alert(1)", "not_fqdn"), ("http://box.local/", "reserved_suffix"), ("http://0.0.0.0/", "blocked_host"), ("https://a..com/", "bad_idna"), ("https://münchen.de/", None), ("  https://example.com  ", None), ("https://sub.domain.co.uk/a?q=1", None), ("http://neverssl.com/", None), ("https://www.adobe.com/products", None), ("https://a.com:8443/x?y#z", None), ("http://8.8.8.8/", None),
    ],
)
def test_reject_code(spark, raw, code):
    assert one(spark, raw, urls.reject_code) == code


@pytest.mark.parametrize(("host", "domain"), [("a.b.co.uk", "b.co.uk"), ("www.x.com", "x.com"), ("x.com", "x.com"), ("a.b.c.com.au", "c.com.au"), ("10.1.2.3", "10.1.2.3"), ("a.b.info", "b.info"), ("", "")])
def test_registrable_domain(spark, host, domain):
    assert one(spark, host, urls.registrable_domain) == domain


@pytest.mark.parametrize(("url", "kind"), [("https://a.com", "homepage"), ("https://a.com/", "homepage"), ("https://a.com/products", "other"), ("https://a.com/products/x", "product"), ("https://a.com/pricey", "pricing"), ("https://a.com/blog/x", "article"), ("https://a.com/docs/x?y", "docs"), ("https://a.com/privacy", "legal"), ("https://a.com/tag/x", "category")])
def test_page_type(spark, url, kind):
    assert one(spark, url, urls.page_type) == kind


@pytest.mark.parametrize(("ip", "public"), [("8.8.8.8", True), ("64:ff9b::808:808", True), ("64:ff9b::7f00:1", False), ("::ffff:10.0.0.1", False), ("100.64.0.1", False), ("nonsense", None), ("2606:4700::1111", True), ("64:ff9b::23be:6b3", True), ("64:ff9b::a9fe:a9fe", False), ("64:ff9b::c0a8:101", False), ("64:ff9b::6440:101", False), ("2002:7f00:1::", False), ("2001:0:1:2:3:4:f5ff:fffe", False), ("2001:db8::1", False), ("fe80::1%eth0", False), ("::", False), ("ff02::1", False), ("1:2:3:4:5:6:7", None), ("1::2::3", None), ("256.1.1.1", None), ("192.0.0.9", True), (None, None)])
def test_public_ip(spark, ip, public):
    assert one(spark, ip, urls.is_public_ip) is public


def test_canonical_keys(spark):
    assert one(spark, "HTTP://A.com:80/x?q#f", urls.canonical) == "http://a.com/x?q"
    assert one(spark, "https://a.com/x/#f", urls.dedupe_key) == "https://a.com/x"
    assert one(spark, "https://a.com/a%20b%41/ü?q=%20", urls.canonical) == "https://a.com/a%20bA/%C3%BC?q=%20"
    assert one(spark, "https://A.com/x/?q", urls.robots_url) == "https://a.com/robots.txt" and one(spark, "https://a.com/x", urls.other_scheme) == "http://a.com/x" and one(spark, "www.a.com", urls.other_host) == "a.com" and one(spark, "a.com", urls.other_host) == "www.a.com"
    assert one(spark, "https://A.com/x/?q", urls.href_key) == "https://a.com/x"
    assert one(spark, "https://a.com//x/y/", urls.path_depth) == 2


def test_genres_and_bands(spark):
    t = "X is defined as y. It refers to z. Compared to a, versus b. It costs 12% of $5 and 1,200 users. According to me, updated 2024."
    row = spark.createDataFrame([(t,)], "t string").select(*text.genre_counts(F.col("t"))).withColumn("g", text.genres(fixed.POSITIVE_GENRES)).first()
    assert row.n_definition == 2 and row.n_comparison == 2 and row.n_numeric >= 3 and row.n_citation == 1 and row.n_dated == 1
    assert row.g == ["definition", "comparison", "numeric"]
    null = spark.createDataFrame([(None,)], "t string").select(*text.genre_counts(F.col("t"))).first()
    assert set(null) == {0}
    assert one(spark, 101, lambda w: text.word_band(w)["band"], "int") == "101-300" and one(spark, 5000, lambda w: text.word_band(w)["band"], "int") == ">3000"


def test_claims_and_snippets(spark):
    got = one(spark, "Short 5%. We are the leading maker of small boats here. About 40% of boats are sold in the spring!\nNothing of note happens in this sentence.", text.claims)
    assert [c.kind for c in got] == ["superlative", "statistic"]
    assert one(spark, "a  b\nc", lambda x: text.snippet(x, 10)) == "a b c" and one(spark, "abcdefgh", lambda x: text.snippet(x, 5)) == "abcd…"


@pytest.mark.parametrize(("n", "want"), [(0, 0.0), (1, 0.245), (2, 0.5), (5, 0.75), (8, 1.0), (50, 1.0)])
def test_graded(spark, n, want):
    assert one(spark, n, lambda c: scores.graded(c, 2, 8), "int") == pytest.approx(want)


def test_scores_stay_in_range(spark):
    df = spark.range(0, 400, 7).select(*(F.col("id").alias(x) for x in "abcde"))
    rows = df.select(scores.readiness(*(F.col(x) for x in "abcde")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows)
    caps = spark.sql("select * from (values ('critical',1),('critical',2),('high',3),('low',3),('high',4),('high',9)) t(s, l)").select(scores.capped(F.col("s"), F.col("l")).alias("c")).collect()
    assert [r.c for r in caps] == ["critical", "high", "medium", "low", "info", "info"]


@pytest.mark.parametrize(("host", "family"), [("www.bbc.com", "news_media"), ("netflix.com", "social"), ("edu", "academic"), ("mit.edu", "academic"), ("microsoft.com", "news_media"), ("example.org", "other"), (None, None)])
def test_host_family(spark, host, family):
    assert one(spark, host, hosts.host_family) == family


def test_forms(spark):
    assert one(spark, "Acme Corp., Ltd", hosts.name_form) == "acme" and one(spark, "+1 (555) 010-2030", hosts.phone_form) == "5550102030" and one(spark, "https://schema.org/Thing", hosts.bare_type) == "Thing"


def test_dates(spark):
    w3c = lambda x: one(spark, x, dates.w3c_date)
    assert w3c("2026-06").valid and str(w3c("2024-01-02T03:04:05+01:00").parsed) == "2024-01-02 02:04:05" and not w3c("2024/01/02").valid and w3c("").valid and w3c(None).parsed is None and not w3c("2024-13-01").valid
    parse = lambda x: one(spark, x, dates.parse_date)
    assert str(parse("2024-05-06T07:08:09+02:00")) == "2024-05-06 05:08:09" and str(parse("2024-05-06 07:08")) == "2024-05-06 07:08:00" and str(parse("Mon, 06 May 2024 10:00:00 GMT")) == "2024-05-06 10:00:00" and str(parse("Mon, 06 May 2024 10:00:00 +0200")) == "2024-05-06 08:00:00" and str(parse("31/12/2023")) == "2023-12-31 00:00:00" and str(parse("2024-05")) == "2024-05-01 00:00:00" and str(parse("2024")) == "2024-01-01 00:00:00" and parse("Feb 30, 2024") is None and str(parse("2024-05-06T07:08:09.5Z")) == "2024-05-06 07:08:09.500000" and str(parse("May 3, 2024")) == "2024-05-03 00:00:00" and str(parse("2024-05-06T07Z")) == "2024-05-06 07:00:00"
    assert str(parse("3 March 2024")) == "2024-03-03 00:00:00" and str(parse("02/03/2024")) == "2024-02-03 00:00:00" and parse("abc") is None and parse(None) is None


def test_markup(spark):
    m = '<html><head><script src="a.js"></script><script src="b.js" async="x"></script><link rel="stylesheet" href="c"></head><div id="root"></div><img width=1 height=2><img src=x>'
    assert one(spark, m, markup.empty_mount) and one(spark, m, lambda x: markup.head_counts(x)["sync_scripts"]) == 1 and one(spark, m, lambda x: markup.image_counts(x)["unsized"]) == 1
    assert one(spark, None, markup.frameworks) == [] and one(spark, '<a B="c" d=\'e\' f=g hidden>', markup.attributes) == {"b": "c", "d": "e", "f": "g"}


def test_html_rules():
    p = lambda h: html.parse(h, "https://a.com/x")
    assert p("<p>a<b>b</b></p>")["paragraphs"] == ["a b"] and p("<p>x<br>y</p>")["paragraphs"] == [] and p("<ul><li>k</li></ul>")["list_items"] == ["k"]
    d = p('<title> T </title><nav>menu</nav><main><h1>H</h1><p>long text of the page here</p></main><script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{x</script><a href="/q" rel=nofollow>go</a>')
    assert d["title"] == "T" and d["main_text"] == "H\nlong text of the page here\ngo" or d["main_text"].startswith("H\nlong")
    assert d["json_ld"] == ['{"a": 1}'] and len(d["json_ld_errors"]) == 1 and d["links"][0]["internal"] and d["links"][0]["nofollow"]
    assert html.parse(None) is None and html.parse("<<<>>><p", "http://[bad")["raw_html_chars"] == 8 and html.parse("", "")["text"] == ""
    assert p("<div>" * 3000 + "x")["text"] == "x"
