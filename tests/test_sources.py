import gzip
import zlib

from pyspark.sql import functions as F

from siltstone.functions import markup, text
from siltstone.operators import entities, findings, reports, sites
from siltstone.sources import pages


def test_inflated_within_bounds(spark):
    body = b"text " * 1000
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    rows = [(1, gzip.compress(body), "gzip"), (2, zlib.compress(body), "deflate"), (3, raw.compress(body) + raw.flush(), "deflate"), (4, body, None), (5, b"no gzip", "gzip"), (6, None, "gzip"), (7, b"", "identity")]
    df = spark.createDataFrame(rows, "id int, raw binary, encoding string").withColumn("note", F.lit("clash"))
    got = {r.id: (r.body_bytes and bytes(r.body_bytes), r.note) for r in pages.inflated(df).collect()}
    assert got[1] == got[2] == got[3] == got[4] == (body, "") and got[5] == (b"no gzip", "undecodable") and got[6] == (None, "") and got[7][1] == ""
    short = {r.id: (len(r.body_bytes or b""), r.note) for r in pages.inflated(df, most=100).where("id < 3").collect()}
    assert short == {1: (100, "decompression_limit"), 2: (100, "decompression_limit")}


def test_decoded(spark):
    rows = [(1, "é".encode(), "text/html; charset=utf-8"), (2, "é".encode("latin-1"), "text/html; charset=ISO-8859-1"), (3, "é".encode("latin-1"), None), (4, "é".encode("utf-16"), 'x; charset="utf-16"'), (5, None, None), (6, "é".encode(), "x; charset=klingon"), (7, "é".encode("latin-1"), "x; charset=utf-8")]
    got = spark.createDataFrame(rows, "id int, raw binary, t string").select("id", pages.decoded(F.col("raw"), F.col("t")).alias("x")).collect()
    assert {r.id: r.x for r in got} == {i: None if i == 5 else "é" for i in range(1, 8)}


def test_saved_latest_and_budget(spark):
    inv = spark.createDataFrame([(1, 200), (2, 404), (3, None), (4, 204)], "page_id int, status int")
    bodies = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "page_id int, body string")
    got, notes = pages.saved(inv, bodies)
    assert [r.page_id for r in got.collect()] == [1] and {(r.page_id, r.note) for r in notes.collect()} == {(2, "status 404"), (3, "status none"), (4, "missing body")}
    runs = spark.createDataFrame([("u", 1, 5), ("u", 2, 5), ("v", 3, 1), ("u", 9, 4)], "k string, id int, t int")
    assert sorted(r.id for r in pages.latest(runs, "k", "t", "id").collect()) == [2, 3]
    rows = spark.createDataFrame([("s", i, 10) for i in range(9)], "site string, page_id int, n int")
    assert sorted(r.page_id for r in pages.budgeted(rows, 3, 1000, F.col("n")).collect()) == [0, 1, 2] and sorted(r.page_id for r in pages.budgeted(rows, 9, 25, F.col("n")).collect()) == [0, 1, 2]


def test_sums_before_are_those_of_one_window(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") * F.col("id")).alias("o"), (F.col("id") % 7).alias("v"))
    blocks = sites.before(df, "k", "o", {"s": F.col("v")}, block_rows=100)
    plain = df.selectExpr("*", "coalesce(sum(v) over (partition by k order by o rows between unbounded preceding and 1 preceding), 0) s")
    assert blocks.exceptAll(plain).count() == 0 and blocks.count() == 3000
    v = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2, 2)] + [("b", None)], "k string, v int")
    assert [tuple(r) for r in sites.at_positions(v, "k", "v", {"first": lambda n: F.lit(0), "last": lambda n: n - 1}).collect()] == [("a", 1, 4)]


def test_forms_and_layers(spark):
    html = '<form><label for="e">E</label><input id="e"><input type="hidden"><input name="q" required="1"><select aria-label="x"></select></form><form><input type="submit"></form>'
    one = lambda h, f: spark.createDataFrame([(h,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert [tuple(x) for x in one(html, markup.forms)] == [(3, 1, 1)] and [tuple(x) for x in one("<form><textarea>", markup.forms)] == [(1, 1, 0)] and one(None, markup.forms) == []
    assert one('<dialog open><div class="cookie-banner">', markup.layers_before) == (["open dialog"], ["consent"]) and one('<nav aria-label="breadcrumb">', markup.breadcrumb)
    assert one("Oops: page not found", lambda x: text.soft_404(x, F.lit(500), F.lit(""))) and not one("Fine", lambda x: text.soft_404(x, F.lit(500), F.lit("page not found")))


def test_entities(spark):
    ld = ['{"@graph": [{"@type": ["schema:Product", "Thing"], "offers": []}, 5], "@type": "http://s.org/WebPage"}', '[{"@type": "Organization", "name": " A  Co ", "sameAs": ["https://www.x.com/a", 3, ""], "address": {"streetAddress": "S 1", "addressCountry": {"name": "X"}}, "contactPoint": [{"name": "555-123-4567"}]}, 7]', "{broken", "", None, '"text"', "{}"]
    nodes = entities.top_level_nodes(spark.createDataFrame([(1, ld), (2, None), (3, [])], "page_id int, json_ld array<string>")).withColumn("site", F.lit("s"))
    got = {(r.block, r.no): r.types for r in nodes.collect()}
    assert got == {(0, 0): ["Product", "Thing"], (0, 2): ["WebPage"], (1, 0): ["Organization"], (6, 0): []}
    assert {(r.kind, r.value) for r in entities.name_variants(nodes).collect()} == {("name", "a"), ("phone", "5551234567"), ("address", "s 1 x")}
    best = entities.best_organisation(nodes).first()
    assert best.present == ["name", "contact point"] and best.score == 4 and [(r.links, r.hosts) for r in entities.identity_links(nodes).collect()] == [(2, 1)]
    assert [(r.type, r.missing) for r in entities.missing_properties(nodes).collect()] == [("Product", "name, offers or price")]


def test_reports(spark, tmp_path):
    row = ("s", "c", "T <b>", "critical", 2, "high", "e 1", "o", "x", 3, ["u"], "do it now please", "", "critical", "trust")
    f = reports.rehydrated(spark.createDataFrame([row, ("s", "d", *row[2:4], 4, *row[5:])], ", ".join(f"{c} {'int' if c in ('claim_level', 'sample_size') else 'array<string>' if c == 'urls' else 'string'}" for c in reports.COLUMNS)))
    assert [r.severity for r in f.orderBy("check_id").collect()] == ["high", "info"]
    fixed_up = reports.repaired(f, f.where("false").select("site", "check_id"))
    s = reports.summaries(fixed_up, F.lit("2024-01-01T00:00:00Z"))
    assert reports.row_errors(fixed_up).count() == 0 and reports.summary_errors(fixed_up, s).count() == 0 and reports.verdicts(fixed_up, s, f.where("false")).first().verdict == "ACCEPT"
    assert "&lt;b&gt;" in reports.as_html(fixed_up.drop("id", "position"), s).first().html
    texts = reports.as_markdown(fixed_up.drop("id", "position"), s)
    reports.written_reports(texts, str(tmp_path / "r"), "markdown")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(tmp_path / "r"))
    assert {r.error for r in reports.artefact_errors(files, ("F-001", "nonsense"), 10).collect()} == {"lacks 'nonsense'"}
    empty = f.where("false")
    assert reports.as_json(empty, reports.summaries(empty, F.lit("x"))).count() == 0


def test_layers(spark, tmp_path):
    import pytest

    from siltstone.sources import layers

    root = str(tmp_path / "run")
    assert layers.available(spark, root) == []
    layers.write_layer(spark.range(3), root, "pages")
    (tmp_path / "run" / "broken").mkdir()
    assert layers.available(spark, root) == ["pages"] and layers.require(spark, root, "pages")[0].count() == 3
    with pytest.raises(FileNotFoundError, match="broken, other"):
        layers.require(spark, root, "pages", "broken", "other")
    rows = spark.createDataFrame([(200, "# Site"), (404, "# Site"), (200, "<html>"), (None, None)], "s int, t string")
    assert [r.y for r in rows.select(layers.llms_present(F.col("s"), F.col("t")).alias("y")).collect()] == [True, False, False, False]


def test_review_needs_a_key(spark):
    import pytest

    with pytest.raises(ValueError, match="finding_no"):
        findings.review(spark.createDataFrame([("s",)], "site string"))
