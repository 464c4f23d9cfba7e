import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.llm import boilerplate, language, leaks, quality, repeats, residue, tokens, topics
from siltstone.session import table


def test_tokens_frame(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (2, None, 9), (3, "", 9)], "doc_id bigint, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in tokens.encode(df).collect()) == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tokens.encode(df.where("false")).count() == 0


def test_leaks_frames(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Well: ONE, two; " + item[8:] + " and then much more text follows here on and on and on again", "k"), (1, "x " + item, "k"), (2, None, "k"), (3, "", "k"), (4, item, "k")], "doc_id bigint, text string, leaked_words string")
    assert sorted(map(tuple, leaks.leaks(docs, items).collect())) == [(1, 7), (4, 7)]
    assert sorted(map(tuple, leaks.leaks(docs, items, block_words=3).collect())) == [(1, 7), (4, 7)]
    spans = leaks.leak_spans(docs, items).where("doc_id = 4").collect()
    assert [(s.n_words, s.first_char, s.end_char) for s in spans] == [(11, 0, len(item))]
    cut = {(r.doc_id, r.text, r.leaked_words, r.leak_dropped) for r in leaks.without_leaks(docs.where("doc_id > 1"), items).collect()}
    assert cut == {(2, None, 0, False), (3, "", 0, False), (4, None, 11, True)}
    long = leaks.without_leaks(docs.limit(1), items).first()
    assert long.text.startswith("Well: ") and "three" not in long.text and not long.leak_dropped
    assert leaks.leaks(docs, items.where("false")).count() == 0 and leaks.leaks(docs.where("false"), items).count() == 0


def test_repeats_frames(spark):
    line = "Share this page with all of your good friends, please! "
    docs = spark.createDataFrame([(i, [f"Own words number {'abcdefgh'[i]} of page", line + str(i), None, "42"]) for i in range(6)] + [(0, ["Own words number a of page", line])] + [(9, None), (10, [])], "page_id bigint, paragraphs array<string>")
    urls = spark.createDataFrame([(i, "s.com") for i in range(6)] + [(9, None), (10, "s.com")], "page_id bigint, registrable_domain string")
    assert sorted(map(tuple, repeats.repeated_entries(docs, urls).collect())) == [(i, 1) for i in range(6)]
    assert repeats.repeated_entries(docs, urls, least=7).count() == 0
    kept = {r.page_id: (r.n_cut, r.paragraphs) for r in repeats.without_repeats(docs.where("page_id > 0"), urls, least=5).collect()}
    assert kept[9] == (0, None) and kept[10] == (0, []) and kept[1] == (1, ["Own words number b of page", None, "42"])
    assert repeats.repeated_entries(docs.where("false"), urls).count() == 0


def test_repeated_chunks_are_cut_inside_entries(spark):
    note = "Share this page with all of your good friends and colleagues, and do not forget to subscribe to our weekly letter about everything that happens here in town, because there is a lot to tell each time."
    own = lambda i: f"The {'alpha beta gamma delta zeta theta kappa'.split()[i]} report {'qwertyuiop'[i] * 30} says what nobody else had said before"
    rows = [(i, [f"{own(i)}. {note} {own(6 - i)}", note, None, "42"]) for i in range(6)] + [(9, None), (10, []), (11, [own(1)])]
    docs = spark.createDataFrame(rows, "page_id bigint, paragraphs array<string>").withColumn("n_cut", F.lit("clash"))
    urls = spark.createDataFrame([(i, "s.com") for i in range(12)], "page_id bigint, registrable_domain string")
    got = {r.page_id: r for r in repeats.without_chunks(docs, urls).collect()}
    assert got[9].paragraphs is None and got[10].paragraphs == [] and got[11].paragraphs == [own(1)] and got[11].n_cut == 0
    for i in range(6):
        first = got[i].paragraphs[0]
        assert first.startswith(own(i)) and first.endswith(own(6 - i)) and "subscribe" not in first and note not in got[i].paragraphs and got[i].paragraphs[1:] == [None, "42"]
    assert repeats.without_chunks(docs.where("false"), urls).count() == 0


def test_boilerplate_frames(spark):
    def page(i, middle):
        return "\n".join(["Home", "Docs", f"Home › Title {'abcdefghijklmnop'[i]}", f"Title {'abcdefghijklmnop'[i]}", *middle, "Read also", "A teaser title", "Imprint", "© 2024 Mysite. All rights reserved."])

    rows = [(i, f"Title {'abcdefghijklmnop'[i]}", page(i, [f"{'Paragraph ' + 'qwertyuiopasdfghj'[i] * 9 + ' text. ' * 30}", "The views given here are those of the author and not of Mysite.", f"{'Closing ' + 'zxcvbnmlkjhgfdsap'[i] * 9 + ' words. ' * 30}"])) for i in range(12)] + [(50, None, None), (51, "", "")]
    docs = spark.createDataFrame(rows, "page_id bigint, title string, text string")
    urls = spark.createDataFrame([(i, "mysite.com") for i in range(12)], "page_id bigint, registrable_domain string")
    found = boilerplate.template_lines(docs, urls).groupBy("page_id").agg(F.array_sort(F.collect_list("line_no")).alias("n")).collect()
    assert len(found) == 12 and all(r.n == [0, 1, 2, 5, 7, 8, 9, 10] for r in found)
    bodies = {r.page_id: r.body for r in boilerplate.main_bodies(docs, urls).collect()}
    assert bodies[50] is None and bodies[0].startswith("Title a\nParagraph") and "views" not in bodies[0]
    assert boilerplate.template_lines(docs.where("false"), urls).count() == 0
    assert spark.range(1).select(boilerplate.strip_markup(F.lit("<p>a<b>b</b></p><script>x</script><div>c &amp; d</div>")).alias("t")).first().t == "a b\nc & d"


def test_boilerplate_rare_on_a_large_site(spark):
    own = lambda i, w: f"{w} {''.join('abcdefghij'[int(d)] for d in str(i))} " + "and some words that follow. " * 8
    note = "The views given here are those of the author and not of Mysite."
    # 3 of 1,600 pages have the note: a key on a small share of a large site counts like any other
    rows = [(i, "", "\n".join([own(i, "First"), *([note] if i < 3 else []), own(i, "Last")])) for i in range(1_600)] + [(0, "", None), (-1, "", note)]
    docs = spark.createDataFrame(rows, "page_id bigint, title string, text string")
    urls = spark.createDataFrame([(i, "mysite.com") for i in range(1_600)], "page_id bigint, registrable_domain string")
    assert sorted(map(tuple, boilerplate.template_lines(docs, urls).collect())) == [(0, 1), (1, 1), (2, 1)]
    assert boilerplate.main_bodies(docs, urls).count() == len(rows)


def test_boilerplate_from_served_markup(spark, data):
    html, urls, fetches = (table(spark, data, n) for n in ("html_docs", "validated_urls", "fetch_results"))
    lines = lambda docs: {(r.page_id, r.line) for r in boilerplate.main_bodies(docs, urls).select("page_id", F.explode(F.split("body", "\n")).alias("line")).collect()}
    a, b = lines(html), lines(boilerplate.from_bodies(fetches))
    assert len(a & b) > 0.97 * max(len(a), len(b)) > 100


def test_boilerplate_defined_cases(spark):
    rows = [(None, "t", "a line of no page"), (1, None, ""), (2, None, None), (3, "t", "one line"), (3, "t", "one line"), (3, "t", "another text of the id"), (4, "t", "x" * 100_000)]
    docs = spark.createDataFrame(rows, "page_id bigint, title string, text string").withColumn("site", F.lit("clash")).withColumn("row", F.lit(1))
    urls = spark.createDataFrame([(3, "s.com"), (3, None), (None, "s.com")], "page_id bigint, registrable_domain string")
    got = sorted((str(r.page_id), r.body) for r in boilerplate.main_bodies(docs, urls).collect() if r.body is None or len(r.body) < 90)
    assert got == sorted([("None", "a line of no page"), ("1", None), ("2", None), ("3", "one line"), ("3", "one line"), ("3", "another text of the id")], key=str) or len(got) == 6


def test_quality_frame(spark):
    prose = "This is a sentence that says what it has to say. " * 8
    docs = spark.createDataFrame([(1, prose), (2, "\n".join(f"red item {i}; 4 kg" for i in range(40))), (3, None), (4, ""), (5, "lorem ipsum dolor " * 30), (6, "Page not found."), (7, "#$% " * 200)], "page_id bigint, main_text string").withColumn("paragraphs", F.array(F.lit("a b"), F.lit(None))).withColumn("list_items", F.lit(None).cast("array<string>")).withColumn("words", F.lit("clash"))
    got = {r.page_id: r for r in quality.statistics(docs).collect()}
    assert got[1].failures == [] and got[3].failures == ["too_few_words"] and got[4].words == 0 and got[1].paragraph_words == 2 and got[1].list_words == 0
    assert {r.page_id for r in quality.no_prose(docs).collect()} == {2, 7}
    assert quality.no_prose(docs.where("false")).count() == 0


PROSE = """The cat slept under the old oak tree near our house.
Sales rose nine percent in the last quarter, the company said.
Rain fell all night and the river broke its banks.
She opened the letter, read it twice and burned it.
Nobody has ever climbed that face of the mountain in winter.
My grandfather built this boat from driftwood
Der Hund lief schnell über die nasse Wiese.
Im Herbst fallen die Blätter von den Bäumen.
Das Wetter bleibt auch morgen regnerisch und kühl
Le chat dort sur le canapé près de la fenêtre.
Les enfants jouent dans le jardin depuis ce matin
El perro corre por la playa todas las mañanas.
Mi hermana trabaja en un hospital de Madrid
La lluvia no paró hasta la medianoche.
O menino comprou um livro novo na feira.
A chuva caiu durante toda a noite.
Ik heb gisteren een nieuwe fiets gekocht.
De kinderen spelen buiten in de tuin.
Il treno parte alle otto del mattino.
I bambini giocano nel parco con la palla
Katten sover under det gamla trädet vid huset.
Han bor i et lille hus ved havet.
Kissa nukkuu vanhan puun alla talon vieressä tänään.
Kot śpi pod starym drzewem obok naszego domu.
Кошка спит под старым деревом возле нашего дома.
Η γάτα κοιμάται κάτω από το παλιό δέντρο.
猫は古い木の下で眠っています。
我昨天在图书馆看了一整天的书。"""
ENTRIES = "las bases de datos / las versiones (18).\nos queijos, Lobogu.\nNugusevar: die Urteile, 15 EUR.\nOur Products\nchapter 7\n42 | yes | 3.5 kg\nle mappe del sito, Gavopas.\nVGhpcyBpcyBub3QgYSBzZW50ZW5jZQ==\nff 29 3e 79 71 68 52 83 cd b2\nbuy shoes, cheap shoes, best shoes online, free shoes"


def test_sentences_told_from_entries(spark):
    rows = [(x, True) for x in PROSE.split("\n")] + [(x, False) for x in ENTRIES.split("\n")]
    got = spark.createDataFrame(rows, "l string, prose boolean").select("l", "prose", quality.line_kind(quality.kind_features(F.col("l"))).alias("kind")).collect()
    assert [r.l for r in got if r.prose != (r.kind == "sentence")] == []


def test_rubbish_counts_by_words_or_symbols(spark):
    blob = "QUJD" * 300
    rows = [(1, blob), (2, "A short note says what this is about and why.\n" + blob), (3, "Short title"), (4, "The page was not found"), (5, PROSE), (6, "\n".join(["- item"] * 30))]
    docs = spark.createDataFrame(rows, "page_id bigint, main_text string").withColumn("paragraphs", F.lit(None).cast("array<string>")).withColumn("list_items", F.col("paragraphs"))
    assert {r.page_id for r in quality.no_prose(docs).collect()} == {1, 2, 6}
    assert "bullets" in quality.statistics(docs).where("page_id = 6").first().failures


def test_language_names(spark):
    rows = [("EN", "en"), ("fr_CA", "fr"), ("spa", "es"), ("ger", "de"), ("und", None), ("x-default", None), ("", None), (None, None), (" it-IT ", "it"), ("zxx", None)]
    got = spark.createDataFrame(rows, "l string, want string").select("want", language.named(F.col("l")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p10_found"])
def test_queries_have_their_columns(spark, data, name):
    from siltstone.llm.queries import queries

    df = queries()[name](spark, data)
    want = {"p1_found": ["page_id"], "p2_found": ["page_id", "line_no"], "p3_found": ["page_id", "lang"], "p5_found": ["page_id"], "p10_found": ["doc_id", "subject"]}[name]
    rows = df.collect()
    assert df.columns == want and rows and len(set(rows)) == len(rows)


def test_clean_queries_cut_what_is_found(spark):
    from siltstone.llm.queries import queries

    d = "/root/testdata/sf0.01"
    run = lambda n: queries()[n](spark, d).collect()
    cut, before = {}, {r.page_id: r.paragraphs for r in table(spark, d, "html_docs").collect()}
    for r in run("p7_found"):
        cut.setdefault(r.page_id, set()).add(r.para_no)
    clean = run("p7_clean")
    want = {p: None if x is None else "\n".join(e for i, e in enumerate(x) if i not in cut.get(p, ()) and e is not None) for p, x in before.items()}
    assert cut and {r.page_id: r.paragraphs for r in clean} == want and all(r.n_cut == len(cut.get(r.page_id, ())) for r in clean)
    leaky, texts = {r.doc_id for r in run("p9_found")}, run("p9_clean")
    assert leaky and {r.doc_id for r in texts if r.leaked_words} == leaky == {r.doc_id for r in run("p9_spans")}
    assert len(texts) == table(spark, d, "documents").count()


def test_residue_on_unseen_sites(spark):
    own = residue.own_lines(*(table(spark, "/root/testdata/sf0.1", n) for n in ("html_docs", "validated_urls", "fetch_results")))
    v = residue.validate(own)
    assert v["precision"] > 0.85 and v["recall"] > 0.85
    assert residue.residue_pages(*(table(spark, "/root/testdata/sf0.001", n).where("false") for n in ("html_docs", "validated_urls", "fetch_results"))).count() == 0


def test_topics(spark):
    words = {"law": "court judge verdict clause", "food": "oven sauce dough cheese"}
    docs, labels = [], []
    for i in range(60):
        s = "law" if i % 2 else "food"
        w = words[s].split()
        docs.append((i, " ".join(f"The {w[(i + j) % 4]} and the {w[(i + 2 * j + 1) % 4]} came to us in spring." for j in range(6)), "en"))
        if i < 40:
            labels.append((i, s))
    docs += [(90, None, "en"), (91, "", None), (92, "Nothing of note was ever said about it at all.", "en")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    la = spark.createDataFrame([*labels, (1, "law"), (999, "law"), (2, "nonsense")], "doc_id bigint, subject string")
    names = spark.createDataFrame([("law",), ("food",)], "subject string")
    got = {r.doc_id: r.subject for r in topics.accepted(d, la, names).collect()}
    assert got == {i: "law" if i % 2 else "food" for i in range(60)}
    assert topics.accepted(d, la.where("false"), names).count() == 0 and topics.accepted(d, la, names.where("false")).count() == 0


def test_topics_of_two_subjects_and_of_one_word(spark):
    words = {"law": "court judge verdict clause appeal lawyer".split(), "food": "oven sauce dough cheese recipe pan".split()}
    line = lambda s, i, j: f"The {words[s][(i + j) % 6]} and the {words[s][(i + 2 * j + 1) % 6]} came to us in spring."
    docs = [(i, " ".join(line("law" if i % 2 else "food", i, j) for j in range(6)), "en") for i in range(60)]
    docs += [(100, " ".join(line(s, 3, j) for s in words for j in range(3)), "en"), (101, "The dough was never seen here at all by anyone.", "en"), (102, line("law", 1, 1) + " " + " ".join("Nothing of note was ever said about it at all." for _ in range(9)), "en")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    la = spark.createDataFrame([(i, "law" if i % 2 else "food") for i in range(40)], "doc_id bigint, subject string")
    # as many subjects as are given
    names = spark.createDataFrame([("law",), ("food",), *((f"other {i}",) for i in range(1_001))], "subject string")
    got = {}
    for r in topics.accepted(d, la, names).where("doc_id >= 100").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got == {100: {"law", "food"}}


def test_topics_are_learned_from_every_labelled_document(spark):
    # of 44,000 labelled documents, law has only ones that a sample of 40,000 by hash leaves out
    late = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) >= int((1 << 40) * 40 / 44)
    law = F.row_number().over(Window.partitionBy(late).orderBy("doc_id")) <= 60
    said = {s: F.concat(*(F.concat(F.lit("The "), F.element_at(F.array(*map(F.lit, w)), ((F.col("doc_id") + k) % 4 + 1).cast("int")), F.lit(" came to us in spring. ")) for k in range(3)))
            for s, w in {"law": ("court", "judge", "verdict", "clause"), "food": ("oven", "sauce", "dough", "cheese")}.items()}
    rows = spark.range(44_000).withColumnRenamed("id", "doc_id").withColumn("subject", F.when(late & law, "law").otherwise("food"))
    docs = rows.select("doc_id", F.when(F.col("subject") == "law", said["law"]).otherwise(said["food"]).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.range(100_000, 100_004).select(F.col("id").alias("doc_id"))
                            .select("doc_id", said["law"].alias("text"), F.lit("en").alias("lang")))
    names = spark.createDataFrame([("law",), ("food",)], "subject string")
    got = topics.accepted(docs, rows.select("doc_id", "subject"), names).where("subject = 'law'").select("doc_id").collect()
    unseen = {r.doc_id for r in got if r.doc_id >= 100_000}
    assert len(got) == 64 and unseen == set(range(100_000, 100_004))


def test_topics_margins_come_from_every_labelled_document(spark, monkeypatch):
    words = {"law": "court judge verdict clause".split(), "food": "oven sauce dough cheese".split()}
    docs = [(i, " ".join(f"The {w[(i + j) % 4]} came to us in spring." for j in range(3)), "en") for i in range(40) for w in [words["law" if i % 2 else "food"]]]
    texts = topics.cut(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    tried, original = [], topics.calibrated

    def spy(models, labelled, t):
        tried.extend(r.key for r in labelled.select("key").collect())
        return original(models, labelled, t)

    monkeypatch.setattr(topics, "calibrated", spy)
    topics.fit(texts, spark.createDataFrame([(i, "law" if i % 2 else "food") for i in range(40)], "doc_id bigint, subject string"), ["food", "law"])
    assert sorted(tried) == list(range(40))


def test_network_is_kept(spark, monkeypatch):
    # whatever earlier runs have left in the folder is of another version
    monkeypatch.setattr(language, "VERSION", __import__("uuid").uuid4().hex)
    rows = [(i, "en" if i % 2 else "de", [("The house is where we have been for years. " if i % 2 else "Das Haus ist der Ort, an dem wir seit Jahren sind. ") + str(i)]) for i in range(40)]
    lines = spark.createDataFrame(rows, "page_id bigint, label string, lines array<string>")
    t = language.Training(rounds=(5, 2), hidden=4)
    first = language.fit(lines, t)
    trained = []
    original, language.train = language.train, lambda *a: trained.append(1) or original(*a)
    try:
        again = language.fit(lines, t)
        assert not trained and all((first.p[k] == again.p[k]).all() for k in first.p)
        language.fit(lines.where("page_id > 5"), t)
        assert trained
    finally:
        language.train = original
    assert language.load(spark, "/nonexistent/model") is None


def test_defined_cases_of_empty_tables(spark):
    docs = spark.createDataFrame([], "page_id bigint, title string, text string, main_text string, lang string, paragraphs array<string>, list_items array<string>")
    urls = spark.createDataFrame([], "page_id bigint, registrable_domain string")
    assert language.unnamed_languages(docs, urls).count() == 0 and repeats.without_chunks(docs.select("page_id", "paragraphs"), urls).count() == 0
    assert leaks.leak_spans(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0
