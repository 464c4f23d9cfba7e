from datetime import datetime, timezone

import pytest

from siltstone.operators import timestamps as ts

BERLIN, NY, SYDNEY, KOLKATA = "Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"


def utc(text, tz="UTC", locale="en-GB"):
    at, _ = ts.parse(text, tz, locale)
    return None if at is None else datetime.fromtimestamp(at // 1_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize(
    ("text", "tz", "locale", "want"),
    [
        ("2024-07-26T22:15:20.158Z", BERLIN, "de-DE", "2024-07-26T22:15:20Z"),
        ("2023-02-14t13:41:51z", "UTC", "en-GB", "2023-02-14T13:41:51Z"),
        ("2024-01-01T00:00:00", BERLIN, "de-DE", "2023-12-31T23:00:00Z"),
        ("2024-10-27 02:30", BERLIN, "de-DE", "2024-10-27T00:30:00Z"),  # twice: the first pass
        ("2024-03-31 02:30:00", BERLIN, "de-DE", "2024-03-31T01:30:00Z"),  # skipped: the earlier offset
        ("2023-10-21 08:36:34 EDT", NY, "en-US", "2023-10-21T12:36:34Z"),
        ("2023-10-21 08:36:34 AEDT", SYDNEY, "en-AU", "2023-10-20T21:36:34Z"),
        ("2023-10-21 08:36:34 IST", KOLKATA, "en-IN", "2023-10-21T03:06:34Z"),
        ("2023-10-21 08:36:34 EDT", BERLIN, "de-DE", None),
        ("03/04/2020", NY, "en-US", "2020-03-04T05:00:00Z"),
        ("03/04/2020", "UTC", "en-GB", "2020-04-03T00:00:00Z"),
        ("3/21/2021 6:28 PM", NY, "en-US", "2021-03-21T22:28:00Z"),
        ("2022-252", "UTC", "en-GB", "2022-09-09T00:00:00Z"),
        ("2020", NY, "en-US", "2020-01-01T05:00:00Z"),
        ("2024-08", "UTC", "en-GB", "2024-08-01T00:00:00Z"),
        ("1752483237825540", "UTC", "en-GB", "2025-07-14T08:53:57Z"),
        ("1608309133627", "UTC", "en-GB", "2020-12-18T16:32:13Z"),
        ("1610619279 ", "UTC", "en-GB", "2021-01-14T10:14:39Z"),
        ("20240807T072614Z\n", "UTC", "en-GB", "2024-08-07T07:26:14Z"),
        ("2022-03-27T18:38:15+02:00[Europe/Berlin]", "UTC", "en-GB", "2022-03-27T16:38:15Z"),
        ("Tue, 26 May 2026 18:44:04 +0530", "UTC", "en-GB", "2026-05-26T13:14:04Z"),
        ("24 janvier 2024 à 17h49", "Europe/Paris", "fr-FR", "2024-01-24T16:49:00Z"),
        ("6. Mai 2023, 21:23 Uhr", BERLIN, "de-DE", "2023-05-06T19:23:00Z"),
        ("22 de abril de 2023, 10:11", "Europe/Madrid", "es-ES", "2023-04-22T08:11:00Z"),
        ("October 31, 2023 12:28 am", NY, "en-US", "2023-10-31T04:28:00Z"),
        ("2024-02-30", "UTC", "en-GB", None),
        ("31/31/2023", "UTC", "en-GB", None),
        ("2025-03-04T27:15:00Z", "UTC", "en-GB", None),
        ("0000-00-00", "UTC", "en-GB", None),
        ("{{ lastmod }}", "UTC", "en-GB", None),
        ("yesterday", "UTC", "en-GB", None),
        ("", "UTC", "en-GB", None),
        (None, "UTC", "en-GB", None),
        ("2024-01-01", None, None, None),
        ("2024-01-01T00:00:00Z", None, None, "2024-01-01T00:00:00Z"),
        ("x" * 100_000, "UTC", "en-GB", None),
        ("1" * 100_000, "UTC", "en-GB", None),
        ("2024-01-01" + " " * 200 + "10:00", "UTC", "en-GB", "2024-01-01T10:00:00Z"),
    ],
)
def test_parse(text, tz, locale, want):
    assert utc(text, tz, locale) == want


def test_normalise_keeps_rows_and_extends_its_dictionary(spark):
    schema = "id int, raw string, tz string, locale string, form string"
    rows = [(1, "2024-01-01", "UTC", "en-GB", "old"), (1, "2024-01-01", "UTC", "en-GB", "old"), (2, None, "UTC", "en-GB", None), (3, "n/a", "UTC", None, None), (4, "2024-01-01", None, None, None), (5, "2024-01-01T00:00:00Z", None, None, None)]
    d = ts.StampDictionary(spark)
    got = sorted(ts.normalise(spark.createDataFrame(rows, schema), "raw", "tz", "locale", d).select("id", "instant", "form").collect(), key=str)
    assert [(r.id, r.instant is not None, r.form) for r in got] == [(1, True, "year_first"), (1, True, "year_first"), (2, False, ""), (3, False, ""), (4, False, ""), (5, True, "year_first")]
    n = d.known().count()
    more = ts.normalise(spark.createDataFrame([*rows, (6, "2025", "UTC", "en-GB", None)], schema), "raw", "tz", "locale", d)
    assert more.count() == 7 and d.known().count() == n + 1
    assert ts.normalise(spark.createDataFrame([], schema), "raw", "tz", "locale").count() == 0


def test_found_agrees_with_row_by_row_parsing(spark, data):
    from siltstone.plans.dataprep import p4_found
    from siltstone.session import table

    rows = table(spark, data, "sitemap_entries").join(table(spark, data, "cms_profiles"), "profile_id").selectExpr("entry_id", "lastmod", "tz", "locale", "unix_seconds(lastmod_parsed) p").collect()
    want = {(r.entry_id, utc(r.lastmod, r.tz, r.locale)) for r in rows if (at := ts.parse(r.lastmod, r.tz, r.locale)[0]) is not None and at // 1_000_000 != r.p}
    assert {tuple(r) for r in p4_found(spark, data).collect()} == want and want


def test_null_and_empty_zones_do_not_multiply_rows(spark):
    rows = [(1, "2024-01-01T00:00:00Z", None, None), (2, "2024-01-01T00:00:00Z", "", None), (3, "2024-01-01T00:00:00Z", "", "")]
    df = spark.createDataFrame(rows, "id int, raw string, tz string, locale string")
    d = ts.StampDictionary(spark)
    assert sorted(r.id for r in ts.normalise(df, "raw", "tz", "locale", d).collect()) == [1, 2, 3] and d.known().count() == 1
    # a key that two runs added at the same time
    spark.createDataFrame(d.known().collect(), ts.DICTIONARY).write.parquet(f"{d.path}/copy")
    (__import__("pathlib").Path(d.path.removeprefix("file:")) / "interrupted").mkdir()
    assert d.known().count() == 2 and ts.normalise(df, "raw", "tz", "locale", d).count() == 3


def test_a_second_run_extends_the_kept_dictionary(spark, monkeypatch):
    import uuid

    from siltstone.plans.dataprep import p4_found

    # other rules begin a dictionary of their own, whatever earlier runs have left in the folder
    monkeypatch.setattr(ts, "VERSION", uuid.uuid4().hex)
    d = ts.StampDictionary.kept(spark)
    first = p4_found(spark, "/root/testdata/sf0.001").count()
    n = d.known().count()
    assert p4_found(spark, "/root/testdata/sf0.001").count() == first and d.known().count() == n
    assert p4_found(spark, "/root/testdata/sf0.01").count() > first and d.known().count() > n
