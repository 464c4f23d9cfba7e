"""The pN_ queries of the general problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import jsonnodes, timestamps
from siltstone.session import table


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sitemap entry with the instant of its lastmod, by the dictionary that every run extends."""
    entries = table(spark, sf_dir, "sitemap_entries").select("entry_id", "lastmod", "profile_id", "lastmod_parsed")
    profiles = table(spark, sf_dir, "cms_profiles").select("profile_id", "tz", "locale")
    return timestamps.normalise(entries.join(profiles, "profile_id", "left"), "lastmod", "tz", "locale", timestamps.StampDictionary.kept(spark))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p4_instants(spark, sf_dir).where("instant is not null").where(~F.date_trunc("second", "instant").eqNullSafe(F.date_trunc("second", "lastmod_parsed")))
    # entry_id is unique, so the rows are distinct
    return found.select("entry_id", F.date_format("instant", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod_utc"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonnodes.json_nodes(table(spark, sf_dir, "html_docs"))


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonnodes.json_values(table(spark, sf_dir, "html_docs"))


def queries() -> dict:
    return {"p4_found": p4_found, "p6_found": p6_found, "p6_values": p6_values}
