"""The pN_ queries of the problems tagged llm, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import boilerplate, language, leaks, quality, repeats, residue, tokens, topics
from siltstone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.no_prose(table(spark, sf_dir, "html_docs"))


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statistic; rates to four places, failures as one text."""
    s = quality.statistics(table(spark, sf_dir, "html_docs"))
    return s.select(*(F.array_join(c, ",").alias(c) if c == "failures" else F.round(c, 4).alias(c) if kind == "double" else c for c, kind in s.dtypes))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.template_lines(table(spark, sf_dir, "html_docs"), table(spark, sf_dir, "validated_urls"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, sf_dir, "html_docs"), table(spark, sf_dir, "validated_urls"))


def p2_from_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main bodies of the served markup itself."""
    return boilerplate.main_bodies(boilerplate.from_bodies(table(spark, sf_dir, "fetch_results")), table(spark, sf_dir, "validated_urls"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.unnamed_languages(table(spark, sf_dir, "html_docs"), table(spark, sf_dir, "validated_urls"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.page_segments(table(spark, sf_dir, "html_docs"), table(spark, sf_dir, "validated_urls"))
    return found.select("page_id", "document_lang", "document_confidence", F.inline_outer("segments"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(table(spark, sf_dir, "html_docs"), table(spark, sf_dir, "validated_urls"), table(spark, sf_dir, "fetch_results"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_entries(table(spark, sf_dir, "html_docs"), table(spark, sf_dir, "validated_urls"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, sf_dir, "html_docs").select("page_id", "paragraphs"), table(spark, sf_dir, "validated_urls"))
    return cut.select("page_id", F.array_join("paragraphs", "\n").alias("paragraphs"), "n_cut")


def p7_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's paragraphs without the chunks that its site repeats."""
    return repeats.without_chunks(table(spark, sf_dir, "html_docs").select("page_id", "paragraphs"), table(spark, sf_dir, "validated_urls"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = leaks.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))
    return cut.select("doc_id", "text", "leaked_words", "leak_dropped")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topics.accepted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return found.select("doc_id", "subject")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_statistics, p2_found, p2_bodies, p2_from_markup, p3_found, p3_segments, p5_found, p7_found, p7_clean, p7_cut, p8_ids, p9_found,
        p9_spans, p9_clean, p10_found,
    )}
