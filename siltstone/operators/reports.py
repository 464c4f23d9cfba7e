"""Reports of findings: composing, writing, checking and repairing them.

A report is a set of findings (rows, see `findings`) of a site and one summary row a site. Everything is
done for all sites at once; a site's report is a row of text only when it is written out, and the findings
of one site, which its checks bound, are the only lists that are built. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import fixed, scores
from siltstone.operators import findings as review

ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
COLUMNS = (
    "site", "check_id", "title", "severity", "claim_level", "confidence", "evidence", "observed", "expected", "sample_size", "urls", "action",
    "mechanism", "priority", "layer",
)
#: What the notes of discovery mean to a reader, by a part of their text.
LIMITATIONS = {
    "timeout": "Some pages did not answer in time.", "robots": "Pages that robots.txt closes were not read.",
    "budget": "The page budget ended the sample early.", "truncated": "Very large pages were read in part.",
}


def concatenated(*layers: DataFrame) -> DataFrame:
    """The findings of all layers; a column that a layer lacks is null there."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def rehydrated(rows: DataFrame) -> DataFrame:
    """The declared columns of findings that were stored, severities capped again; others are left out."""
    types = {"claim_level": "int", "sample_size": "int", "urls": "array<string>"}
    have = [F.col(c).cast(types.get(c, "string")) if c in rows.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in COLUMNS]
    out = rows.select(*have)
    level = F.coalesce("claim_level", F.lit(1))
    return out.withColumns({"claim_level": level, "severity": scores.capped(F.col("severity"), level)})


def summaries(findings: DataFrame, audited_at: Column) -> DataFrame:
    """(site, audited_at, total_findings and each severity) of every site."""
    return review.severity_counts(findings).withColumnRenamed("total", "total_findings").withColumn("audited_at", audited_at)


def site_scores(rollup: DataFrame, summary: DataFrame) -> DataFrame:
    """The summaries with each site's scores; sites without one keep nulls."""
    return summary.join(rollup, "site", "left")


def rejection_rate(reviewed: DataFrame) -> DataFrame:
    """(site, given, dropped, rate) of reviewed findings."""
    out = reviewed.groupBy("site").agg(F.count(F.lit(1)).alias("given"), F.count("drop_reason").alias("dropped"))
    return out.withColumn("rate", F.round(F.col("dropped") / F.greatest(F.lit(1), F.col("given")), 3))


def chart_series(findings: DataFrame, mix: DataFrame, genres: DataFrame, medians: DataFrame) -> DataFrame:
    """(site, chart, label, value) of the series that charts show: severities and layers with their zeros,
    the mix of page types, pages by genre, and the median score."""
    sites = findings.select("site").distinct()

    def counted(column: str, names: tuple[str, ...], chart: str) -> DataFrame:
        n = findings.groupBy("site", F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        every = sites.select("site", F.explode(F.array(*map(F.lit, names))).alias("label"))
        return every.join(n, ["site", "label"], "left").select("site", F.lit(chart).alias("chart"), "label", F.coalesce("n", F.lit(0)).cast("double").alias("value"))

    named = lambda df, chart: df.select("site", F.lit(chart).alias("chart"), "label", F.col("value").cast("double").alias("value"))
    return concatenated(
        counted("severity", fixed.SEVERITIES, "severity"), counted("layer", review.LAYERS, "layer"), named(mix, "page_type"), named(genres, "genre"),
        named(medians, "median_score"),
    )


def as_json(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(site, json): each site's report as one JSON text with its findings in report order."""
    each = review.numbered(findings)
    row = F.struct("position", F.struct("id", *COLUMNS[1:]).alias("finding"))
    lists = each.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["finding"]).alias("findings"))
    counts = F.struct("total_findings", *fixed.SEVERITIES).alias("summary")
    return summary.join(lists, "site", "left").select("site", F.to_json(F.struct("site", "audited_at", counts, F.coalesce("findings", F.array()).alias("findings"))).alias("json"))


def as_markdown(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(site, markdown): each site's report to read."""
    def cell(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    text = F.concat(
        F.lit("### "), cell("id"), F.lit(" "), cell("title"), F.lit("\n\n**"), cell("severity"), F.lit("** (level "), cell("claim_level"), F.lit(", confidence "), cell("confidence"), F.lit(")\n\n"), cell("evidence"),
        F.lit("\n\nAction: "), cell("action"), F.lit("\n"),
    )
    lists = review.numbered(findings).select(
        "site", "position", text.alias("text"),
    ).groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda r: r["text"]), "\n").alias("body"))
    counts = F.concat_ws(", ", *(F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in fixed.SEVERITIES))
    head = F.concat(
        F.lit("# "), F.col("site"), F.lit("\n\n"), cell("audited_at"), F.lit(": "), F.col("total_findings").cast("string"), F.lit(" findings ("),
        counts, F.lit(")\n\n"),
    )
    return summary.join(lists, "site", "left").select("site", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


def escaped(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def as_html(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(site, html): each site's report as a page; all texts are escaped."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in ("id", "severity", "title", "evidence", "action")]
    rows = review.numbered(findings).select("site", "position", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))
    lists = rows.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "row"))), lambda r: r["row"]), "\n").alias("rows"))
    name = escaped(F.col("site"))
    page = F.concat(
        F.lit("<!doctype html><html><head><meta charset=\"utf-8\"><title>"), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1><p>"),
        F.col("total_findings").cast("string"), F.lit(" findings</p><table>\n"), F.coalesce("rows", F.lit("")), F.lit("\n</table></body></html>\n"),
    )
    return summary.join(lists, "site", "left").select("site", page.alias("html"))


def written_reports(texts: DataFrame, path: str, column: str) -> None:
    """One text file a site under path/site=...; the sink of the three forms."""
    texts.select("site", F.col(column).alias("value")).repartition("site").write.mode("overwrite").partitionBy("site").text(path)


def artefact_errors(files: DataFrame, needed: tuple[str, ...] = (), least_bytes: int = 500) -> DataFrame:
    """(path, error) of binary files (as Spark's binaryFile source reads them) that are too small, lack a
    text that they should have, or, named .pdf, don't begin and end as one."""
    text = F.decode("content", "ISO-8859-1")
    pdf = F.endswith(F.lower("path"), F.lit(".pdf"))
    checks = {
        "smaller than it should be": F.col("length") < least_bytes, "no PDF head": pdf & ~F.startswith(text, F.lit("%PDF-")),
        "no PDF end": pdf & ~F.contains(F.right(text, F.lit(1024)), F.lit("%%EOF")),
    }
    checks |= {f"lacks {token!r}": ~pdf & ~F.contains(text, F.lit(token)) for token in needed}
    return files.select("path", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))).alias("error"))


def row_errors(findings: DataFrame) -> DataFrame:
    """(site, id, error) of each finding that breaks a rule, and of ids given twice."""
    text = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    level = F.col("claim_level")
    checks = {
        "no id": text("id") == "",
        "no title": text("title") == "",
        "no evidence": text("evidence") == "",
        "no action": text("action") == "",
        "unknown severity": ~text("severity").isin(*fixed.SEVERITIES),
        "unknown priority": ~text("priority").isin(*review.PRIORITIES),
        "unknown level": level.isNotNull() & ~level.between(1, 4),
        "causal claim": level == 4,
        "severity above its ceiling": level.between(1, 3) & (scores.capped(F.col("severity"), level) != F.col("severity")),
        "priority above severity": scores.rank(F.col("priority"), review.PRIORITIES) < scores.rank(F.col("severity"), fixed.SEVERITIES),
        "id of wrong form": (text("id") != "") & ~text("id").rlike(r"^F-\d{3,}$"),
    }
    errors = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    repeated = findings.groupBy("site", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("site", "id", F.lit("id not unique").alias("error"))
    return findings.select("site", "id", F.explode(errors).alias("error")).unionByName(repeated)


def summary_errors(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(site, id, error) of summaries: no site, a time of wrong form, counts that aren't the findings'."""
    actual = review.severity_counts(findings).select("site", F.col("total").alias("_total"), *(F.col(s).alias(f"_{s}") for s in fixed.SEVERITIES))
    both = summary.join(actual, "site", "left")
    differs = lambda given, real: ~F.col(given).eqNullSafe(F.coalesce(F.col(real), F.lit(0)))
    checks = {
        "no site": F.coalesce("site", F.lit("")) == "", "time of wrong form": ~F.coalesce("audited_at", F.lit("")).rlike(ISO_TIME),
        "total differs": differs("total_findings", "_total"),
    }
    checks |= {f"count of {s} differs": differs(s, f"_{s}") for s in fixed.SEVERITIES}
    errors = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return both.select("site", F.lit(None).cast("string").alias("id"), F.explode(errors).alias("error"))


def verdicts(findings: DataFrame, summary: DataFrame, dropped: DataFrame) -> DataFrame:
    """(site, issues, repairable, verdict): what the review of a report says. A finding that the gates
    dropped must not be in the report. Reports whose every issue can be repaired are to be repaired,
    others made anew."""
    gone = findings.join(dropped.select("site", "check_id").distinct(), ["site", "check_id"], "left_semi").select("site", "id", F.lit("dropped by the review").alias("error"))
    issues = concatenated(row_errors(findings), summary_errors(findings, summary), gone)
    repairable = ~F.col("error").isin("no title", "no evidence", "no action", "no site", "unknown severity")
    counted = issues.groupBy("site").agg(F.count(F.lit(1)).alias("issues"), F.count_if(repairable).alias("repairable"))
    out = summary.select("site").join(counted, "site", "left").select(
        "site", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("repairable", F.lit(0)).alias("repairable"),
    )
    return out.withColumn("verdict", F.when(F.col("issues") == 0, "ACCEPT").when(F.col("issues") == F.col("repairable"), "REPAIR").otherwise("REGENERATE"))


def repaired(findings: DataFrame, dropped: DataFrame) -> DataFrame:
    """The findings without those that the review dropped and those of level 4, severities capped,
    priorities brought down to them, times and ids given anew."""
    kept = findings.join(dropped.select("site", "check_id").distinct(), ["site", "check_id"], "left_anti").where(F.coalesce(F.col("claim_level"), F.lit(1)) < 4)
    level = F.when(F.col("claim_level").between(1, 3), F.col("claim_level")).otherwise(1)
    kept = kept.withColumn("claim_level", level).withColumn("severity", scores.capped(F.col("severity"), F.col("claim_level")))
    most = F.when(F.col("severity") == "info", "low").otherwise(F.col("severity"))
    over = (scores.rank(F.col("priority"), review.PRIORITIES) < scores.rank(most, review.PRIORITIES)) | ~F.coalesce(F.col("priority").isin(*review.PRIORITIES), F.lit(False))
    return review.numbered(kept.withColumn("priority", F.when(over, most).otherwise(F.col("priority"))).drop("id", "position"))


def limitations(notes: DataFrame) -> DataFrame:
    """(site, limitation), distinct: what the notes of discovery mean; unknown notes as they are."""
    out = F.when(F.lit(False), "")
    for part, meaning in LIMITATIONS.items():
        out = out.when(F.contains(F.lower("note"), F.lit(part)), meaning)
    return notes.where("note is not null").select("site", out.otherwise(F.col("note")).alias("limitation")).distinct()


def thresholds(calibrated: DataFrame, operator: dict[str, float] | None = None) -> DataFrame:
    """(site, name, value, source, provenance) of every threshold: the operator's if set, else the site's
    calibrated one (columns of `calibrated` named after the threshold), else the published one."""
    rows = []
    for name, published in fixed.THRESHOLDS.items():
        own = F.col(name).cast("double") if name in calibrated.columns else F.lit(None).cast("double")
        given = F.lit((operator or {}).get(name)).cast("double")
        source = F.when(given.isNotNull(), "operator").when(own.isNotNull(), "site-calibrated").otherwise("paper")
        rows.append(F.struct(F.lit(name).alias("name"), F.coalesce(given, own, F.lit(published)).alias("value"), source.alias("source")))
    out = calibrated.select("site", F.inline(F.array(*rows)))
    shown = F.regexp_replace(F.format_string("%.6f", "value"), r"\.?0+$", "")
    return out.withColumn("provenance", F.concat("name", F.lit("="), shown, F.lit(" ("), "source", F.lit(")")))


def exempt_split(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, exempt with a reason) of pages with page_type: legal pages aren't meant to be quoted."""
    exempt = [n for n, e in fixed.PAGE_EXPECTATIONS.items() if e[5]]
    is_exempt = F.coalesce(F.col("page_type").isin(*exempt), F.lit(False))
    return pages.where(~is_exempt), pages.where(is_exempt).withColumn("reason", F.concat(F.lit("pages of type "), "page_type", F.lit(" are exempt")))
