"""Findings as rows, and the review that drops, demotes, merges and numbers them.

A finding is (site, check_id, title, severity, claim_level, confidence, evidence, observed, expected,
sample_size, urls, action, mechanism, priority, layer). Gates are column expressions evaluated in order;
the first that fails gives the reason. Null texts count as empty, null lists as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import fixed, scores

# Language of the gates, legitimate noindex routes, and which checks are symptoms of which.
CAUSAL = r"\b(will (?:increase|improve|boost|drive|cause|result in)|guarantees?|ensures? that|causes?|leads? directly to|proven to (?:increase|improve))\b"
HEDGED = r"\b(may|might|likely|tends? to|associated with|correlat\w+|suggests?|consistent with|proxy|interpretation|hypothes\w+)\b"
NOINDEX_ROUTES = r"/(search|filter|sort|page/\d|tag/|\?|preview|staging|draft|cart|checkout|account|login|thank-?you|confirmation)"
ROOT_CAUSES = {
    "empty_shell": ("thin_content", "no_evidence_genre", "unstructured_page", "missing_structured_data", "no_jsonld", "answer_not_first"), "state_blob": ("thin_content", "no_evidence_genre", "unstructured_page"), "script_heavy_shell": ("thin_content", "no_evidence_genre"),
    "thin_served_html": ("thin_content", "no_evidence_genre"), "robots_blocks_all": ("sitemap_orphans", "page_unreachable"), "no_https": ("https_not_enforced",),
}
PRIORITIES = ("critical", "high", "medium", "low")
LAYERS = ("preflight", "reachability", "selection", "absorption", "trust", "engagement")
CONFIDENCES = ("high", "medium", "low")
UPPER_WORDS, LOWER_WORDS = ("under", "below", "less than", "at most", "no more than"), ("at least", "above", "over", "more than", "minimum")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def urls_of() -> Column:
    """The listed URLs, or else those in the evidence."""
    listed = F.coalesce(F.col("urls"), F.array().cast("array<string>"))
    return F.when(F.size(listed) > 0, listed).otherwise(F.regexp_extract_all(_text("evidence"), F.lit(r"https?://[^\s,;)\"']+"), F.lit(0)))


def population() -> Column:
    """(k, n) of the first 'k of n' in observed or else in the evidence."""
    pick = lambda t: F.when(
        t.rlike(r"\b\d+\s+of\s+\d+\b"),
        F.struct(F.regexp_extract(t, r"\b(\d+)\s+of\s+\d+\b", 1).cast("bigint").alias("k"), F.regexp_extract(t, r"\b\d+\s+of\s+(\d+)\b", 1).cast("bigint").alias("n")),
    )
    return F.coalesce(pick(_text("observed")), pick(_text("evidence")))


def _first_number(t: Column) -> Column:
    return F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def insufficient() -> Column:
    e = F.trim(_text("evidence"))
    return F.when(F.length(e) < 40, "evidence too short").when(F.size(urls_of()) == 0, "no URL").when(
        ~e.rlike(r"\d") & (_text("observed") == ""), "no observed value",
    ).when(F.length(F.trim(_text("action"))) < 15, "action too vague")


def incoherent() -> Column:
    low = F.lower(_text("expected"))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    o, x, p = _first_number(_text("observed")), _first_number(low), population()
    zero = (p["k"] == 0) & ~F.contains(_text("observed"), F.lit("0 of"))
    satisfied = F.when(some(UPPER_WORDS), o < x).when(some(LOWER_WORDS), o > x).otherwise(F.lit(False))
    return F.when(o.isNotNull() & x.isNotNull() & F.when(p.isNotNull(), zero).otherwise(satisfied), "expectation is met")


def trapped(kinds: Column) -> Column:
    """The reason why a finding is a known false positive; kinds are the page types of its URLs."""
    check, urls, p = F.col("check_id"), urls_of(), population()
    only = lambda *types: (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, types)))) == 0)
    return (
        F.when((check == "noindex_on_public_page") & (F.size(urls) > 0) & F.forall(urls, lambda u: u.rlike(f"(?i){NOINDEX_ROUTES}")), "noindex is right on these routes")
        .when(check.isin("missing_structured_data", "schema_type_mismatch", "no_jsonld") & only("legal", "about", "category", "other"), "types need no schema")
        .when(check.isin("thin_content", "no_evidence_genre", "unstructured_page") & only("legal", "category"), "types are exempt")
        .when((check == "sitemap_orphans") & (p["n"] < 3), "too few crawled pages")
        .when((check == "marketing_over_evidence") & only("homepage"), "homepage only")
        .when((check == "slow_response") & (_first_number(_text("observed")) < 3000), "within the expectation")
    )


def review(findings: DataFrame, page_types: DataFrame | None = None, least_sample: int = 3) -> DataFrame:
    """findings with `drop_reason` (null if kept) and the severity, level, confidence and priority that
    the gates leave. page_types (url, page_type) meets the findings' URLs by an equi join."""
    if "finding_no" not in findings.columns:
        raise ValueError("findings need a finding_no, by which they are told apart")
    f = findings.withColumn("_id", F.col("finding_no"))
    if page_types is None:
        f = f.withColumn("_kinds", F.array_distinct(F.transform(urls_of(), lambda _: F.lit("other"))))
    else:
        each = f.select("_id", F.explode(F.array_distinct(urls_of())).alias("url")).join(page_types.select("url", "page_type").dropDuplicates(["url"]), "url", "left")
        f = f.join(
            each.groupBy("_id").agg(F.collect_set(F.coalesce("page_type", F.lit("other"))).alias("_kinds")), "_id", "left",
        ).withColumn("_kinds", F.coalesce("_kinds", F.array().cast("array<string>")))
    p = population()
    sample = F.when(F.coalesce(F.col("sample_size"), F.lit(0)) > 0, F.col("sample_size").cast("bigint")).otherwise(F.coalesce(p["n"], F.lit(0)))
    small = (sample > 0) & (sample < least_sample)
    level = F.coalesce(F.col("claim_level"), F.lit(1))
    reason = F.coalesce(
        insufficient(), incoherent(), trapped(F.col("_kinds")), F.when(small & F.coalesce(p["k"] < 1, F.lit(True)), "sample too small"),
        F.when(level == 4, "causal prescription"),
    )
    next_severity = F.get(F.array(*map(F.lit, fixed.SEVERITIES)), F.least(scores.rank(F.col("severity"), fixed.SEVERITIES) + 1, F.lit(len(fixed.SEVERITIES) - 1)))
    demoted = F.when(small, scores.capped(next_severity, F.least(level, F.lit(2)))).otherwise(F.col("severity"))
    claims = F.concat_ws(" ", _text("evidence"), _text("mechanism"))
    causal = claims.rlike(f"(?i){CAUSAL}") & ~claims.rlike(f"(?i){HEDGED}") & (level <= 2)
    f = f.withColumn("drop_reason", reason).withColumn("_s", demoted).withColumn("_l", F.when(causal, 3).otherwise(level))
    f = f.withColumn(
        "confidence", F.when(small, "low").otherwise(F.col("confidence")),
    ).withColumn("claim_level", F.col("_l")).withColumn("severity", scores.capped(F.col("_s"), F.col("_l")))
    cap = F.when(F.col("severity") == "info", "low").otherwise(F.col("severity"))
    f = f.withColumn("priority", F.when(scores.rank(F.col("priority"), PRIORITIES) < scores.rank(cap, PRIORITIES), cap).otherwise(F.col("priority")))
    return f.drop("_id", "_kinds", "_s", "_l")


def merged(findings: DataFrame) -> DataFrame:
    """findings (with finding_no) without the symptoms whose URLs all belong to the first finding of a
    root cause of the site; each root has `consequences`, the titles it absorbed."""
    spark = findings.sparkSession
    pairs = spark.createDataFrame([(i, root, s) for i, (root, symptoms) in enumerate(ROOT_CAUSES.items()) for s in symptoms], "rank int, root string, symptom string")
    f = findings.withColumn("_urls", urls_of())
    roots = f.join(
        F.broadcast(pairs.select("rank", F.col("root").alias("check_id")).distinct()), "check_id",
    ).withColumn("_first", F.row_number().over(W.partitionBy("site", "check_id").orderBy("finding_no"))).where("_first = 1 and size(_urls) > 0")
    roots = roots.select("site", F.col("check_id").alias("root"), F.col("finding_no").alias("root_no"), F.col("_urls").alias("root_urls"))
    held = f.where("size(_urls) > 0").join(
        F.broadcast(pairs), F.col("check_id") == F.col("symptom"),
    ).join(roots, ["site", "root"]).where(F.size(F.array_except("_urls", "root_urls")) == 0)
    owner = held.groupBy("site", "finding_no").agg(F.min_by("root_no", "rank").alias("root_no"), F.first("title").alias("title"))
    gained = owner.groupBy("site", "root_no").agg(F.array_sort(F.collect_list("title")).alias("consequences")).withColumnRenamed("root_no", "finding_no")
    return findings.join(owner.select("site", "finding_no"), ["site", "finding_no"], "left_anti").join(gained, ["site", "finding_no"], "left")


def numbered(findings: DataFrame) -> DataFrame:
    """findings in report order with ids F-001..., by site: severity, layer, confidence, title."""
    w = W.partitionBy("site").orderBy(
        scores.rank(F.col("severity"), fixed.SEVERITIES), scores.rank(F.col("layer"), LAYERS), scores.rank(F.col("confidence"), CONFIDENCES), "title",
        "check_id",
    )
    return findings.withColumn("position", F.row_number().over(w)).withColumn("id", F.format_string("F-%03d", "position"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row a site with the count of each severity, zeros included."""
    return findings.groupBy("site").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES), F.count(F.lit(1)).alias("total"))
