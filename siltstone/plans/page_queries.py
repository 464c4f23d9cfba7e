"""Queries on single pages and on what pages declare, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import fixed, markup, text, urls
from siltstone.operators import entities
from siltstone.plans import oracles
from siltstone.plans.oracles import _count, _q
from siltstone.session import spread, table

SQL: dict[str, str] = {}


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "validated_urls").select("page_id", F.col("registrable_domain").alias("site"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return entities.top_level_nodes(table(spark, d, "html_docs"))


# --- structured data
_STRINGS = "CASE json_type(node, {p}) WHEN 'ARRAY' THEN list_filter(list_transform(json_extract(node, {p} || '[*]'), lambda x: CASE WHEN json_type(x) NOT IN ('OBJECT', 'ARRAY') THEN x ->> '$' END), lambda x: x IS NOT NULL) WHEN 'OBJECT' THEN [] WHEN 'NULL' THEN [] ELSE CASE WHEN json_type(node, {p}) IS NULL THEN [] ELSE [node ->> {p}] END END"
_TYPE_LISTS = [_STRINGS.replace("{p}", f"'$.\"{n}\"'") for n in ("@type", "type")]
_TYPES = f"list_transform(CASE WHEN len({_TYPE_LISTS[0]}) > 0 THEN {_TYPE_LISTS[0]} ELSE {_TYPE_LISTS[1]} END, lambda t: regexp_extract(t, '([^/:]*)$', 1))"
NODES = f"""
raw AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS block, json_ld[i] AS t FROM (SELECT page_id, json_ld, unnest(range(1, len(json_ld) + 1)) AS i FROM html_docs)),
val AS (SELECT page_id, block, t::JSON AS v FROM raw WHERE json_valid(t) AND NOT regexp_matches(t, ',\\s*[}}\\]]')),
obj AS (SELECT page_id, block, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END) AS node FROM val),
mem AS (SELECT page_id, block, CASE WHEN json_type(node, '$."@graph"') = 'ARRAY' THEN list_concat(json_extract(node, '$."@graph"[*]'), CASE WHEN len({_TYPES}) > 0 THEN [node] ELSE [] END) ELSE [node] END AS ns FROM obj WHERE json_type(node) = 'OBJECT'),
num AS (SELECT page_id, block, CAST(k - 1 AS INTEGER) AS no, ns[k] AS node FROM (SELECT page_id, block, ns, unnest(range(1, len(ns) + 1)) AS k FROM mem)),
nodes AS (SELECT page_id, block, no, node, {_TYPES} AS types FROM num WHERE json_type(node) = 'OBJECT')"""
_LISTED = lambda names: "[" + ", ".join(map(_q, names)) + "]"
_ORG = f"list_has_any(types, {_LISTED(fixed.ORGANIZATION_TYPES)})"


def _has(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"coalesce(CAST(json_extract(node, '$.\"{n}\"') AS VARCHAR), 'null') NOT IN ('null', '\"\"', '[]', '{{}}')" for n in names) + ")"


def jsonld_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each top-level node with its types and name."""
    n = _nodes(spark, d)
    return n.select("page_id", "block", "no", F.array_join("types", ",").alias("types"), entities.flat_text(entities.prop(F.col("node"), "name")).alias("name"))


SQL["jsonld_top_nodes"] = f"WITH {NODES} SELECT page_id, block, no, array_to_string(types, ',') AS types, CASE WHEN json_type(node, '$.name') = 'VARCHAR' THEN trim(regexp_replace(node ->> '$.name', '\\s+', ' ', 'g')) ELSE '' END AS name FROM nodes"


def jsonld_top_types(spark: SparkSession, d: str) -> DataFrame:
    """The 30 types that most pages have among their top-level nodes."""
    each = entities.page_types(_nodes(spark, d)).select(F.explode("types").alias("type"))
    return each.groupBy("type").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "type").limit(30)


SQL["jsonld_top_types"] = f"WITH {NODES} SELECT type, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(types) AS type FROM nodes) GROUP BY type ORDER BY pages DESC, type LIMIT 30"


def markup_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per site, the pages with each sort of structured data."""
    some = lambda n: F.coalesce(F.array_size(n), F.lit(0)) > 0
    ld, other = some("json_ld"), some("microdata_types") | some("rdfa_types")
    h = table(spark, d, "html_docs").select("page_id", ld.alias("ld"), other.alias("other")).join(_sites(spark, d), "page_id")
    out = h.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("ld").alias("json_ld"), F.count_if("other").alias("microdata_or_rdfa"),
        F.count_if(F.col("ld") | F.col("other")).alias("any_markup"),
    )
    return out.withColumn("coverage", F.round(F.col("json_ld") / F.col("pages"), 3))


SQL["markup_coverage"] = """
WITH h AS (SELECT registrable_domain AS site, coalesce(len(json_ld), 0) > 0 AS ld, coalesce(len(microdata_types), 0) > 0 OR coalesce(len(rdfa_types), 0) > 0 AS other FROM html_docs JOIN validated_urls USING (page_id))
SELECT site, count(*) AS pages, count(*) FILTER (WHERE ld) AS json_ld, count(*) FILTER (WHERE other) AS microdata_or_rdfa, count(*) FILTER (WHERE ld OR other) AS any_markup, round(count(*) FILTER (WHERE ld) / count(*), 3) AS coverage FROM h GROUP BY site
"""


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    return entities.name_variants(_nodes(spark, d).join(_sites(spark, d), "page_id"))


_FORM = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), '\\b(inc|llc|ltd|limited|corp|corporation|gmbh|bv|plc|co|sa|ag)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_TEXT = lambda p: f"CASE WHEN json_type(node, '{p}') = 'VARCHAR' AND trim(node ->> '{p}') <> '' THEN node ->> '{p}' END"
SQL["name_variants"] = f"""
WITH {NODES}, org AS (SELECT page_id, registrable_domain AS site, coalesce({_TEXT('$.name')}, {_TEXT('$.legalName')}) AS name, right(regexp_replace({_TEXT('$.telephone')}, '\\D', '', 'g'), 10) AS phone,
  coalesce({_TEXT('$.address')}, CASE WHEN json_type(node, '$.address') = 'OBJECT' THEN nullif(concat_ws(', ', {', '.join(f"coalesce({_TEXT(f'$.address.{k}')}, {_TEXT(f'$.address.{k}.name')})" for k in fixed.ADDRESS_KEYS)}), '') END) AS address FROM nodes JOIN validated_urls USING (page_id) WHERE {_ORG}),
e AS (SELECT site, page_id, 'name' AS kind, {_FORM('name')} AS value FROM org WHERE name IS NOT NULL UNION ALL SELECT site, page_id, 'phone', phone FROM org WHERE length(phone) >= 7 UNION ALL SELECT site, page_id, 'address', {_FORM('address')} FROM org WHERE address IS NOT NULL)
SELECT site, kind, value, count(DISTINCT page_id) AS pages FROM e GROUP BY 1, 2, 3
"""


def best_organisation(spark: SparkSession, d: str) -> DataFrame:
    b = entities.best_organisation(_nodes(spark, d).join(_sites(spark, d), "page_id"))
    return b.select("site", "page_id", "score", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


_SAME = _STRINGS.replace("{p}", "'$.sameAs'")
SQL["best_organisation"] = f"""
WITH {NODES}, org AS (SELECT registrable_domain AS site, page_id, block, no, list_filter([{', '.join(f"CASE WHEN {_has(names)} THEN {_q(n)} END" for n, names in fixed.ORGANIZATION_FIELDS.items())}], lambda x: x IS NOT NULL) AS present, {_SAME} AS links FROM nodes JOIN validated_urls USING (page_id) WHERE {_ORG}),
r AS (SELECT *, len(present) + len(links) AS score, row_number() OVER (PARTITION BY site ORDER BY len(present) + len(links) DESC, page_id, block, no) AS r FROM org)
SELECT site, page_id, CAST(score AS INTEGER) AS score, array_to_string(present, ',') AS present, array_to_string(list_filter({_LISTED(fixed.ORGANIZATION_FIELDS)}, lambda x: NOT list_contains(present, x)), ',') AS missing FROM r WHERE r = 1
"""


def identity_links(spark: SparkSession, d: str) -> DataFrame:
    """Organisations' links to themselves elsewhere; sites without one give no row."""
    return entities.identity_links(_nodes(spark, d).join(_sites(spark, d), "page_id"))


SQL["identity_links"] = f"""
WITH {NODES}, l AS (SELECT DISTINCT site, trim(link) AS link FROM (SELECT registrable_domain AS site, unnest({_SAME}) AS link FROM nodes JOIN validated_urls USING (page_id) WHERE {_ORG}) WHERE trim(link) <> '')
SELECT site, count(*) AS links, count(DISTINCT nullif(regexp_replace(lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', ''), '')) AS hosts FROM l GROUP BY site
"""


def missing_properties(spark: SparkSession, d: str) -> DataFrame:
    return entities.missing_properties(_nodes(spark, d))


SQL["missing_properties"] = f"""
WITH {NODES}, t AS (SELECT node, unnest(types) AS type FROM nodes),
m AS (SELECT type, array_to_string(list_filter(CASE type {' '.join(f"WHEN {_q(t)} THEN [{', '.join(f'CASE WHEN NOT {_has(names)} THEN {_q(label)} END' for label, names in rules.items())}]" for t, rules in fixed.REQUIRED_PROPERTIES.items())} ELSE [] END, lambda x: x IS NOT NULL), ', ') AS missing FROM t),
c AS (SELECT type, missing, count(*) AS nodes FROM m WHERE missing <> '' GROUP BY 1, 2)
SELECT type, missing, nodes FROM c QUALIFY row_number() OVER (PARTITION BY type ORDER BY nodes DESC, missing) <= 3
"""


def type_expectations(spark: SparkSession, d: str) -> DataFrame:
    """Per page type: pages, those with a type that says what they are about, with an expected one, and with
    types of two primary groups."""
    v = table(spark, d, "validated_urls").select("page_id", urls.page_type(F.col("url")).alias("page_type"))
    p = entities.with_expectations(v).join(entities.page_types(_nodes(spark, d)), "page_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    r = p.select("page_type", entities.type_report(F.col("types"), F.col("schema_types")).alias("r"))
    return r.groupBy("page_type").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.size("r.specific") > 0).alias("specific"), F.count_if("r.matches").alias("expected"),
        F.count_if(F.size("r.groups") > 1).alias("mixed"),
    )


_EXPECTED = "CASE page_type " + " ".join(f"WHEN {_q(n)} THEN {_LISTED(e[0]) if e[0] else '[]::VARCHAR[]'}" for n, e in fixed.PAGE_EXPECTATIONS.items()) + " END"
_GROUPS = " + ".join(f"CAST(list_has_any(types, {_LISTED(m)}) AS INTEGER)" for m in fixed.PRIMARY_TYPES.values())
SQL["type_expectations"] = f"""
WITH {NODES}, t AS (SELECT page_id, list_distinct(flatten(list(types))) AS types FROM nodes GROUP BY page_id),
p AS (SELECT {oracles.TYPE} AS page_type, coalesce(types, []) AS types FROM validated_urls LEFT JOIN t USING (page_id))
SELECT page_type, count(*) AS pages, count(*) FILTER (WHERE len(list_filter(types, lambda x: NOT list_contains({_LISTED(fixed.GENERIC_TYPES)}, x))) > 0) AS specific, count(*) FILTER (WHERE list_has_any(types, {_EXPECTED})) AS expected, count(*) FILTER (WHERE {_GROUPS} > 1) AS mixed FROM p GROUP BY 1
"""


# --- text and markup of single pages
def lead_signals(spark: SparkSession, d: str) -> DataFrame:
    """Of each document's first words, how much is promotion and how much evidence; update language; and
    whether its site's name is in it."""
    t = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    token = F.get(F.split("source", r"\."), F.lit(0))
    return t.select(
        "doc_id", F.inline(F.array(text.lead_signals(F.col("text")))), text.update_language(F.col("text")).alias("update_language"),
        text.brand_named(token, F.col("text"), F.lit(None).cast("string")).alias("brand_named"), text.ambiguous_brand(token).alias("ambiguous"),
    )


_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1680}\\x{0085}]+'), lambda w: w <> '')"
SQL["lead_signals"] = f"""
WITH l AS (SELECT doc_id, text, split_part(source, '.', 1) AS token, array_to_string(({_W})[1:{fixed.LEAD_WORDS}], ' ') AS lead, least({fixed.LEAD_WORDS}, len({_W})) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS lead_words, {_count('lead', fixed.MARKETING)} AS marketing, {' + '.join(_count('lead', p) for p in (fixed.DEFINITION, fixed.NUMERIC, fixed.COMPARISON))} AS evidence, regexp_matches(coalesce(text, ''), {_q('(?i)' + fixed.UPDATE_LANGUAGE)}) AS update_language,
  token <> '' AND contains(lower(coalesce(text, '')), lower(token)) AS brand_named, regexp_matches(lower(token), '^[a-z]{{1,4}}$') OR regexp_matches(lower(token), {_q(fixed.BRAND_SUFFIXES)}) AS ambiguous FROM l
"""


def soft_404(spark: SparkSession, d: str) -> DataFrame:
    """Pages served with a good status that say nothing is there."""
    h = table(spark, d, "html_docs").select("page_id", "title", "text", text.word_count(F.col("main_text")).alias("words"))
    ok = table(spark, d, "fetch_results").where("status between 200 and 299").select("page_id")
    return h.where(text.soft_404(F.col("title"), F.col("words"), F.col("text"))).select("page_id").join(ok, "page_id", "left_semi")


SQL["soft_404"] = f"""
SELECT page_id FROM html_docs WHERE page_id IN (SELECT page_id FROM fetch_results WHERE status BETWEEN 200 AND 299)
  AND (regexp_matches(coalesce(title, ''), {_q('(?i)' + fixed.SOFT_404)}) OR ({oracles._words('main_text')} < 120 AND regexp_matches(coalesce(text, '')[:1200], {_q('(?i)' + fixed.SOFT_404)})))
"""


def canonical_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose canonical address is neither theirs nor that of any fetched page: an anti join."""
    bare = lambda c: F.rtrim(F.col(c), F.lit("/"))
    f = table(spark, d, "fetch_results").where("final_url is not null")
    # the pages' own are right; every seventh is moved
    moved = F.when(F.col("page_id") % 7 == 0, F.concat("canonical", F.lit("/moved"))).otherwise(F.col("canonical"))
    h = table(spark, d, "html_docs").where("canonical <> ''").withColumn("canonical", moved).select("page_id", bare("canonical").alias("canonical")).join(
        f.select("page_id", bare("url").alias("url")), "page_id",
    )
    known = f.select(bare("final_url").alias("canonical")).distinct()
    return h.where("canonical <> url").join(known, "canonical", "left_anti").select("page_id", "canonical")


SQL["canonical_elsewhere"] = """
SELECT h.page_id, rtrim(canonical, '/') AS canonical FROM (SELECT page_id, canonical || CASE WHEN page_id % 7 = 0 AND canonical <> '' THEN '/moved' ELSE '' END AS canonical FROM html_docs) h JOIN fetch_results f USING (page_id) WHERE canonical <> '' AND final_url IS NOT NULL AND rtrim(canonical, '/') <> rtrim(url, '/') AND rtrim(canonical, '/') NOT IN (SELECT rtrim(final_url, '/') FROM fetch_results WHERE final_url IS NOT NULL)
"""


MADE_FORM = ('<form><label for="e">E</label><input id="e" type="email" required="1"><input type="', '"><textarea ', 'placeholder="x"', "></textarea></form>")


def form_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every form with its fields, those without a label and the required ones."""
    # the pages' own forms have search fields only; one more is put behind each page
    kind = F.element_at(F.array(F.lit("hidden"), F.lit("text"), F.lit("search")), (F.col("page_id") % 3 + 1).cast("int"))
    form = F.concat(F.lit(MADE_FORM[0]), kind, F.lit(MADE_FORM[1]), F.when(F.col("page_id") % 2 == 0, MADE_FORM[2]).otherwise(""), F.lit(MADE_FORM[3]))
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", F.concat("body", form).alias("body")))
    return f.select("page_id", F.posexplode(markup.forms(F.col("body"))).alias("form", "f")).select("page_id", "form", "f.*")


_ATTR = lambda n: f"regexp_matches(x, '(?i)\\b{n}\\s*=')"
SQL["form_fields"] = f"""
WITH b AS (SELECT page_id, CASE WHEN regexp_matches(body, '(?is)<form\\b[^>]*>.*?</form\\s*>') THEN regexp_extract_all(body, '(?is)<form\\b[^>]*>(.*?)</form\\s*>', 1) WHEN regexp_matches(body, '(?i)<form\\b[^>]*>') THEN [regexp_extract(body, '(?is)<form\\b[^>]*>(.*)$', 1)] ELSE [] END[:6] AS blocks FROM (SELECT page_id, body || {_q(MADE_FORM[0])} || ['hidden', 'text', 'search'][page_id % 3 + 1] || {_q(MADE_FORM[1])} || CASE WHEN page_id % 2 = 0 THEN {_q(MADE_FORM[2])} ELSE '' END || {_q(MADE_FORM[3])} AS body FROM fetch_results WHERE body IS NOT NULL)),
e AS (SELECT page_id, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS k FROM b),
t AS (SELECT page_id, k, list_filter(regexp_extract_all(block, '(?i)<(?:input|select|textarea)\\b[^>]*>'), lambda x: NOT (regexp_matches(x, '(?i)^<input') AND lower(regexp_extract(x, '(?i)\\btype\\s*=\\s*["'']?([a-z]+)', 1)) IN {str(fixed.NO_FIELDS)}) AND NOT {_ATTR('hidden')}) AS tags, regexp_extract_all(block, '(?i)<label\\b[^>]*\\bfor\\s*=\\s*["'']([^"'']+)["'']', 1) AS labels FROM e),
n AS (SELECT page_id, k, len(tags) AS fields, len(list_filter(tags, lambda x: NOT ({' OR '.join(_ATTR(a) for a in ('aria-label', 'aria-labelledby', 'placeholder', 'title'))} OR coalesce(list_contains(labels, regexp_extract(x, '(?i)\\bid\\s*=\\s*["'']?([^"''\\s>]+)', 1)), false)))) AS unlabelled, len(list_filter(tags, lambda x: {_ATTR('required')})) AS required FROM t WHERE len(tags) > 0)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS form, fields, unlabelled, required FROM n
"""


def layers_before(spark: SparkSession, d: str) -> DataFrame:
    """Signs that something stands before the page, and whether there is a breadcrumb in the markup."""
    b = F.col("body")
    f = spread(table(spark, d, "fetch_results").where("body is not null").select("page_id", "body")).select(
        "page_id", F.inline(F.array(markup.layers_before(b))), markup.breadcrumb(b).alias("breadcrumb"),
    )
    return f.select("page_id", F.array_join("strong", ",").alias("strong"), F.array_join("weak", ",").alias("weak"), "breadcrumb")


_NAMED = lambda patterns: "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(body, {_q('(?i)' + p)}) THEN {_q(n)} END" for n, p in patterns.items()) + ")"
SQL["layers_before"] = f"SELECT page_id, {_NAMED(fixed.STRONG_LAYERS)} AS strong, {_NAMED(fixed.WEAK_LAYERS)} AS weak, regexp_matches(body, {_q('(?i)' + fixed.BREADCRUMB)}) AS breadcrumb FROM fetch_results WHERE body IS NOT NULL"


def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Per site, pages with a breadcrumb in the markup or in the structured data."""
    b = layers_before(spark, d).select("page_id", "breadcrumb")
    declared = _nodes(spark, d).where(F.array_contains("types", "BreadcrumbList")).select("page_id", F.lit(True).alias("declared")).distinct()
    j = b.join(declared, "page_id", "left").join(_sites(spark, d), "page_id")
    return j.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("breadcrumb") | F.coalesce("declared", F.lit(False))).alias("with_breadcrumb"))


SQL["breadcrumbs"] = f"""
WITH {NODES}, b AS (SELECT page_id, regexp_matches(body, {_q('(?i)' + fixed.BREADCRUMB)}) AS b FROM fetch_results WHERE body IS NOT NULL)
SELECT registrable_domain AS site, count(*) AS pages, count(*) FILTER (WHERE b OR page_id IN (SELECT page_id FROM nodes WHERE list_contains(types, 'BreadcrumbList'))) AS with_breadcrumb FROM b JOIN validated_urls USING (page_id) GROUP BY 1
"""


def render_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How much of each page's markup is text, and how much of its text lies outside the main region."""
    h = table(spark, d, "html_docs")
    words = lambda c: text.word_count(F.col(c))
    gap = text.render_gap(words("text"), F.length(F.coalesce("text", F.lit(""))), F.col("inline_script_chars"), F.col("raw_html_chars"))
    return h.select("page_id", F.inline(F.array(gap)), text.boilerplate_ratio(words("main_text"), words("text")).alias("boilerplate"))


_T, _M = oracles._words("text"), oracles._words("main_text")
SQL["render_gaps"] = f"""
WITH r AS (SELECT page_id, {_T} AS words, {_M} AS main, round(length(coalesce(text, '')) / greatest(1, raw_html_chars), 4) AS text_to_html, round(inline_script_chars / greatest(1, length(coalesce(text, ''))), 2) AS script_to_text FROM html_docs)
SELECT page_id, text_to_html, script_to_text, words < {fixed.GAP_WORDS} AND (text_to_html < 0.05 OR script_to_text > 3.0) AS likely, CASE WHEN words > 0 THEN round(greatest(0.0, (words - main) / words), 4) ELSE 0.0 END AS boilerplate FROM r
"""


def score_notes(spark: SparkSession, d: str) -> DataFrame:
    """Remarks on each page's score and the genres it lacks."""
    h = spread(table(spark, d, "html_docs").select("page_id", "main_text")).select(
        "page_id", text.word_count(F.col("main_text")).alias("words"), *text.genre_counts(F.col("main_text")),
    )
    h = h.withColumn("g", text.genres(fixed.POSITIVE_GENRES)).withColumn("survey", text.genres(fixed.SURVEY_GENRES))
    lacking = F.array_except(F.array(*map(F.lit, ("definition", "numeric", "comparison", "howto"))), F.col("g"))
    return h.select(
        "page_id", F.array_join(text.score_notes(F.col("words"), F.col("n_qa"), F.size("g"), F.col("n_hedge")), ",").alias("notes"),
        F.array_join(lacking, ",").alias("missing"), F.array_join("survey", ",").alias("survey"),
    )


_IF = lambda g: f"n_{g} >= {fixed.GENRES[g][1]}"
SQL["score_notes"] = f"""
WITH c AS (SELECT page_id, {_M} AS words, {oracles.GENRES.replace('{t}', 'main_text')} FROM html_docs), g AS (SELECT *, {oracles.POSITIVE} AS genres FROM c)
SELECT page_id, concat_ws(',', CASE WHEN {_IF('qa')} AND genres = 0 THEN 'qa_without_evidence' END, CASE WHEN words < {fixed.LEAST_ABSORBABLE_WORDS} THEN 'below_absorbable_length' END, CASE WHEN n_hedge >= {fixed.HEDGES} AND genres <= 1 THEN 'asserted_not_substantiated' END) AS notes,
  concat_ws(',', {', '.join(f"CASE WHEN NOT ({_IF(g)}) THEN '{g}' END" for g in ('definition', 'numeric', 'comparison', 'howto'))}) AS missing, concat_ws(',', {', '.join(f"CASE WHEN {_IF(g)} THEN '{g}' END" for g in fixed.SURVEY_GENRES)}) AS survey FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        jsonld_top_nodes, jsonld_top_types, markup_coverage, name_variants, best_organisation, identity_links, missing_properties, type_expectations,
        lead_signals, soft_404, canonical_elsewhere, form_fields, layers_before, breadcrumbs, render_gaps, score_notes,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return SQL
