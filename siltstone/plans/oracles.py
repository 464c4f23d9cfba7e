"""DuckDB SQL for the core queries that SQL can express."""

from __future__ import annotations

from siltstone.functions import fixed, hosts
from siltstone.plans.site_queries import AGENTS, NOW


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), {_q('(?i)' + pattern)}))"


def _words(column: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({column}, ''), '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}\\x{{0085}}]+'), lambda w: w <> ''))"


GENRES = ", ".join(f"{_count('{t}', p)} AS n_{g}" for g, (p, _) in fixed.GENRES.items()) + f", {_count('{t}', fixed.HEDGE)} AS n_hedge"
POSITIVE = " + ".join(f"CAST(n_{g} >= {fixed.GENRES[g][1]} AS INTEGER)" for g in fixed.POSITIVE_GENRES)
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
AUTHORITY = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
HOST = f"rtrim(lower(regexp_replace(regexp_replace({AUTHORITY}, '^.*@', ''), ':\\d*$', '')), '.')"
TYPE = f"CASE WHEN {PATH} IN ('', '/') THEN 'homepage' " + " ".join(f"WHEN regexp_matches({PATH}, {_q('(?i)' + p)}) THEN '{n}'" for n, p in fixed.PAGE_TYPES) + " ELSE 'other' END"


def _domain(host: str) -> str:
    parts = f"string_split({host}, '.')"
    second = ", ".join(_q(x) for x in fixed.SECOND_LEVEL)
    return f"CASE WHEN len({parts}) <= 2 THEN {host} WHEN {parts}[-2] IN ({second}) AND length({parts}[-1]) <= 3 THEN array_to_string({parts}[-3:], '.') ELSE array_to_string({parts}[-2:], '.') END"


def _graded(c: str, floor: int, full: int) -> str:
    return f"CASE WHEN {c} < {floor} THEN round(least(0.49, {c} / {float(floor)}::DOUBLE * 0.49), 4) WHEN {c} >= {full} THEN 1.0 ELSE round(0.5 + 0.5 * ({c} - {floor}) / {float(full - floor)}::DOUBLE, 4) END"


_W = fixed.SCORE_WEIGHTS
SCORE = f"round({_W['words']}::DOUBLE * least(1.0, greatest(0.0, words / {fixed.WORD_TARGET}::DOUBLE)) + {_W['headings']}::DOUBLE * least(1.0, greatest(0.0, headings / {fixed.HEADING_TARGET}::DOUBLE)) + " + " + ".join(f"{_W[g]}::DOUBLE * ({_graded('n_' + g, *fixed.GRADES[g])})" for g in (
    "definition", "numeric", "comparison",
)) + ", 4)"
RATING = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for name, least in fixed.RATINGS) + " ELSE 'very_weak' END"
BAND = "CASE " + " ".join(f"WHEN words BETWEEN {a} AND {b} THEN '{a}-{b}'" if b < 10**9 else f"WHEN words >= {a} THEN '>3000'" for a, b, _ in fixed.WORD_BINS) + " ELSE 'unknown' END"
SCORED = f"""
counted AS (SELECT page_id, {_words('main_text')} AS words, coalesce(len(headings), 0) AS headings, {GENRES.replace('{t}', 'main_text')} FROM html_docs),
scored AS (SELECT c.*, registrable_domain AS site, {SCORE} AS score FROM counted c JOIN validated_urls USING (page_id))"""

URL_PARTS = f"""
SELECT page_id, {SCHEME} AS scheme, {HOST} AS host, CAST(coalesce(nullif(regexp_extract({AUTHORITY}, ':(\\d+)$', 1), ''), CASE WHEN {SCHEME} = 'http' THEN '80' ELSE '443' END) AS INTEGER) AS port, {PATH} AS path,
  len(list_filter(string_split({PATH}, '/'), lambda s: s <> '')) AS depth, {_domain(HOST)} AS domain,
  {SCHEME} || '://' || {HOST} || CASE WHEN regexp_extract({AUTHORITY}, ':(\\d+)$', 1) IN ('', CASE WHEN {SCHEME} = 'http' THEN '80' ELSE '443' END) THEN '' ELSE ':' || regexp_extract({AUTHORITY}, ':(\\d+)$', 1) END || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS canonical,
  CASE WHEN rtrim(split_part(url, '#', 1), '/') = '' THEN url ELSE rtrim(split_part(url, '#', 1), '/') END AS dedupe_key,
  {SCHEME} || '://' || lower({AUTHORITY}) || CASE WHEN rtrim({PATH}, '/') = '' THEN '/' ELSE rtrim({PATH}, '/') END AS href_key, {TYPE} AS page_type
FROM validated_urls
"""
PAGE_TYPE_MIX = f"""
SELECT registrable_domain, {TYPE} AS page_type, count(*) AS pages,
  count(*) FILTER (WHERE {SCHEME} IN ('http', 'https') AND ({HOST} = registrable_domain OR ends_with({HOST}, '.' || registrable_domain)) AND NOT regexp_matches({PATH}, {_q('(?i)' + fixed.SKIP_EXTENSIONS)}) AND NOT regexp_matches({PATH}, {_q('(?i)' + fixed.SKIP_PATHS)})) AS crawlable
FROM validated_urls GROUP BY 1, 2
"""
GENRE_PROFILE = f"WITH c AS (SELECT doc_id, {GENRES.replace('{t}', 'text')} FROM documents) SELECT *, {POSITIVE} AS genre_count FROM c"
GENRE_MATRIX = f"WITH c AS (SELECT source, {GENRES.replace('{t}', 'text')} FROM documents) SELECT source, " + ", ".join(f"count(*) FILTER (WHERE n_{g} >= {n}) AS {g}" for g, (_, n) in fixed.GENRES.items()) + ", count(*) AS documents FROM c GROUP BY source"
WORD_BINS = f"""
WITH w AS (SELECT {_words('text')} AS words FROM documents), b AS (SELECT unnest([{', '.join(_q(f'{a}-{b}' if b < 10**9 else '>3000') for a, b, _ in fixed.WORD_BINS)}]) AS band)
SELECT band, count(words) AS n FROM b LEFT JOIN w ON {BAND} = band GROUP BY band
"""
_LOW, _HIGH = fixed.QUARTILES["word_count"]
READINESS_PAGES = f"WITH {SCORED} SELECT page_id, words, headings, round(score, 3) AS score, {RATING} AS rating, {BAND} AS band, CASE WHEN words <= {_LOW} THEN 'bottom_quartile' WHEN words >= {_HIGH} THEN 'top_quartile' ELSE 'mid_range' END AS quartile FROM scored"
READINESS_ROLLUP = f"""
WITH {SCORED}
SELECT site, count(*) AS pages, round(min(score), 3) AS lowest, round(list_sort(list(score))[CAST(count(*) // 2 AS INTEGER) + 1], 3) AS median, round(max(score), 3) AS highest, count(*) FILTER (WHERE score < 0.45) AS weak_or_worse,
  {', '.join(f"count(*) FILTER (WHERE {RATING} = '{n}') AS {n}" for n in ('strong', 'adequate', 'weak', 'very_weak'))}, round(round(avg(score), 4), 3) AS mean
FROM scored GROUP BY site
"""
SITE_THRESHOLDS = f"""
WITH {SCORED}, s AS (SELECT site, count(*) AS pages, median(words) AS median_words, list_sort(list(words))[greatest(1, CAST(count(*) // 4 AS INTEGER))] AS p25_words, min(words) AS min_words, max(words) AS max_words, median(headings) AS median_headings FROM scored GROUP BY site)
SELECT *, CAST(round_even(greatest(170, least(median_words * 0.5, 600)), 0) AS INTEGER) AS thin_words, CASE WHEN median_headings >= 4 THEN 2 ELSE 1 END AS min_headings FROM s WHERE pages >= 3
"""
CLAIM_SENTENCES = f"""
WITH part AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1\n', 'g'), '\n+'), lambda s: trim(s))) AS s, generate_subscripts(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1\n', 'g'), '\n+'), 1) AS i FROM documents),
kind AS (SELECT doc_id, i, s, CASE WHEN regexp_matches(s, {_q('(?i)' + fixed.STATISTIC)}) THEN 'statistic' WHEN regexp_matches(s, {_q('(?i)' + fixed.SUPERLATIVE)}) THEN 'superlative' END AS kind FROM part WHERE length(s) BETWEEN 25 AND 400),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS no FROM kind WHERE kind IS NOT NULL)
SELECT doc_id, CAST(no AS INTEGER) AS no, kind, s AS sentence FROM n WHERE no < 12
"""
HTML_STRUCTURE = f"""
SELECT page_id, {_words('text')} AS total_word_count, coalesce(len(headings), 0) AS heading_count, coalesce(len(paragraphs), 0) AS paragraph_count, coalesce(len(list_items), 0) AS list_item_count, cardinality(meta) AS meta_keys, coalesce(lang, '') AS lang FROM html_docs
"""
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(lower({{h}}), '^www\\.', ''), {_q(p)}) THEN '{n}'" for n, p in hosts.family_patterns()) + " ELSE 'other' END"
_KNOWN = [s for _, suffixes in fixed.HOST_FAMILIES for s in suffixes]
HOST_FAMILIES = f"""
WITH m AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'www.' || k WHEN 1 THEN regexp_extract(host, '^([^.]+)', 1) || k ELSE host END AS made_host FROM (SELECT page_id, host, [{', '.join(map(_q, _KNOWN))}][CAST(page_id % {len(_KNOWN)} AS INTEGER) + 1] AS k FROM validated_urls))
SELECT page_id, made_host, {_FAMILY.replace('{h}', 'made_host')} AS family FROM m
"""
LINK_PROFILE = """
WITH l AS (SELECT page_id, unnest(links) AS l FROM html_docs)
SELECT registrable_domain, count(*) AS links, count(*) FILTER (WHERE l.internal) AS internal, count(*) FILTER (WHERE l.nofollow) AS nofollow, count(DISTINCT l.href) AS targets, count(*) FILTER (WHERE {_FAMILY} <> 'other') AS known_hosts FROM l JOIN validated_urls USING (page_id) GROUP BY 1
""".replace("{_FAMILY}", _FAMILY.replace("{h}", "regexp_extract(l.href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"))
_HREF = f"{SCHEME} || '://' || lower({AUTHORITY}) || CASE WHEN rtrim({PATH}, '/') = '' THEN '/' ELSE rtrim({PATH}, '/') END"
CHROME_LINKS = f"""
WITH l AS (SELECT page_id, unnest(list_transform(links, lambda x: x.href)) AS url FROM html_docs),
e AS (SELECT DISTINCT registrable_domain AS site, l.page_id, {_HREF.replace('url', 'l.url')} AS href FROM l JOIN validated_urls v ON v.page_id = l.page_id),
n AS (SELECT site, count(DISTINCT page_id) AS pages FROM e GROUP BY site)
SELECT site, href, count(*) AS n_pages FROM e JOIN n USING (site) GROUP BY site, href, pages HAVING count(*) >= greatest(2, ceil(pages * 0.8))
"""
ROBOTS_VERDICTS = f"""
WITH rule(agents, rule, allow) AS (VALUES ('named', '/docs/%', 0), ('named', '/docs/%/public%', 1), ('rest', '/news/%-1', 0), ('rest', '/products/%', 0), ('rest', '/products/%and%%', 1)),
len(rule, size) AS (VALUES ('/docs/%', 6), ('/docs/%/public%', 14), ('/news/%-1', 10), ('/products/%', 10), ('/products/%and%%', 15)),
asked AS (SELECT DISTINCT registrable_domain AS site, agent, {PATH} AS path, CASE WHEN agent IN ('GPTBot', 'ClaudeBot') THEN 'named' ELSE 'rest' END AS agents FROM validated_urls CROSS JOIN (SELECT unnest([{', '.join(map(_q, AGENTS))}]) AS agent) WHERE registrable_domain IS NOT NULL),
hit AS (SELECT site, agent, path, max(size * 2 + allow) FILTER (WHERE path LIKE rule.rule) AS best FROM asked JOIN rule USING (agents) JOIN len ON len.rule = rule.rule GROUP BY 1, 2, 3)
SELECT site, agent, path, coalesce(best % 2 = 1, true) AS allowed FROM hit
"""
SITEMAP_LASTMOD_STATS = f"""
WITH p AS (SELECT registrable_domain AS site, trim(coalesce(lastmod, ''), ' ') AS t FROM sitemap_entries),
z AS (SELECT site, t, regexp_replace(replace(t, 'Z', '+0000'), '([+-]\\d\\d):(\\d\\d)$', '\\1\\2') AS z FROM p),
a AS (SELECT site, t, CASE WHEN regexp_matches(z, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN epoch(try_strptime(z, '%Y-%m-%d')) WHEN regexp_matches(z, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d[+-]\\d{{4}}$') THEN epoch(try_strptime(z[:19], '%Y-%m-%dT%H:%M:%S')) - CAST(z[20] || '1' AS INTEGER) * (CAST(z[21:22] AS INTEGER) * 3600 + CAST(z[23:24] AS INTEGER) * 60)
  WHEN regexp_matches(z, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d[+-]\\d{{4}}$') THEN epoch(try_strptime(z[:16], '%Y-%m-%dT%H:%M')) - CAST(z[17] || '1' AS INTEGER) * (CAST(z[18:19] AS INTEGER) * 3600 + CAST(z[20:21] AS INTEGER) * 60)
  WHEN regexp_matches(z, '^\\d{{4}}-\\d\\d$') THEN epoch(try_strptime(z, '%Y-%m')) WHEN regexp_matches(z, '^\\d{{4}}$') THEN epoch(try_strptime(z, '%Y')) END AS moment FROM z),
g AS (SELECT site, t, moment, CASE WHEN moment IS NOT NULL THEN greatest(0, CAST(floor((epoch(TIMESTAMP '{NOW}') - moment) / 86400) AS BIGINT)) END AS age FROM a)
SELECT site, count(*) AS entries, count(age) AS dated, count(*) FILTER (WHERE t <> '' AND moment IS NULL) AS invalid, count(*) FILTER (WHERE moment > epoch(TIMESTAMP '{NOW}')) AS future, count(*) FILTER (WHERE age > 365) AS stale,
  list_sort(list(age) FILTER (WHERE age IS NOT NULL))[CAST(count(age) // 2 AS INTEGER) + 1] AS median_age, min(age) AS newest_age, max(age) AS oldest_age
FROM g GROUP BY site
"""
SITEMAP_ORPHANS = "SELECT page_id, url FROM validated_urls WHERE rtrim(url, '/') NOT IN (SELECT rtrim(loc, '/') FROM sitemap_entries WHERE loc IS NOT NULL)"
SAMPLE_ROUND_ROBIN = f"""
WITH c AS (SELECT page_id, registrable_domain AS site, {TYPE} AS kind FROM validated_urls),
t AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site, kind ORDER BY page_id) AS turn FROM c),
p AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY kind <> 'homepage', turn, kind = 'other', kind, page_id) AS pick FROM t WHERE n <= 8 OR kind <> 'homepage' OR turn = 1)
SELECT site, page_id, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 8
"""
BYTE_BUDGET = """
WITH f AS (SELECT registrable_domain AS site, page_id, coalesce(sum(raw_bytes) OVER (PARTITION BY registrable_domain ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM fetch_results JOIN validated_urls USING (page_id) WHERE raw_bytes IS NOT NULL)
SELECT site, page_id, CAST(used_before AS BIGINT) AS used_before FROM f WHERE used_before < 40000
"""
LIVENESS_STRIDE = """
WITH r AS (SELECT entry_id, registrable_domain, row_number() OVER (PARTITION BY registrable_domain ORDER BY entry_id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY registrable_domain) // 5) AS step FROM sitemap_entries)
SELECT entry_id, registrable_domain FROM r WHERE r % step = 0 AND r // step < 5
"""
DISCOVERY_UNION = """
WITH a AS (SELECT loc AS url, 0 AS source_rank, entry_id AS ordinal FROM sitemap_entries WHERE loc IS NOT NULL UNION ALL SELECT url, 1, page_id FROM validated_urls),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN rtrim(split_part(url, '#', 1), '/') = '' THEN url ELSE rtrim(split_part(url, '#', 1), '/') END ORDER BY source_rank, ordinal, url) AS r FROM a)
SELECT CAST(source_rank AS INTEGER) AS source_rank, ordinal, url FROM r WHERE r = 1
"""
RESPONSE_PROFILE = """
SELECT registrable_domain, count(*) AS fetches, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS ok, count(*) FILTER (WHERE status >= 400) AS errors, count(*) FILTER (WHERE status IS NULL) AS failed, count(*) FILTER (WHERE len(redirect_chain) > 0) AS redirected,
  count(*) FILTER (WHERE headers['cache-control'] = 'no-store') AS no_store, CAST(sum(raw_bytes) AS BIGINT) AS bytes
FROM fetch_results JOIN validated_urls USING (page_id) GROUP BY 1
"""
EVENTS_BY_WINDOW = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"


TEXT_DATES = """
WITH t AS (SELECT o_orderkey, [strftime(o_orderdate, '%B %-d, %Y'), strftime(o_orderdate, '%-d %b %Y'), strftime(o_orderdate, '%Y-%m-%d')] AS found FROM orders)
SELECT o_orderkey, CAST(k - 1 AS INTEGER) AS no, found[k] AS date FROM (SELECT o_orderkey, found, unnest([1, 2, 3]) AS k FROM t)
"""
PAGE_DATES = f"""
WITH e AS (SELECT page_id, 'p' AS k, unnest(list_concat([{', '.join(f"meta['{m}']" for m in fixed.PUBLISHED_META)}], coalesce(time_elements, []))) AS raw FROM html_docs
  UNION ALL SELECT page_id, 'm', unnest([{', '.join(f"meta['{m}']" for m in fixed.MODIFIED_META)}]) FROM html_docs),
raw AS (SELECT page_id, json_ld[i] AS t FROM (SELECT page_id, json_ld, unnest(range(1, len(json_ld) + 1)) AS i FROM html_docs)),
val AS (SELECT page_id, t::JSON AS v FROM raw WHERE json_valid(t) AND NOT regexp_matches(t, ',\\s*[}}\\]]')),
obj AS (SELECT page_id, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END) AS v FROM val),
node AS (SELECT page_id, unnest(CASE WHEN json_type(v, '$."@graph"') = 'ARRAY' THEN list_concat(json_extract(v, '$."@graph"[*]'), [v]) ELSE [v] END) AS v FROM obj),
a AS (SELECT page_id, k, raw FROM e UNION ALL SELECT page_id, 'p', unnest([{', '.join(f"v ->> '$.{k}'" for k in fixed.PUBLISHED_LD)}]) FROM node UNION ALL SELECT page_id, 'm', unnest([{', '.join(f"v ->> '$.{k}'" for k in fixed.MODIFIED_LD)}]) FROM node),
d AS (SELECT page_id, k, CASE WHEN regexp_matches(trim(raw), '^\\d{{4}}-\\d\\d-\\d\\d') THEN CAST(try_cast(CASE WHEN regexp_matches(trim(raw), '(Z|[+-]\\d\\d:?\\d\\d)$') AND length(trim(raw)) > 10 THEN trim(raw) ELSE trim(raw) || CASE WHEN length(trim(raw)) = 10 THEN ' 00:00:00+00' ELSE '+00' END END AS TIMESTAMPTZ) AS TIMESTAMPTZ) END AS moment FROM a),
g AS (SELECT page_id, min(moment) FILTER (WHERE k = 'p') AS published, max(moment) FILTER (WHERE k = 'm') AS modified FROM d GROUP BY page_id)
SELECT h.page_id, epoch(published)::BIGINT AS published, epoch(modified)::BIGINT AS modified, epoch(greatest(published, modified))::BIGINT AS latest, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(greatest(published, modified))) / 86400) AS BIGINT) AS age_days FROM html_docs h LEFT JOIN g USING (page_id)
"""

_NAMED = lambda patterns: "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(body, {_q('(?i)' + p)}) THEN {_q(n)} END" for n, p in patterns.items()) + ")"
_HAS = lambda p: f"regexp_matches(body, {_q('(?i)' + p)})"
_MOUNT = f"({_HAS(fixed.EMPTY_MOUNT)} OR {_HAS(fixed.CLOSED_MOUNT)})"
_ROUTES = f"({_HAS(fixed.HASH_ROUTE)} AND {_HAS(fixed.CLIENT_ROUTER)})"
_HEAD = "CASE WHEN contains(lower(body), '</head>') THEN body[:instr(lower(body), '</head>') - 1] ELSE body[:8000] END"
RAW_SIGNALS = f"""
SELECT page_id, {_NAMED(fixed.FRAMEWORKS)} AS frameworks, {_NAMED(fixed.STATE_BLOBS)} AS state_blobs, {_MOUNT} AS empty_mount, {_count('body', fixed.SKELETON)} AS skeletons, {_count('body', fixed.LAZY)} AS lazy_markers, {_ROUTES} AS client_routing,
  len(regexp_extract_all(body, '(?i)<img\\b[^>]*>')) AS images, len(list_filter(regexp_extract_all({_HEAD}, '(?i)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)rel\\s*=\\s*["'']?stylesheet'))) AS stylesheets
FROM fetch_results WHERE body IS NOT NULL
"""
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(p, '\\\\u[dD][89abAB][0-9a-fA-F]{2}\\\\u[dD][c-fC-F][0-9a-fA-F]{2}', 'x', 'g'), '\\\\u0020', ' ', 'g'), '\\\\(?:u[0-9a-fA-F]{4}|.)', 'x', 'g')"
_TRAPPED = f"""coalesce(list_sum(list_transform(list_filter(regexp_extract_all(body[:400000], '(?s)<script[^>]*>\\s*(?:window\\.\\w+\\s*=\\s*)?(\\{{.*?\\}})\\s*;?\\s*</script>', 1), lambda p: length(p) >= 40),
  lambda p: CASE WHEN json_valid(p) AND NOT regexp_matches(p, ',\\s*[}}\\]]') THEN coalesce(list_sum(list_transform(list_filter(regexp_extract_all({_PLAIN}, '"[^"]*"(?:\\s*:)?'), lambda s: NOT ends_with(s, ':') AND length(s) >= 27 AND contains(s, ' ')), lambda s: length(s) - 2)), 0)
  ELSE coalesce(list_sum(list_transform(regexp_extract_all(p, '"([^"\\\\]{{25,}})"', 1), lambda s: length(s))), 0) END)), 0)"""
RENDER_FAULTS = f"""
WITH f AS (SELECT page_id, length(body) AS html_chars, {_TRAPPED} AS trapped, {_MOUNT} AS mount, {_count('body', fixed.SKELETON)} AS skeletons, {_count('body', fixed.LAZY)} AS lazy, {_ROUTES} AS routes, {' OR '.join(_HAS(p) for p in fixed.FRAMEWORKS.values())} AS framed FROM fetch_results WHERE body IS NOT NULL),
h AS (SELECT page_id, {_words('text')} AS words, length(coalesce(text, '')) AS chars, text IS NULL AS no_text, inline_script_chars AS script, noscript_chars AS noscript, coalesce(title, '') <> '' OR coalesce(meta['description'], '') <> '' AS named, coalesce(len(paragraphs), 0) AS paragraphs, images, images_missing_alt AS unlabelled FROM html_docs),
s AS (SELECT *, CASE WHEN trapped >= 500 AND words < 120 THEN ['state_blob', 'high'] WHEN mount AND words < 60 THEN ['empty_shell', CASE WHEN trapped < 500 THEN 'critical' ELSE 'high' END] WHEN words < 120 AND NOT no_text AND script > 4 * greatest(1, chars) THEN ['script_heavy_shell', 'high'] WHEN words < 120 AND NOT no_text AND chars / greatest(1, html_chars) < 0.05 THEN ['thin_served_html', 'high'] END AS shell FROM f JOIN h USING (page_id)),
a AS (SELECT page_id, unnest(list_filter([shell, CASE WHEN shell IS NULL AND words < 100 AND named AND paragraphs = 0 THEN ['meta_only', 'medium'] END, CASE WHEN skeletons >= 3 AND words < 200 THEN ['lazy_content', 'medium'] END, CASE WHEN lazy >= 10 AND images > 0 AND unlabelled / greatest(1, images) > 0.5 THEN ['lazy_media_unlabelled', 'low'] END,
  CASE WHEN framed AND noscript = 0 AND words < 150 THEN ['noscript_gap', 'medium'] END, CASE WHEN routes THEN ['client_routing', 'high'] END], lambda x: x IS NOT NULL)) AS x FROM s)
SELECT page_id, x[1] AS code, x[2] AS severity FROM a
"""
RENDER_SUMMARY = f"""
WITH r AS ({RENDER_FAULTS}), p AS (SELECT page_id, registrable_domain AS site, count(r.code) AS n, coalesce(bool_or(severity IN ('critical', 'high')), false) AS blocking FROM fetch_results f JOIN validated_urls v USING (page_id) LEFT JOIN r USING (page_id) WHERE body IS NOT NULL GROUP BY 1, 2),
c AS (SELECT site, '{{' || array_to_string(list(DISTINCT '"' || code || '":' || n ORDER BY '"' || code || '":' || n), ',') || '}}' AS by_code FROM (SELECT registrable_domain AS site, code, count(*) AS n FROM r JOIN validated_urls USING (page_id) GROUP BY 1, 2) GROUP BY site)
SELECT p.site, count(*) AS pages, count(*) FILTER (WHERE n > 0) AS faulted, count(*) FILTER (WHERE blocking) AS blocking, round(count(*) FILTER (WHERE n > 0) / count(*), 3) AS fault_rate, coalesce(any_value(by_code), '{{}}') AS by_code FROM p LEFT JOIN c USING (site) GROUP BY p.site
"""
SITEMAP_PROBLEMS = f"""
WITH e AS (SELECT registrable_domain AS site, loc AS url, lastmod FROM sitemap_entries WHERE loc IS NOT NULL),
f AS (SELECT site, url, lastmod, {HOST} = '' OR NOT ({HOST} = site OR ends_with({HOST}, '.' || site)) AS outside, {SCHEME} AS scheme FROM e),
s AS (SELECT * FROM ({SITEMAP_LASTMOD_STATS.replace('FROM sitemap_entries)', 'FROM sitemap_entries WHERE loc IS NOT NULL)')})),
c AS (SELECT site, count(*) - count(DISTINCT url) AS sitemap_duplicates, count(*) FILTER (WHERE outside) AS sitemap_off_scope, count(*) FILTER (WHERE NOT outside AND scheme <> 'https') AS sitemap_scheme_mismatch, count(*) FILTER (WHERE contains(url, '#')) AS sitemap_fragments, count(DISTINCT lastmod) AS v, count(lastmod) AS l FROM f GROUP BY site),
u AS (SELECT site, unnest(['sitemap_duplicates', 'sitemap_off_scope', 'sitemap_scheme_mismatch', 'sitemap_fragments', 'sitemap_bad_lastmod', 'sitemap_future_lastmod', 'sitemap_stale', 'sitemap_uniform_lastmod', 'sitemap_no_lastmod']) AS code,
  unnest([sitemap_duplicates, sitemap_off_scope, sitemap_scheme_mismatch, sitemap_fragments, invalid, future, CASE WHEN median_age > 365 AND dated >= 5 THEN median_age END, CASE WHEN v = 1 AND l >= 10 AND dated >= 10 THEN l END, CASE WHEN dated = 0 THEN entries END]) AS n FROM c JOIN s USING (site))
SELECT site, code, n FROM u WHERE n > 0
"""
TREE = """
raw AS (SELECT page_id, CAST(i - 1 AS VARCHAR) AS i, json_ld[i] AS t FROM (SELECT page_id, json_ld, unnest(range(1, len(json_ld) + 1)) AS i FROM html_docs)),
tree(page_id, path, parent, v) AS (
  SELECT page_id, i, '', t::JSON FROM raw WHERE json_valid(t) AND NOT regexp_matches(t, ',\\s*[}\\]]')
  UNION ALL
  SELECT page_id, path || '/' || k, CASE WHEN json_type(v) = 'OBJECT' THEN path ELSE parent END, CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$."' || k || '"') ELSE json_extract(v, '$[' || k || ']') END
  FROM (SELECT page_id, path, parent, v, unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) WHEN json_type(v) = 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda x: CAST(x AS VARCHAR)) ELSE [] END) AS k FROM tree))"""
P6_FOUND = f"WITH RECURSIVE {TREE} SELECT DISTINCT page_id, path AS node_path, parent AS parent_path FROM tree WHERE json_type(v) = 'OBJECT'"
JSONLD_TYPES = f"""
WITH RECURSIVE {TREE} SELECT regexp_extract(v ->> '$', '([^/#:]*)$', 1) AS type, count(*) AS nodes, count(DISTINCT page_id) AS pages FROM tree WHERE json_type(v) = 'VARCHAR' AND regexp_matches(path, '/@?type(?:/\\d+)?$') GROUP BY 1
"""
HTML_HEADINGS = """
SELECT page_id, len(list_filter(range(2, len(headings) + 1), lambda i: headings[i].level > headings[i - 1].level + 1)) AS heading_skips, array_to_string(list_transform(headings, lambda h: h.level || ' ' || h.text), chr(10)) AS headings FROM html_docs
"""


def oracle_sql() -> dict[str, str]:
    return {
        "url_parts": URL_PARTS, "page_type_mix": PAGE_TYPE_MIX, "genre_profile": GENRE_PROFILE, "genre_matrix": GENRE_MATRIX, "word_bins": WORD_BINS, "readiness_pages": READINESS_PAGES, "readiness_rollup": READINESS_ROLLUP, "site_thresholds": SITE_THRESHOLDS,
        "claim_sentences": CLAIM_SENTENCES, "html_structure": HTML_STRUCTURE, "link_profile": LINK_PROFILE, "chrome_links": CHROME_LINKS, "host_families": HOST_FAMILIES, "robots_verdicts": ROBOTS_VERDICTS, "sitemap_lastmod_stats": SITEMAP_LASTMOD_STATS,
        "sitemap_orphans": SITEMAP_ORPHANS, "sample_round_robin": SAMPLE_ROUND_ROBIN, "byte_budget": BYTE_BUDGET, "liveness_stride": LIVENESS_STRIDE, "discovery_union": DISCOVERY_UNION, "response_profile": RESPONSE_PROFILE, "events_by_window": EVENTS_BY_WINDOW, "text_dates": TEXT_DATES, "page_dates": PAGE_DATES,
        "raw_signals": RAW_SIGNALS, "render_faults": RENDER_FAULTS, "render_summary": RENDER_SUMMARY, "sitemap_problems": SITEMAP_PROBLEMS, "p6_found": P6_FOUND, "jsonld_types": JSONLD_TYPES, "html_headings": HTML_HEADINGS,
    }
