"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from siltstone.llm import phrases, quality


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in sorted(words)) + "]"


def _re(pattern: str) -> str:
    """A Java pattern as RE2 writes it, quoted."""
    return "'" + pattern.replace("{Is", "{").replace("'", "''") + "'"


_R = quality.Rules
_FORM = {
    "mean_word_length": f"NOT visible / words::DOUBLE BETWEEN {_R.mean_word[0]} AND {_R.mean_word[1]}", "symbols": f"symbols > {_R.symbols} * words", "bullets": f"bullets > {_R.bullets} * lines", "ellipses": f"ellipses > {_R.ellipses} * lines",
    "not_alphabetic": f"alphabetic < {_R.alphabetic} * words", "no_common_words": f"stops < {_R.stop_words}", "no_closing_marks": f"closed < {_R.closing} * lines", "short_lines": f"short > {_R.short_lines} * lines",
}
P1_FOUND = f"""
WITH line AS (SELECT page_id, unnest(string_split(coalesce(main_text, ''), '\n')) AS l FROM html_docs),
w AS (SELECT page_id, l, lower(l) AS low, list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> '') AS ws, regexp_extract_all(lower(l), '\\p{{L}}+') AS runs, regexp_replace(l, '[^\\p{{L}}]+', '', 'g') AS ls, regexp_matches(rtrim(l, ' '), {_re(quality.CLOSING)}) AS closed FROM line),
f AS (SELECT page_id, len(ws) AS words, length(ls) AS letters, length(regexp_replace(l, '\\s+', '', 'g')) AS visible, length(l) AS size, closed,
  len(list_filter(runs, lambda r: list_contains({_list(quality.NOMINAL_WORDS)}, r))) AS nominal, len(list_filter(runs, lambda r: list_contains({_list(quality.CLAUSAL_WORDS)}, r))) AS clausal,
  len(list_filter(ws, lambda x: regexp_matches(x, '^[^\\p{{L}}]*[\\p{{Ll}}\\p{{Lo}}]'))) AS lower_, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS alphabetic,
  closed AND regexp_matches(l, {_re(quality.OPENING)}) AND NOT regexp_matches(l, '[:;/|=\\d]') AS whole, length(regexp_replace(l, {_re(quality.UNSPACED)}, '', 'g')) AS unspaced,
  regexp_matches(low, {_re('(?i)' + phrases.UNFILLED)}) OR list_has_any(runs, {_list(phrases.FILLER_WORDS.split())}) AS filler, len(ws) <= {quality.MESSAGE_WORDS} AND regexp_matches(low, {_re(quality.MESSAGE)}) AS message,
  len(regexp_extract_all(l, '#|…|\\.\\.\\.')) AS symbols, regexp_matches(l, {_re(quality.BULLET)}) AS bullet, regexp_matches(rtrim(l, ' '), '(?:…|\\.\\.\\.)$') AS ellipsis
  FROM w WHERE len(ws) > 0),
k AS (SELECT *, CASE WHEN filler THEN 'filler' WHEN message THEN 'message'
  WHEN (letters >= 0.7 * visible AND visible <= 12 * words AND ((words >= 5 AND clausal >= 1 AND nominal + clausal >= 2 AND nominal + clausal >= 0.12 * words) OR (closed AND words >= 4 AND clausal >= 1)
    OR (whole AND ((words >= 4 AND nominal >= 1) OR (words >= 6 AND lower_ >= 0.5 * words AND visible BETWEEN 3 * words AND 9 * words))))) OR (unspaced >= 0.5 * letters AND (unspaced >= 16 OR (unspaced >= 6 AND closed))) THEN 'sentence' ELSE 'other' END AS kind FROM f),
s AS (SELECT page_id, count(*) AS lines, sum(words) AS words, sum(visible) AS visible, sum(nominal + clausal) AS stops, sum(alphabetic) AS alphabetic, sum(symbols) AS symbols, count(*) FILTER (WHERE closed) AS closed, count(*) FILTER (WHERE bullet) AS bullets, count(*) FILTER (WHERE ellipsis) AS ellipses,
  count(*) FILTER (WHERE size <= {_R.short_line}) AS short, coalesce(sum(words) FILTER (WHERE kind = 'other'), 0) AS other, coalesce(sum(visible) FILTER (WHERE kind = 'other'), 0) AS seen FROM k GROUP BY page_id)
SELECT page_id FROM s WHERE (other >= {_R.least_no_sentence} OR seen >= {_R.least_visible})
  AND (other > {_R.no_sentence} * words OR seen > {_R.no_sentence} * visible OR (other > {_R.doubtful} * words AND {' + '.join(f'CAST({x} AS INTEGER)' for x in _FORM.values())} >= {_R.published}))
"""

_RATES = {
    "mean_word_length": ("visible", "words"), "symbol_ratio": ("symbols", "words"), "letter_share": ("letters", "visible"), "alphabetic_share": ("alphabetic", "words"), "stop_share": ("stops", "words"), "closed_lines": ("closed", "lines"),
    "bullet_lines": ("bullets", "lines"), "ellipsis_lines": ("ellipses", "lines"), "short_lines": ("short", "lines"), "no_sentence_share": ("other", "words"), "no_sentence_visible_share": ("seen", "visible"),
}
_COUNTED = lambda c: f"coalesce(list_sum(list_transform({c}, lambda e: len(list_filter(regexp_split_to_array(coalesce(e, ''), '\\s+'), lambda w: w <> '')))), 0)"
_P1_SUMS = P1_FOUND[: P1_FOUND.index("SELECT page_id FROM s WHERE")].replace("sum(visible) AS visible,", "sum(visible) AS visible, sum(letters) AS letters,")
_HOLDS = {
    "too_few_words": f"coalesce(words, 0) < {_R.least_words}", "too_many_words": f"words > {_R.most_words}", **{n: f"words > 0 AND ({c})" for n, c in _FORM.items()},
    "no_sentences": P1_FOUND[P1_FOUND.index("(other >=") :],
}
P1_STATISTICS = f"""{_P1_SUMS},
l AS (SELECT page_id, coalesce(len(paragraphs), 0) AS n_paragraphs, coalesce(len(list_items), 0) AS n_list_items, {_COUNTED('paragraphs')} AS paragraph_words, {_COUNTED('list_items')} AS list_words FROM html_docs)
SELECT l.page_id, coalesce(lines, 0) AS lines, coalesce(words, 0) AS words, coalesce(visible, 0) AS visible, coalesce(stops, 0) AS stop_words, coalesce(other, 0) AS no_sentence_words, coalesce(seen, 0) AS no_sentence_visible,
  {', '.join(f"round(CASE WHEN coalesce({b}, 0) > 0 THEN {a} / {b}::DOUBLE ELSE 0.0 END, 4) AS {n}" for n, (a, b) in _RATES.items())},
  n_paragraphs, n_list_items, paragraph_words, list_words, round(CASE WHEN list_words + paragraph_words > 0 THEN list_words / (list_words + paragraph_words)::DOUBLE ELSE 0.0 END, 4) AS list_share,
  concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _HOLDS.items())}) AS failures
FROM l LEFT JOIN s USING (page_id)
"""

P7_FOUND = """
WITH entry AS (
  SELECT page_id, registrable_domain AS source, CAST(i - 1 AS INTEGER) AS para_no,
         regexp_replace(lower(paragraphs[i]), '[^\\p{L}]+', '', 'g') AS line
  FROM (SELECT page_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS i FROM html_docs)
  JOIN (SELECT DISTINCT page_id, registrable_domain FROM validated_urls) USING (page_id)),
hot AS (
  SELECT source, line FROM entry WHERE line <> '' AND source IS NOT NULL
  GROUP BY source, line HAVING count(DISTINCT page_id) >= 5)
SELECT DISTINCT page_id, para_no FROM entry JOIN hot USING (source, line)
"""

P7_CLEAN = f"""
WITH cut AS (SELECT page_id, list(para_no) AS nos FROM ({P7_FOUND}) GROUP BY page_id)
SELECT page_id, array_to_string(CASE WHEN nos IS NULL THEN paragraphs ELSE list_transform(list_filter(range(1, len(paragraphs) + 1), lambda i: NOT list_contains(nos, CAST(i - 1 AS INTEGER))), lambda i: paragraphs[i]) END, '\n') AS paragraphs, CAST(coalesce(len(nos), 0) AS INTEGER) AS n_cut FROM html_docs LEFT JOIN cut USING (page_id)
"""

P9_FOUND = """
WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM doc)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_statistics": P1_STATISTICS, "p7_clean": P7_CLEAN, "p7_found": P7_FOUND, "p9_found": P9_FOUND}
