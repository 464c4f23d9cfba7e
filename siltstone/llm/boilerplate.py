"""The main body of web pages, told from their template by a weighted line-block distribution.

Markup is stripped and the text lies before us line by line. Each line weighs its length, the weights
are summed over sliding windows of lines, and the text between the surge and the dive of these sums is
kept: from the first window that reaches a threshold, or the page's own title before it, to the last. A
page without a long line of its own has nothing that its windows could be held against; there the threshold is
any weight at all. Lengths alone can't tell long template lines from content, so the corpus is asked as
well: a line that the site's pages share weighs nothing, and neither does anything from the first shared
line on after which the site's pages hold no long line any more (where footers and side columns begin).
Lines of no weight between surge and dive (bylines, share prompts, disclaimers) are the template's, too.
On sites of too few pages to share lines, lengths decide alone: there the short lines at the edges of
the blocks go as well, as menus and footers have them.

What a site shares is counted over all its pages: a line's key is its letters, without regard to case
and with the site's own name replaced by a mark. Equal pages of a site count once. The counts are
sums by (site, key) and by key with map-side aggregation, so neither a site with a third of all pages
nor a line on all pages lies in one task; no rate is taken from a sample. Texts are shuffled once, to
meet their site, and written in buckets of page_id; after that only hashes and lengths of lines move,
and what is known of a page's lines comes back to it by page_id.

Defined results: null and empty texts have no lines; a page without a known site has no template lines
except breadcrumbs and those outside surge and dive; a row without a page_id counts as a page of no
known site; repeated rows are repeated; very long lines and texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import bucketed, discard, small, written

OWN = "§"
#: pages marked at a time
ROWS = 1_000
CRUMB = r" [›»>|→] "


@dataclass(frozen=True)
class Shares:
    """When a shared line is the template's. Shares are of a site's pages; pooled ones are over all
    sites that have the line."""

    long_line: int = 150  #: characters of a line that only an author's paragraph has
    long_key: int = 20  #: letters from which a line is no menu entry, table cell or list item
    window: int = 3  #: lines in a block
    surge: int = 100  #: characters of a block from which it is the body's, on pages with a long line
    menu_share: float = 0.3
    line_share: float = 0.08
    pooled_line_share: float = 0.05
    least_pages: int = 3
    least_sites: int = 3
    #: at most so much of a line's pages may have it as their title, or again and again, or be without a long line
    title_share: float = 0.04
    again: float = 1.3
    #: a line that ends bodies has a long line after it on less than this share of its pages
    after_share: float = 0.1


def strip_markup(body: Column) -> Column:
    """Visible text of markup, one block a line; for sources that have no text column yet."""
    hidden = F.regexp_replace(body, r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|title)\b.*?</\1\s*>", " ")
    blocks = F.regexp_replace(
        F.regexp_replace(hidden, r"\s+", " "),
        r"(?i)</?(?:div|p|li|h[1-6]|[uo]l|section|article|main|header|footer|nav|aside|table|t[rdh]|pre|blockquote|d[tdl]|figure|figcaption|br|form|body|html|head)\b[^>]*>",
        "\n",
    )
    plain = F.regexp_replace(blocks, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " +", " "), r" ?\n[ \n]*", "\n"), F.lit("\n "))


def line_key(line: Column, name: Column) -> Column:
    """Letters of the line in lower case; the site's name is the mark OWN."""
    return F.regexp_replace(F.replace(F.lower(line), name, F.lit(OWN)), r"[^\p{L}§]+", "")


def from_bodies(fetches: DataFrame) -> DataFrame:
    """(page_id, title, text) of served markup, for `pages` where no text has been taken from it yet."""
    title = F.regexp_replace(F.regexp_extract("body", r"(?is)<title\b[^>]*>(.*?)</title", 1), r"\s+", " ")
    return fetches.where("body is not null").select("page_id", F.trim(title).alias("title"), strip_markup(F.col("body")).alias("text"))


def pages(documents: DataFrame, sources: DataFrame, carry: tuple[str, ...] = (), use: Callable[[Column], Column] | None = None) -> DataFrame:
    """(page_id, site, domain, row, copy, lines, feats, carried columns), written in buckets of page_id. `row`
    tells rows of one page_id apart, `copy` is the same for equal texts. `feats` has of each line its trimmed length, the hash and length of its key,
    whether that has the site's name, whether it is the page's title or a breadcrumb that leads there,
    whether it is long, and `use`, any further property of the line."""
    named = sources.groupBy("page_id").agg(F.min("registrable_domain").alias("_site"))
    name = F.coalesce(F.element_at(F.split("_site", r"\."), 1), F.lit("?"))
    name = F.when(F.length(name) > 2, name).otherwise(F.lit("?"))
    p = Shares()
    joined = documents.select("page_id", "title", "text", *carry).join(named, "page_id", "left")
    lines = F.when(F.length("text") > 0, F.split("text", "\n"))
    keyed = joined.select(
        "page_id", F.xxhash64("_site").alias("_hash"), "_site", F.xxhash64("text", "title").alias("row"), F.xxhash64("text").alias("copy"),
        lines.alias("lines"), F.transform(lines, lambda x: line_key(x, name)).alias("_keys"),
        line_key(F.coalesce("title", F.lit("")), name).alias("_title_key"), *carry,
    )

    def feat(line: Column, i: Column) -> Column:
        key = F.get("_keys", i)
        last = F.trim(F.element_at(F.split(line, CRUMB), -1))
        crumb = line.rlike(CRUMB) & (((F.col("_title_key") != "") & F.endswith(key, F.col("_title_key"))) | F.array_contains(F.slice("lines", i + 2, 8), last))
        return F.struct(
            F.length(F.trim(line)).alias("size"), F.xxhash64(key).alias("key"), F.length(key).alias("letters"), F.contains(key, F.lit(OWN)).alias("own"), ((F.col("_title_key") != "") & (key == F.col("_title_key"))).alias("title"),
            crumb.alias("crumb"), (F.length(line) > p.long_line).alias("long"), (use(line) if use else F.lit(True)).alias("use"),
        )

    feats = F.transform("lines", feat)
    return bucketed(
        keyed.select("page_id", F.when(F.col("_site").isNotNull() & F.col("page_id").isNotNull(), F.col("_hash")).alias("site"), F.col("_site").alias("domain"), "row", "copy", "lines", feats.alias("feats"), *carry),
        "page_id",
    )


def _counts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (site, key): pages, lines, and on how many pages the line comes first, has a long line after
    it, is the title, stands on a page with a long line. Per site: its pages."""
    # equal pages of a site count once
    once = written(table.where("site is not null and lines is not null").groupBy("site", "copy").agg(F.first("feats").alias("feats")))
    keys = F.transform("feats", lambda x, i: F.struct(x["key"].alias("key"), x["letters"].alias("size"), x["own"].alias("own"), i.alias("i"), x["title"].alias("title")))
    last = F.aggregate(F.transform("feats", lambda x, i: F.when(x["long"], i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    line = once.select("site", "copy", last.alias("last"), F.explode(F.filter(keys, lambda x: x["size"] > 0)).alias("k")).select("site", "copy", "last", "k.*")
    paged = line.groupBy("site", "key", "copy").agg(
        F.max("size").alias("size"), F.max("own").alias("own"), F.count(F.lit(1)).alias("lines"), F.min("i").alias("i"), F.max("i").alias("j"),
        F.max("title").alias("title"), F.max("last").alias("last"),
    )
    each = paged.groupBy("site", "key").agg(
        F.max("size").alias("size"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.count_if(F.col("i") == 0).alias("first"),
        F.count_if(F.col("last") > F.col("j")).alias("after"), F.count_if("title").alias("title"), F.count_if(F.col("last") >= 0).alias("with_long"),
    )
    each, whole = written(each), written(once.groupBy("site").agg(F.count(F.lit(1)).alias("pages")))
    discard(once)
    return each, whole


def _kinds(table: DataFrame, p: Shares) -> DataFrame:
    """(site, key, kind) of the template's lines, as a written table: kind 2 if the line ends bodies, else 1.
    Kind 3, with the key 0, stands for a site of enough pages to share lines."""
    each, whole = _counts(table)
    pooled = each.groupBy("key").agg(F.count(F.lit(1)).alias("g_sites"), *(F.sum(c).alias(f"g_{c}") for c in ("n", "first", "after", "title", "with_long"))).where(F.col("g_n") > 1)
    # keys of one page, by far the most, go before the pages of the sites are asked for
    both = each.join(pooled, "key").join(small(whole), "site")
    both = both.join(both.groupBy("key").agg(F.sum("pages").alias("g_pages")), "key")
    c = F.col
    share, g_share = c("n") / c("pages"), c("g_n") / c("g_pages")
    many, spread = c("n") >= p.least_pages, c("g_sites") >= p.least_sites
    long = c("size") >= p.long_key
    named = c("own") & ((c("size") == 1) | (c("g_n") >= p.least_pages))
    line = long & (c("g_with_long") >= 0.5 * c("g_n")) & ((many & (share >= p.line_share) & (g_share >= p.pooled_line_share)) | (spread & (g_share >= p.line_share)))
    menu = ~long & ((many & (share >= p.menu_share) & (~spread | (g_share >= p.menu_share * 2 / 3))) | (spread & (g_share >= p.menu_share)) | ((c("g_first") >= 0.9 * c("g_n")) & (c("g_n") > 1)))
    once = (c("lines") <= p.again * c("n")) & (c("g_title") < p.title_share * c("g_n"))
    template = once & (named | (~c("own") & (line | menu)))
    pool_ends = (c("g_after") < p.after_share * c("g_n")) & (g_share >= 0.2)
    site_ends = (c("n") >= 8) & (c("after") < 0.8 * p.after_share * c("n")) & (share >= 0.5)
    ends = F.when(spread & (c("g_n") >= 20), pool_ends).otherwise(site_ends) & ~(c("own") & ~spread & (share < 0.5))
    found = both.where(template).select("site", "key", F.when(ends, 2).otherwise(1).alias("kind"))
    known = whole.where(F.col("pages") >= p.least_pages).select("site", F.lit(0).cast("bigint").alias("key"), F.lit(3).alias("kind"))
    out = written(found.unionByName(known))
    discard(each, whole)
    return out


def _known(table: DataFrame, p: Shares) -> DataFrame:
    """(page_id, known): what the corpus knows of each page's lines, as (row, line number, kind)."""
    keys = F.transform(
        F.filter(F.transform("feats", lambda x, i: F.struct(i.alias("i"), x["key"].alias("key"), x["letters"].alias("letters"))), lambda x: x["letters"] > 0),
        lambda x: F.struct(x["i"].alias("i"), x["key"].alias("key")),
    )
    site = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("bigint").alias("key")))
    each = table.where("site is not null and lines is not null").select("page_id", "row", "site", F.inline(F.concat(site, keys)))
    # the other side has one row a (site, key), so that Spark can split a key that is on all pages of a site
    hits = each.join(_kinds(table, p), ["site", "key"])
    return hits.groupBy("page_id").agg(F.collect_set(F.struct("row", "i", "kind")).alias("known"))


def _sums(weights: np.ndarray, window: int) -> np.ndarray:
    """Of each line, the weight of the window of lines that begins with it."""
    total = np.r_[0, np.cumsum(weights)]
    n = len(weights)
    return total[np.minimum(np.arange(n) + window, n)] - total[:n]


def body_range(weights: np.ndarray, window: int, surge: int = 1, edge: float = 0) -> tuple[int, int]:
    """Surge and dive: the first line and the one after the last of the text between the first and the
    last window of so much weight; (0, 0) if there is none. Lines lighter than `edge` are cut at both ends."""
    heavy = np.flatnonzero(_sums(weights, window) >= surge)
    if not len(heavy):
        return 0, 0
    first, last = heavy[0], min(heavy[-1] + window, len(weights))
    inside = np.flatnonzero(weights[first:last] > max(edge - 1, 0)) + first
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (int(first), int(last))


def template_flags(lengths: np.ndarray, kinds: np.ndarray, titles: np.ndarray, crumbs: np.ndarray, p: Shares = Shares(), known: bool = True) -> np.ndarray:
    """Of each line, whether it is the template's. kinds: 0 not shared, 1 shared, 2 shared and ends the body;
    known says whether the site has enough pages for that."""
    weights = np.where(kinds > 0, 0, lengths)
    for i in np.flatnonzero(crumbs):
        # a breadcrumb leads, over separators, to the page's own title, below nothing but template lines
        if weights[i] and (i == 0 or not weights[i - 1] or not known):
            weights[i] = 0
    ends = np.flatnonzero(kinds == 2)
    if len(ends):
        weights[ends[0] :] = 0
    long = weights.max(initial=0) > p.long_line
    surge, dive = body_range(weights, p.window, p.surge if long else 1, p.surge / p.window if long and not known else 0)
    # short lines may part a page's title from its first block, or a heading if the title isn't there
    own = np.flatnonzero(weights[:surge])
    if titles.any():
        own = own[titles[own]]
        surge = int(own[0]) if len(own) else surge
    elif known and len(own):
        surge = int(own[-1])
    at = np.arange(len(weights))
    return ~((at >= surge) & (at < dive) & (weights > 0))


def marked(table: DataFrame, p: Shares = Shares()) -> DataFrame:
    """The rows of `pages`, with `template` in the place of hashes: of each line, whether it is the
    template's; null for a null or empty text."""
    rows = table.join(_known(table, p), "page_id", "left")
    kept = [c for c in table.columns if c not in ("site", "row", "copy")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, ROWS) for whole in it for at in range(0, len(whole), ROWS)):
            get = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            feats = get["feats"]
            flat = feats.flatten()
            size, title, crumb = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("size", "title", "crumb"))
            ends = np.cumsum(np.nan_to_num(feats.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            kinds, known = np.zeros(len(flat), np.int8), np.zeros(len(b), bool)
            hits = get["known"]
            owner, hit = pc.list_parent_indices(hits).to_numpy(), hits.flatten()
            i, kind = hit.field("i").to_numpy(), hit.field("kind").to_numpy()
            same = hit.field("row").to_numpy() == get["row"].to_numpy()[owner] if len(owner) else np.zeros(0, bool)
            known[owner[same & (kind == 3)]] = True
            lines = same & (kind < 3)
            kinds[starts[owner[lines]] + i[lines]] = kind[lines]
            flags = np.ones(len(flat), bool)
            for k, (a, z) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                if z > a:
                    flags[a:z] = template_flags(size[a:z], kinds[a:z], title[a:z], crumb[a:z], p, bool(known[k]))
            offsets = pa.array(np.r_[starts, ends[-1:] if len(ends) else 0].astype(np.int32))
            out = pa.ListArray.from_arrays(offsets, pa.array(flags), mask=feats.is_null())
            yield pa.RecordBatch.from_arrays([*(get[c] for c in kept), out], [*kept, "template"])

    return rows.mapInArrow(batches, T.StructType([table.schema[c] for c in kept]).add("template", T.ArrayType(T.BooleanType())))


def own_lines() -> Column:
    """The page's own lines, of the rows of `marked`; null for a null or empty text."""
    return F.filter("lines", lambda _, i: ~F.get("template", i))


def template_lines(documents: DataFrame, sources: DataFrame, p: Shares = Shares()) -> DataFrame:
    """(page_id, line_no) of the lines of text that the site's template supplies. An empty line is none."""
    # only lengths and hashes of lines meet what is known of them; the texts stay where they were written
    rows = marked(pages(documents, sources).drop("lines", "domain").withColumn("lines", F.transform("feats", lambda x: x["size"])), p)
    hit = F.filter(F.transform("template", lambda t, i: F.when(t & (F.get("lines", i) > 0), i).otherwise(-1)), lambda i: i >= 0)
    return rows.select("page_id", F.explode(hit).alias("line_no"))


def main_bodies(documents: DataFrame, sources: DataFrame, p: Shares = Shares()) -> DataFrame:
    """(page_id, body): the page's own lines, joined by line ends; null for a null or empty text."""
    return marked(pages(documents, sources), p).select("page_id", F.array_join(own_lines(), "\n").alias("body"))
