"""Entities that pages declare in structured data: nodes, their types and properties, and what a site says
of itself.

A block of JSON-LD is parsed to a variant, natively; blocks that are no standard JSON give no nodes. Top-level
nodes are the objects of a block (or of its list) and the members of its @graph, whose wrapper counts only
if it has a type. Values are read by path, so blocks of any shape pass. Null and empty lists give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import fixed, hosts, urls
from siltstone.functions.urls import let
from siltstone.session import small

_LIST = "array<variant>"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def prop(node: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f'$["{name}"]', kind)


def strings(node: Column, name: str) -> Column:
    """A property's text, or its list of texts, as a list; empty if it is neither."""
    one = prop(node, name, "string")
    listed = F.filter(F.coalesce(prop(node, name, "array<string>"), F.array().cast("array<string>")), lambda s: s.isNotNull())
    return F.when(_is(prop(node, name), "ARRAY"), listed).when(one.isNull() | _is(prop(node, name), "OBJECT"), F.array().cast("array<string>")).otherwise(F.array(one))


def types_of(node: Column) -> Column:
    """Names of a node's types, each without what stands before its last slash or colon."""
    raw = let(strings(node, "@type"), lambda t: F.when(F.size(t) > 0, t).otherwise(strings(node, "type")))
    return F.transform(raw, lambda t: F.regexp_extract(t, r"([^/:]*)$", 1))


def has_any(node: Column, names: tuple[str, ...]) -> Column:
    """Whether one of the properties is there and not null, an empty text, an empty list or object."""
    out = F.lit(False)
    for n in names:
        v = prop(node, n)
        empty = F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "[]", "{}")
        out = out | (v.isNotNull() & ~empty)
    return out


def flat_text(v: Column, depth: int = 2) -> Column:
    """A text; of an object the parts of its address and its name; of a list all of these, joined by ', '.
    Lists and objects are followed to the depth given."""
    plain = F.trim(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"\s+", " "))
    text = F.when(_is(v, "STRING"), plain)
    if not depth:
        return F.coalesce(text, F.lit(""))
    joined = lambda parts: F.array_join(F.filter(parts, lambda p: p != ""), ", ")
    parts = joined(F.array(*(flat_text(prop(v, k), depth - 1) for k in fixed.ADDRESS_KEYS)))
    members = joined(F.transform(F.coalesce(F.try_variant_get(v, "$", _LIST), F.array().cast(_LIST)), lambda m: flat_text(m, depth - 1)))
    return F.coalesce(text, F.when(_is(v, "OBJECT"), parts).when(_is(v, "ARRAY"), members), F.lit(""))


def same_as(node: Column) -> Column:
    return F.filter(F.transform(strings(node, "sameAs"), lambda s: F.trim(s)), lambda s: s != "")


def top_level_nodes(html: DataFrame, key: str = "page_id", texts: str = "json_ld") -> DataFrame:
    """(key, block, no, node, types): the nodes that describe the page itself; no shuffle."""
    v = html.select(key, F.posexplode(texts).alias("block", "text")).select(key, "block", F.try_parse_json("text").alias("v")).where("v is not null")
    objects = F.when(_is(F.col("v"), "ARRAY"), F.try_variant_get("v", "$", _LIST)).otherwise(F.array("v"))
    v = v.select(key, "block", F.explode(objects).alias("v")).where(_is(F.col("v"), "OBJECT"))
    graph = prop(F.col("v"), "@graph", _LIST)
    wrapper = F.when(F.size(types_of(F.col("v"))) > 0, F.array("v")).otherwise(F.array().cast(_LIST))
    members = F.when(_is(prop(F.col("v"), "@graph"), "ARRAY"), F.concat(graph, wrapper)).otherwise(F.array("v"))
    nodes = v.select(key, "block", F.posexplode(members).alias("no", "node")).where(_is(F.col("node"), "OBJECT"))
    return nodes.withColumn("types", types_of(F.col("node")))


def organisations(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.arrays_overlap("types", F.array(*map(F.lit, fixed.ORGANIZATION_TYPES))))


def name_variants(nodes: DataFrame, site: str = "site") -> DataFrame:
    """(site, kind, value, pages): the forms in which a site's organisation nodes give its name, its
    telephone (both plain texts) and its address, with the pages of each."""
    v = F.col("node")
    name = let(flat_text(prop(v, "name"), 0), lambda n: F.when(n != "", n).otherwise(flat_text(prop(v, "legalName"), 0)))
    contact = let(prop(v, "contactPoint"), lambda c: F.when(_is(c, "ARRAY"), F.get(F.filter(F.try_variant_get(c, "$", _LIST), lambda m: _is(m, "OBJECT")), F.lit(0))).otherwise(c))
    phone = let(flat_text(prop(v, "telephone"), 0), lambda t: F.when(t != "", t).otherwise(flat_text(contact, 1)))
    forms = F.array(
        F.struct(F.lit("name").alias("kind"), hosts.name_form(name).alias("value"), (name != "").alias("given")),
        let(hosts.phone_form(phone), lambda p: F.struct(F.lit("phone").alias("kind"), p.alias("value"), (F.length(p) >= 7).alias("given"))),
        let(flat_text(prop(v, "address")), lambda a: F.struct(F.lit("address").alias("kind"), hosts.name_form(a).alias("value"), (a != "").alias("given"))),
    )
    # through one array, so that no form is computed again by the filter
    each = organisations(nodes).select(site, "page_id", F.inline(forms)).where("given")
    return each.groupBy(site, "kind", "value").agg(F.count_distinct("page_id").alias("pages"))


def best_organisation(nodes: DataFrame, site: str = "site") -> DataFrame:
    """(site, page_id, score, present, missing) of the organisation node with the most fields and links to
    itself elsewhere, the first of equals by page, block and number."""
    v = F.col("node")
    fields = {n: has_any(v, names) for n, names in fixed.ORGANIZATION_FIELDS.items()}
    listed = lambda there: F.array_compact(F.array(*(F.when(h if there else ~h, F.lit(n)) for n, h in fields.items())))
    each = organisations(nodes).select(site, "page_id", "block", "no", listed(True).alias("present"), listed(False).alias("missing"), F.size(same_as(v)).alias("links"))
    each = each.withColumn("score", F.size("present") + F.col("links"))
    best = each.groupBy(site).agg(F.max_by(F.struct("page_id", "score", "present", "missing"), F.struct("score", -F.col("page_id"), -F.col("block"), -F.col("no"))).alias("b"))
    return best.select(site, "b.*")


def identity_links(nodes: DataFrame, site: str = "site") -> DataFrame:
    """(site, links, hosts): distinct sameAs values of a site's organisations, and their hosts."""
    each = organisations(nodes).select(site, F.explode(same_as(F.col("node"))).alias("link")).distinct()
    host = F.regexp_replace(urls.host_of(F.col("link")), "^www\\.", "")
    return each.groupBy(site).agg(F.count(F.lit(1)).alias("links"), F.count_distinct(F.when(host != "", host)).alias("hosts"))


def missing_properties(nodes: DataFrame, keep: int = 3) -> DataFrame:
    """(type, missing, nodes): of each type, the commonest combinations of missing properties."""
    v = F.col("node")

    def absent(t: Column) -> Column:
        out = F.when(F.lit(False), F.array().cast("array<string>"))
        for name, rules in fixed.REQUIRED_PROPERTIES.items():
            out = out.when(t == name, F.array_compact(F.array(*(F.when(~has_any(v, names), F.lit(label)) for label, names in rules.items()))))
        return out

    each = nodes.where(F.arrays_overlap("types", F.array(*map(F.lit, fixed.REQUIRED_PROPERTIES)))).select("node", F.explode("types").alias("type"))
    each = each.select("type", F.array_join(absent(F.col("type")), ", ").alias("missing")).where("missing <> ''")
    counts = each.groupBy("type", "missing").agg(F.count(F.lit(1)).alias("nodes"))
    w = W.partitionBy("type").orderBy(F.desc("nodes"), "missing")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def expectations(spark) -> DataFrame:
    """One row a page type with what is expected of it."""
    rows = [(n, list(types), words, date, hub, critical, exempt) for n, (types, words, date, hub, critical, exempt) in fixed.PAGE_EXPECTATIONS.items()]
    return spark.createDataFrame(rows, "page_type string, schema_types array<string>, min_words int, expect_date boolean, is_hub boolean, critical boolean, exempt boolean")


def with_expectations(pages: DataFrame) -> DataFrame:
    """pages (with page_type) and the expectations of their type, of 'other' where the type isn't known."""
    e = expectations(pages.sparkSession)
    known = F.when(F.col("page_type").isin(*fixed.PAGE_EXPECTATIONS), F.col("page_type")).otherwise("other")
    return pages.withColumn("_type", known).join(small(e.withColumnRenamed("page_type", "_type")), "_type").drop("_type")


def page_types(nodes: DataFrame) -> DataFrame:
    """(page_id, types): the distinct types of a page's nodes; a page's nodes bound the list."""
    return nodes.groupBy("page_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))


def type_report(types: Column, expected: Column) -> Column:
    """(specific, matches, groups): types that say what the page is about, whether one of them is expected,
    and which primary groups they belong to."""
    groups = F.array_compact(F.array(*(F.when(F.arrays_overlap(types, F.array(*map(F.lit, members))), F.lit(g)) for g, members in fixed.PRIMARY_TYPES.items())))
    return F.struct(F.array_except(types, F.array(*map(F.lit, fixed.GENERIC_TYPES))).alias("specific"), F.arrays_overlap(types, expected).alias("matches"), groups.alias("groups"))
