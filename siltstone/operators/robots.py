"""robots.txt as tables: rules of each group, the group of each agent, and the verdict for each path.

Rule matching is a theta join decided by the longest match: a rule's pieces are sought one after the
other, and each (agent, path) keeps the greatest (length, is_allow) by a map-side aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.session import small


def lines(files: DataFrame, site: str = "site", text: str = "text") -> DataFrame:
    """(site, line, field, value, group_no) of each directive. Consecutive User-agent lines open one
    group, a rule closes it; group_no is 0 before any. Blank lines and comments give no rows."""
    each = files.select(F.col(site).alias("site"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n")).alias("n", "raw"))
    bare = F.regexp_replace("raw", r"#.*$", "")
    each = each.select("site", (F.col("n") + 1).alias("line"), F.trim(bare).alias("bare")).where("bare <> ''")
    each = each.withColumn("field", F.lower(F.regexp_extract("bare", r"^([A-Za-z-]+)\s*:", 1))).withColumn("value", F.trim(F.regexp_extract("bare", r"^[A-Za-z-]+\s*:\s*(.*)$", 1)))
    # one robots file is one partition of these windows; its size is capped by the crawler
    by_line = W.partitionBy("site").orderBy("line")
    agent = F.col("field") == "user-agent"
    # sitemap lines stand outside groups: they neither open nor close one
    step = each.withColumn("rule", ~F.col("field").isin("sitemap", "", "user-agent"))
    last = F.last(F.when(F.col("rule"), "rule").when(agent, "agent"), True).over(by_line.rowsBetween(W.unboundedPreceding, -1))
    opens = step.withColumn("opens", agent & (F.coalesce(last, F.lit("rule")) == "rule"))
    return opens.withColumn("group_no", F.sum(F.col("opens").cast("int")).over(by_line)).select("site", "line", "bare", "field", "value", "group_no")


def errors(directives: DataFrame) -> DataFrame:
    """(site, line, error): unparseable lines, rules before any group, delays that are no number."""
    early = (F.col("group_no") == 0) & ~F.col("field").isin("sitemap", "user-agent", "")
    delay = F.col("field").isin("crawl-delay", "crawldelay") & F.expr("try_cast(value as double)").isNull()
    error = F.when(F.col("field") == "", "unparseable").when(early, "before any group").when(delay, "non-numeric crawl-delay")
    return directives.select("site", "line", error.alias("error")).where("error is not null")


def rules(directives: DataFrame) -> DataFrame:
    """(site, group_no, rule, is_allow)."""
    return directives.where(F.col("field").isin("allow", "disallow") & (F.col("group_no") > 0)).select(
        "site", "group_no", F.col("value").alias("rule"), (F.col("field") == "allow").alias("is_allow"),
    )


def delays(directives: DataFrame) -> DataFrame:
    """(site, group_no, delay) of the last delay that is a number."""
    delay = directives.where(F.col("field").isin("crawl-delay", "crawldelay") & (F.col("group_no") > 0)).select(
        "site", "group_no", "line", F.expr("try_cast(value as double)").alias("delay"),
    ).where("delay is not null")
    return delay.groupBy("site", "group_no").agg(F.max_by("delay", "line").alias("delay"))


def agent_groups(directives: DataFrame, agents: DataFrame) -> DataFrame:
    """(site, agent, group_no, explicitly_named): the group of the longest token that begins the agent's
    name, the earlier of equals; else the first '*' group; no row if there is neither. agents is a
    short list of crawlers, joined to the tokens of each site."""
    tokens = directives.where("field = 'user-agent'").select("site", "group_no", "line", F.lower("value").alias("token"))
    name = F.lower(F.col("agent"))
    pairs = tokens.join(small(agents.select("agent").distinct()), (F.col("token") == "*") | F.startswith(name, F.col("token")))
    order = F.struct((F.col("token") != "*").cast("int"), F.when(F.col("token") != "*", F.length("token")).otherwise(0), -F.col("group_no"), -F.col("line"))
    best = pairs.groupBy("site", "agent").agg(F.max_by(F.struct("group_no", (F.col("token") != "*").alias("explicitly_named")), order).alias("g"))
    return best.select("site", "agent", "g.group_no", "g.explicitly_named")


def matches(rule: Column, path: Column) -> Column:
    """Whether a rule with '*' for any text and a last '$' for the path's end matches. Each literal piece
    is sought once, at its leftmost place after the one before, so no rule takes long; a regular
    expression or LIKE would try all places."""
    anchored = F.endswith(rule, F.lit("$"))
    bare = F.when(anchored, F.left(rule, F.length(rule) - 1)).otherwise(rule)
    pieces = F.split(bare, "[*]")
    n, tail = F.size(pieces), F.element_at(pieces, -1)
    start = F.when(F.startswith(path, F.get(pieces, F.lit(0))), F.length(F.get(pieces, F.lit(0)))).otherwise(-1)
    between = F.slice(pieces, 2, F.greatest(F.lit(0), n - F.when(anchored, 2).otherwise(1)))

    def seek(at: Column, piece: Column) -> Column:
        found = F.position(piece, path, at + 1)
        return F.when(at < 0, -1).when(piece == "", at).when(found > 0, found - 1 + F.length(piece)).otherwise(-1)

    end = F.aggregate(between, start, seek)
    at_end = F.when(n == 1, F.length(path) == end).otherwise((tail == "") | ((F.length(path) - F.length(tail) >= end) & F.endswith(path, tail)))
    return (rule != "") & (end >= 0) & (~anchored | at_end)


def verdicts(rule_table: DataFrame, groups: DataFrame, paths: DataFrame) -> DataFrame:
    """(site, agent, path, allowed) of each agent of groups and each (site, path). The longest matching
    rule decides, its length counted as written; Allow wins ties; no matching rule allows."""
    asked = groups.join(paths.select("site", "path").distinct(), "site")
    found = asked.join(rule_table.where("rule <> ''"), ["site", "group_no"], "left").withColumn("matches", matches(F.col("rule"), F.col("path")))
    decided = found.groupBy(
        "site", "agent", "path",
    ).agg(F.max(F.when(F.col("matches"), F.struct(F.length("rule").alias("size"), F.col("is_allow").alias("is_allow")))).alias("best"))
    return decided.select("site", "agent", "path", F.coalesce("best.is_allow", F.lit(True)).alias("allowed"))


def blocks_everything(rule_table: DataFrame) -> DataFrame:
    """(site, group_no, blocks_all): '/' is disallowed and nothing allowed."""
    allowed, blocked = F.count_if(F.col("is_allow")), F.count_if(~F.col("is_allow") & (F.col("rule") == "/"))
    return rule_table.groupBy("site", "group_no").agg(((blocked > 0) & (allowed == 0)).alias("blocks_all"))
