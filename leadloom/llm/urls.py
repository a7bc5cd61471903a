"""URL filters by rules and by a tree of path templates per host. Native: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.shared import sent_if_small, stored

#: (host, path, verdict): holds for the host and all its subdomains, if the path of the url starts with the rule's.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Levels of the tree; deeper segments are one wildcard.
DEPTH = 4
#: A node's children become one wildcard beyond this many, if they have fewer pages each than FEW on average.
MAX_CHILDREN, FEW = 20, 10
#: Labelled siblings whose share of blocked pages is within so many standard errors of all their siblings' are merged.
ERRORS = 2.0
#: A template is rejected from this share of blocked pages, smoothed by SMOOTH pages of which half are blocked.
REJECT_AT, SMOOTH = 0.8, 4.0

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column, depth: int = DEPTH) -> Column:
    """First segments of a path with numbers and long hexadecimal ids as wildcards; the rest of a deeper path is ``**``."""
    s = F.filter(F.split(path, "/", -1), lambda x: x != "")
    s = F.transform(s, lambda x: F.regexp_replace(F.regexp_replace(x, r"[0-9a-fA-F]{12,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "<x>"), r"[0-9]+", "<n>"))
    return F.when(F.size(s) > depth, F.concat(F.slice(s, 1, depth), F.array(F.lit("**")))).otherwise(s)


def templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, segments, template, n_pages, n_blocked, n_allowed) from rows with host, segments and label (block, allow
    or null), one row per distinct host and segments.

    Works on distinct paths with their counts, level by level: the children of a node become a wildcard if they are
    many and thin; labelled children that do not differ from all labelled children of the node become one branch.
    """
    count = lambda c: F.sum(c).alias
    t = pages.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("label") == "block", 1)).alias("bad"), F.count(F.when(F.col("label") == "allow", 1)).alias("good"))
    t = stored(t.withColumn("template", F.lit("")), "paths")
    for level in range(depth + 1):
        t = t.withColumn("child", F.get("segments", F.lit(level)))
        node = ["host", "template"]
        children = t.filter("child IS NOT NULL").groupBy(*node, "child").agg(count("n")("n"), count("bad")("bad"), count("good")("good"))
        labelled = F.col("bad") + F.col("good") > 0
        parents = children.groupBy(*node).agg(
            F.count("*").alias("n_children"), F.sum("n").alias("n_all"), F.sum("bad").alias("bad_all"), F.sum(F.col("bad") + F.col("good")).alias("known_all"),
            F.count(F.when(labelled, 1)).alias("n_labelled"))
        c = children.join(parents, node)
        share, own = F.col("bad_all") / F.col("known_all"), F.col("bad") / (F.col("bad") + F.col("good"))
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / (F.col("bad") + F.col("good")))
        similar = labelled & (F.col("n_labelled") > 1) & (F.abs(own - share) <= ERRORS * error + 1e-9)
        thin = (F.col("n_children") > MAX_CHILDREN) & (F.col("n_all") < FEW * F.col("n_children"))
        name = F.when(thin, "*").when(F.coalesce(similar, F.lit(False)), "+").otherwise(F.col("child"))
        names = c.select(*node, "child", name.alias("name"))
        t = t.join(names, [*node, "child"], "left").withColumn(
            "template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")))
        t = stored(t.select("host", "segments", "n", "bad", "good", "template"), "tree")
    sums = t.groupBy("host", "template").agg(count("n")("n_pages"), count("bad")("n_blocked"), count("good")("n_allowed"))
    return t.select("host", "segments", "template").join(sums, ["host", "template"])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per row of ``pages``.

    verdict is that of the longest rule that fits; other urls are blocked if their template is: purity is the smoothed
    share of blocked ones among the labelled pages of the template, labelled by the rules; a template without any is
    allowed. In templates, <n> and <x>
    are numbers and ids, * stands for many thin children, + for labelled children that are alike. Null urls and urls
    without ``://`` have empty host and path. Repeated rows come out as often as they go in; other columns are not read.
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias("m"), segments(F.col("path")).alias("segments"))
    p = p.select("page_id", "host", "path", "segments", "m.rule", F.col("m.verdict").alias("label"))
    table = stored(templates(p), "templates")
    purity = (F.col("n_blocked") + 0.5 * SMOOTH) / (F.col("n_blocked") + F.col("n_allowed") + SMOOTH)
    table = sent_if_small(table.select("host", "segments", "template", purity.alias("purity")))
    joined = p.join(table, ["host", "segments"], "left")
    verdict = F.coalesce("label", F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
