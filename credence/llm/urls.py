"""URL verdicts from a tree of path templates for each host.

Segments that vary are generalised: numbers and long hexadecimal names by their look, and the
children of a node that have too few tagged pages to be tested, if there are many. Sibling
branches whose share of bad pages does not differ significantly from that of the others are
merged. A template's purity is smoothed down the tree: the whole crawl, the host, then each
level's (merged) branch, each one shrunk towards the level above. Explicit rules come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FANOUT = 12
TESTABLE = 5  # tagged pages from which a child is a branch of its own, however many siblings it has
STRENGTH = 8.0
SIGNIFICANT = 2.58
REJECT = 0.5
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (struct of rule and verdict) that fits the host or a parent of it and the path's begin."""
    chain = None
    for domain, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        found = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain


def looks_variable(segment: Column) -> Column:
    """The segment with numbers and hexadecimal names of 8 or more characters as ``*``, ending kept."""
    return F.regexp_replace(segment, r"^(?:\d+|(?=[0-9a-fA-F-]*\d)[0-9a-fA-F-]{8,})(\.\w+)?$", "*$1")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, n, bad, tagged) with the segments of the generalised path, level by level.

    At each level down to the deepest, the children of a node with fewer than ``TESTABLE`` tagged
    pages become ``*`` if there are more than ``FANOUT`` of them. Only counts are grouped,
    combined before they are shuffled.
    """
    rows = staged(paths.withColumn("segments", F.transform(F.split(F.substring("path", 2, 1 << 30), "/"), looks_variable)), "segments")
    done = [rows.where("false")]
    for level in range(1, (rows.agg(F.max(F.size("segments"))).first()[0] or 0) + 1):
        rows = rows.withColumn("prefix", F.concat_ws("/", F.slice("segments", 1, level - 1)))
        rows = rows.withColumn("segment", F.get("segments", F.lit(level - 1)))
        children = rows.groupBy("host", "prefix", "segment").agg(F.sum("tagged").alias("t")).where(F.col("t") < TESTABLE)
        wide = children.groupBy("host", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > FANOUT).select("host", "prefix")
        vague = children.join(wide, ["host", "prefix"], "left_semi").select("host", "prefix", "segment", F.lit(True).alias("vague"))
        rows = rows.join(vague, ["host", "prefix", "segment"], "left")
        rest = F.slice("segments", F.lit(level + 1), F.size("segments"))
        general = F.concat(F.slice("segments", 1, level - 1), F.array(F.lit("*")), rest)
        rows = rows.withColumn("segments", F.when(F.col("vague"), general).otherwise(F.col("segments")))
        rows = staged(rows.select(done[0].columns), "segments")
        done.append(rows.where(F.size("segments") == level))
        rows = rows.where(F.size("segments") > level)
    return reduce(DataFrame.unionAll, done)


def _smoothed(bad: Column, count: Column, prior: Column) -> Column:
    return (bad + STRENGTH * prior) / (count + STRENGTH)


def template_purity(rows: DataFrame) -> DataFrame:
    """(host, segments, impurity) for each template of ``rows`` (host, segments, n, tagged, bad)."""
    leaves = staged(rows.groupBy("host", "segments").agg(*(F.sum(c).alias(c) for c in ("n", "tagged", "bad"))), "templates")
    whole = leaves.agg(F.sum("tagged").alias("t"), F.sum("bad").alias("b")).select(F.coalesce((F.col("b") + 1) / (F.col("t") + 2), F.lit(0.5)).alias("base")).first().base
    hosts = leaves.groupBy("host").agg(F.sum("tagged").alias("t"), F.sum("bad").alias("b"))
    nodes = hosts.select("host", F.lit("").alias("prefix"), _smoothed(F.col("b"), F.col("t"), F.lit(whole)).alias("impurity"))
    found = []
    for level in range(1, (leaves.agg(F.max(F.size("segments"))).first()[0] or 0) + 1):
        deep = leaves.where(F.size("segments") >= level)
        prefix = F.concat_ws("/", F.slice("segments", 1, level))
        own = deep.groupBy("host", F.concat_ws("/", F.slice("segments", 1, level - 1)).alias("parent"), prefix.alias("prefix")).agg(
            F.sum("tagged").alias("t"), F.sum("bad").alias("b"))
        own = staged(own, "branches")
        family = own.groupBy("host", "parent").agg(F.sum("t").alias("all_t"), F.sum("b").alias("all_b"))
        own = own.join(family, ["host", "parent"])
        others, bad = F.col("all_t") - F.col("t"), F.col("all_b") - F.col("b")
        pooled = F.try_divide("all_b", "all_t")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "t") + F.try_divide(F.lit(1), others)))
        z = F.try_divide(F.abs(F.try_divide("b", "t") - F.try_divide(bad, others)), error)
        own = own.withColumn("merge", F.when((F.col("t") == 0) | (others == 0) | (error == 0), True).otherwise(z < SIGNIFICANT))
        alike = own.where("merge").groupBy("host", "parent").agg(F.sum("t").alias("merged_t"), F.sum("b").alias("merged_b"))
        own = own.join(alike, ["host", "parent"], "left")
        merged = lambda c: F.when(F.col("merge"), F.col(f"merged_{c}")).otherwise(F.col(c))
        own = own.select("host", "parent", "prefix", merged("t").alias("t"), merged("b").alias("b"))
        above = nodes.select("host", F.col("prefix").alias("parent"), F.col("impurity").alias("prior"))
        nodes = own.join(above, ["host", "parent"]).select("host", "prefix", _smoothed(F.col("b"), F.col("t"), F.col("prior")).alias("impurity"))
        nodes = staged(nodes, "nodes")  # the next level's prior
        ended = leaves.where(F.size("segments") == level).select("host", "segments", F.concat_ws("/", "segments").alias("prefix"))
        found.append(ended.join(nodes, ["host", "prefix"]).select("host", "segments", "impurity"))
    empty = leaves.where("false").select("host", "segments", F.lit(0.0).alias("impurity"))
    return reduce(DataFrame.unionAll, found, empty)


def judge(pages: DataFrame, bad_pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and impurity for each row of ``pages`` (page_id, url).

    ``bad_pages`` (page_id, bad) tags some pages, bad being 0 or 1; several tags of a page count
    as bad if any is. Templates that are bad with ``REJECT`` or more are blocked. A null url, or
    one without ``://``, has an empty host and path. Other columns are ignored.
    """
    tags = bad_pages.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tagged = rows.join(tags, "page_id", "left")
    counts = tagged.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("tagged"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    general = templates(staged(counts, "paths"))
    purity = template_purity(general)
    by_path = general.select("host", "path", "segments").join(purity, ["host", "segments"])
    by_path = by_path.select("host", "path", F.concat(F.lit("/"), F.concat_ws("/", "segments")).alias("template"), F.round("impurity", 6).alias("impurity"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("impurity") >= REJECT, "block").otherwise("allow")
    return rows.join(by_path, ["host", "path"], "left").withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), method).alias("verdict"), "template", "impurity")
