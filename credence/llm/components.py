"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that can be reached, for each node of the links (a, b).

    Each round links every node's larger neighbours, then its smaller ones, to the least
    neighbour; the number of rounds grows with the logarithm of the longest chain. Only
    grouped minima are formed, so a node with very many links is combined before it is
    shuffled. No links give no rows; null ends and links from a node to itself are left out.
    """
    a, b = F.col("a"), F.col("b")
    pairs = staged(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name,
    )
    while True:
        before = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        both = pairs.unionAll(pairs.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.when(b == F.col("m"), F.array(F.struct(a, b)))
                      .otherwise(F.array(F.struct(a, F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b"))))).alias("p")
        ).select("p.a", "p.b").where(a != b).distinct()
        pairs = staged(small, name)
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
    nodes = pairs.select(a.alias("node"), b.alias("component"))
    return nodes.unionAll(pairs.select(b.alias("node"), b.alias("component")).distinct())
