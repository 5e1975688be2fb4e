"""Connected components of links between numbers, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postfunnel.llm.common import written


#: A number with more links than this has them dealt to ``SALTS`` tasks, each with a copy of its least one.
HUB = 1000
SALTS = 64


def _star(both: DataFrame, hubs: bool) -> DataFrame:
    """u, v and the least number that u is linked with, itself included."""
    if not hubs:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u")
    both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = both.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).drop("salt")


def _pairs(*pairs) -> Column:
    """Rows (u, v) for each pair of columns, without reading the input again."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Has every number one link down at most, and none of those it leads to another?  And the most links of a number."""
    def end(name, up):
        return F.struct(F.col(name).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))

    ends = edges.select(F.inline(F.array(end("u", 1), end("v", 0))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("links"))
    bad, links = nodes.agg(F.max((F.col("up") > 0) & (F.col("up") + F.col("down") > 1)), F.max("links")).first()
    return not bad, links or 0


def components(links: DataFrame) -> DataFrame:
    """node and root (the least number of its component) of all numbers in ``links`` (u, v).

    Every round groups by number with partial minima, and the links of a number
    with many are dealt to several tasks; rounds grow with the logarithm of the
    longest chain.  Each round is a written table, so lost executors
    cost one round.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not (shape := _shape(edges))[0]:
        hubs = shape[1] > HUB
        large = _star(edges.select(_pairs(("u", "v"), ("v", "u"))), hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large, hubs).select(_pairs(("u", "m"), ("v", "m"))).where("u <> v").distinct()
        edges = written(small, "links")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components that ``links`` (u, v) make of earlier ones, given as node and root."""
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
