"""Connected components of a link table, by alternating large and small stars. Links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkappe.session import written


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    star = both.join(least, both["a"] == least["node"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return star.filter("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these. Rows have a > b."""
    least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    star = links.join(least, links["a"] == least["node"])
    return star.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a long, b long) but the roots; the root is the smallest node that it reaches.

    Repeated links, links to oneself and both directions are fine; rows with nulls are left out.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    seen = tuple(now.agg(*mark).first())
    while seen[0]:
        now = written(_small(_large(now)), "links")
        new = tuple(now.agg(*mark).first())
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
