"""Connected components of undirected links by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import cut


def _stars(both: DataFrame, large: bool) -> DataFrame:
    """One star step over directed rows (u, v): each u links its larger (large)
    or its smaller neighbours and itself to the smallest of u and them all."""
    rows = both if large else both.filter("v < u")
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = rows.join(least, "u")
    if large:
        return joined.filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("u != m").select("u", F.col("m").alias("v"))
    return joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: longs): the label is the
    smallest node that links reach.

    A step moves at most one row a link, so a node with very many neighbours is
    spread by the joins' skew handling; the number of rounds is logarithmic.
    """
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        wide = _stars(edges.union(back), True).distinct()
        edges = cut(_stars(wide, False).distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = tuple(now)
