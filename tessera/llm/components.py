"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(u, v) pairs of longs -> (node, component), component the smallest node reachable.

    Every round joins the edges with one minimum per node (a map-side combined
    aggregate) and is written to the checkpoint folder; nothing is collected but a
    count and a checksum. Rounds grow with the logarithm of the longest chain, and none
    has more edges than the one before. ``most`` edges are given at most, if it is known.
    Self links and null ends are ignored; nodes without a link have no row.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(e.distinct() if most is None else gathered(e.distinct(), most))
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(gathered(small.union(low.select("u", F.col("m").alias("v"))).distinct(), now[0]))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
