"""Connected components of a graph of links, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """links(a, b: long) -> (node, component), component the least node that is reachable.

    Alternates large-star and small-star contraction. Each is a minimum per node with map-side combining and a join, so a
    node with very many links is never gathered in one task. Links to itself and repeated links don't matter; links with a
    null end are ignored; no links give no rows.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    nodes = written(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct()
        )
        after = written(small)
        dropped(edges)
        edges = after
    out = nodes.join(edges.groupBy("u").agg(F.min("v").alias("c")), nodes.node == F.col("u"), "left")
    return out.select("node", F.coalesce("c", "node").alias("component"))
