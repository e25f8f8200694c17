"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ocrspark.llm.common import stored


def connected_components(links: DataFrame, label: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; a component is named by its least node.

    Each round hooks every node's larger neighbours to the least node around it, then every
    node and its smaller neighbours to the least of those. Links at most halve the depth of the
    trees, so rounds grow with the logarithm of a component's width. Least neighbours are
    aggregated on the map side and stored, which leaves the joins to Spark's skew splitting: a
    node with very many links is not gathered in one task. The rounds end when the links stay as
    they are; only a count and a checksum reach the driver.

    Self links and repeated links are allowed, rows with a null end are ignored, and an empty
    input gives an empty result.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), label)
    state = None
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{label}-least")
        large = stored(
            both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            f"{label}-large",
        )
        under = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{label}-under")
        small = large.join(under, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = stored(small.unionAll(under.withColumnRenamed("m", "lo")).distinct(), label)
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    nodes = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionAll(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
