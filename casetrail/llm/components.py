"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base


def _to_least(edges: DataFrame, reach: str) -> DataFrame:
    """One star step over directed edges (u, v): the neighbours of u are tied to the least of u and its neighbours.

    ``large`` ties the greater neighbours, ``small`` (edges lead from the greater to the smaller node) all and u itself.
    The least neighbours are written first, so that the join below reads two shuffles and a hot node can be split.
    """
    least = base.store(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    met = edges.join(least, "u")
    if reach == "large":
        tied = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return base.store(tied.where("u <> v").distinct(), "stars")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (least node of the component) for every node of ``links`` (columns ``a, b``, longs).

    Both star steps keep the components; they alternate until the edges stay the same, when each node hangs on its
    component's least. Only counts and one checksum reach the driver.
    """
    edges = base.store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(check) or not check[0]:
            break
        state = tuple(check)
        edges = _to_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "large")
        edges = _to_least(edges, "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
