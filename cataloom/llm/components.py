"""Connected components of a table of links, by alternating large and small stars.

Each step is an aggregation of a minimum by node and a join back, so a node with a third of all links
is pre-aggregated before the shuffle and split by the adaptive join; no node's links meet in one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cataloom.llm.storage import discard, stored


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Points every neighbour of a node that is larger (large star) or not larger (small star) at the least one."""
    if small:
        sided = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sided = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    pointed = sided.join(least, "u")
    if small:
        moved = pointed.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    else:
        moved = pointed.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component): the least node reachable, for every node of a link.

    Links of a node with itself, repeated links and links with a null end are passed over.  Ends when a round changes
    nothing, which takes a few rounds even for long chains.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if state == seen or not state[0]:
            break
        seen = state
        after = stored(_stars(_stars(edges, False), True), "stars")
        discard(edges)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
