"""Connected components of an edge table, by alternating large and small stars.

Every round is two joins of stored tables on the node, so nodes with very many edges are
split by AQE; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.llm.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of each node at the smallest of them (all of them, or the smaller ones)."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = edges.unionByName(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = seen.groupBy("u").agg(F.min("v").alias("least"))
    lowest = written(lowest.select("u", F.least("u", "least").alias("least")), "star")
    if large:
        pointed = seen.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        pointed = seen.join(lowest, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        pointed = pointed.unionByName(lowest.select("u", F.col("least").alias("v")))
    return written(pointed.where("u != v").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u, v) is connected with."""
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    before = None
    while True:
        now = edges.select(mark.alias("m")).first()["m"]
        if now == before:
            break
        before = now
        edges = _star(_star(edges, True), False)
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
