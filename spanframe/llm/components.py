"""Connected components of an edge table by alternating large-star and small-star rounds.

The edges are written once before the first round, which reads them several times: what made them, such as a comparison of
fingerprints, would otherwise run again for each read. Every round is two aggregations and two joins on node ids; nothing is
gathered on the driver but a count and a checksum.
A hub with many neighbours is pre-aggregated before the shuffle, and its joins may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, write_table, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    if small:  # each node with its lesser neighbours
        sides = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    else:
        sides = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = sides.join(least, "u")
    if small:
        met = met.select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        met = met.where(v > u).select(v.alias("u"), F.col("m").alias("v"))
    return met.where(u != v).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root the least node of its component; nodes that are roots are left out."""
    seen, spark = None, edges.sparkSession
    edges = write_table(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    while True:
        mark = written()
        edges = write_table(_star(_star(edges, False), True), "components")
        drop_tables(spark, mark - 1, mark)  # the links, then the round before
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(now)
