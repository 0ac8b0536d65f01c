"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the smallest node reachable, itself included.

    Links are undirected; loops, repeats and rows with a null end are ignored. An empty table gives no rows.
    Each step keeps one row per link at most and combines before it shuffles, so a hub costs no more than its links;
    state is checkpointed after each round. Rounds grow with the logarithm of the longest chain.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = cut(e)
    before = None
    while True:
        # large star: each larger neighbour points to the smallest of the neighbourhood. u > v in all links, so that the
        # smallest of a node and its neighbours is the least v, or the node itself where it is no u
        low = e.select(F.explode(F.array(F.struct("u", F.col("v").alias("m")), F.struct(F.col("v").alias("u"), F.col("v").alias("m")))).alias("end")).groupBy("end.u").agg(F.min("end.m").alias("m"))
        large = e.join(_keyed(low), F.col("v") == F.col("k")).select("u", F.col("m").alias("v")).where("u != v").distinct()
        # small star: the smaller neighbours and the node point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_keyed(low), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u != v").distinct(), e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("root"))
    roots = e.select(F.col("v").alias("u")).distinct().join(stars.select("u"), "u", "left_anti")
    return stars.unionByName(roots.select("u", F.col("u").alias("root"))).withColumnRenamed("u", "node")


def _keyed(low: DataFrame) -> DataFrame:
    """low with its key as a computed column k: both sides of the join are dealt anew then, and a hub's part can be split."""
    return low.select(F.col("u").bitwiseXOR(F.lit(0)).alias("k"), "m")
