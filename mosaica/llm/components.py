"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: each node's neighbours are hung on the least of them and itself.

    Groups are reduced by ``min`` before they are shuffled and joined back, so the links of a hub never meet in one task's
    memory; a skewed join key is split by adaptive execution.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    hung = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    hung = hung.where("a <> b")
    return hung if large else hung.distinct()  # a large star makes no row twice


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the least id reachable) for every id that has a link; links holds integer columns a and b.

    Rounds end when the links are stars around least ids, which is after O(log^2) of them; each is written to the shared
    folder. Self-links and nulls are ignored; an empty table gives an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(rounds):
        edges = common.written(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
