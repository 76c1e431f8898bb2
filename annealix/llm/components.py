"""Connected components of an edge table by alternating large- and small-star steps.

Each step is a minimum per node (combined before the shuffle) and an equi-join
that AQE can split, so a node with very many edges meets in no single task.
Every round is written to the shared folder; nothing is gathered on the driver
but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point a node's larger (large) or smaller (small) neighbours to the least of its neighbourhood."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = near.join(least, "u")
    if large:
        out = both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) for every node that has an edge."""
    cur = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        new = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sign or new[0] == 0:
            break
        sign = new
        cur = materialise(_star(materialise(_star(cur, True), "star"), False), "star")
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
