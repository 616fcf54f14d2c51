"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps are an aggregation to the least neighbour and a join, so no component is gathered anywhere; hubs are split by
adaptive skew handling. Every round is written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), any direction. Large star: each larger neighbour of u is tied to u's least neighbour; small star: each not larger one, and u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b) that isn't its component's least node."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        nxt = scratch.write(_star(_star(now, True), False))
        scratch.drop_table(now)
        now, after = nxt, sign(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
