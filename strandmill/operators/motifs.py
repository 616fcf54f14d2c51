"""Adapters and enriched k-mers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import binomial_above
from ..plans.cubes import KMER_BASES, KMER_EVERY, adapter_cube


def with_running_max(reads: DataFrame, longest_adapter: int) -> DataFrame:
    """Adds run_max: the longest read so far (among those longer than the adapter), by ord.

    No window over all reads: each length matters only from its first occurrence on, so the steps come from a table of the
    different lengths, which is joined as ranges.
    """
    first = reads.where(F.length("sequence") > longest_adapter).groupBy(F.length("sequence").alias("len")).agg(F.min("ord").alias("since"))
    before = F.max("len").over(Window.orderBy("since").rowsBetween(Window.unboundedPreceding, -1))
    steps = first.withColumn("_b", before).where("_b is null or len > _b").select("len", "since", F.lead("since").over(Window.orderBy("since")).alias("until"))
    r, s = reads.alias("r"), F.broadcast(steps).alias("s")
    joined = r.join(s, F.expr("r.ord >= s.since and (s.until is null or r.ord < s.until)"), "left")
    return joined.select("r.*", F.coalesce("s.len", F.lit(0)).alias("run_max"))


def adapter_hits(reads: DataFrame, adapters: list[tuple[str, str]]) -> DataFrame:
    """The adapter cube. With adapters of one length hits need no order; with several, a hit counts only inside the longest
    read so far less the longest adapter."""
    sizes = {len(a) for _, a in adapters}
    if len(sizes) <= 1:
        return adapter_cube(reads, adapters)
    longest = max(sizes)
    return adapter_cube(with_running_max(reads, longest), adapters, F.col("idx") <= F.greatest(F.col("run_max") - longest, F.lit(0)))


def adapter_axis(longest_read: int, adapters: list[tuple[str, str]]) -> int:
    """Positions that the adapter module reports."""
    longest = max((len(a) for _, a in adapters), default=0)
    return longest_read - longest + 1 if longest_read > longest else 1


def adapter_content(cube: DataFrame, positions: DataFrame, adapters: list[tuple[str, str]], total: int, axis: int) -> DataFrame:
    """adapter (number), name, grp, position (label), percent: share of reads with a first hit at or before a position, averaged over the group. Positions beyond the axis count 0."""
    spark = cube.sparkSession
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(adapters)], "adapter int, name string")
    grid = F.broadcast(names).crossJoin(F.broadcast(positions))
    dense = grid.join(cube.select("adapter", (F.col("idx") + 1).alias("pos"), "n"), ["adapter", "pos"], "left")
    cum = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("adapter").orderBy("pos"))
    rows = dense.select("adapter", "name", "grp", "label", F.when(F.col("pos") <= axis, cum).otherwise(0).alias("cum"))
    mean = F.sum("cum") * 100.0 / F.count("*")
    percent = mean / float(total) if total else F.lit(float("nan"))
    return rows.groupBy("adapter", "name", "grp", F.col("label").alias("position")).agg(percent.alias("percent"))


def sampled_longest(reads: DataFrame) -> DataFrame:
    """One row: the longest k-mer sampled read, as far as it is read."""
    return reads.where(F.col("ord_pf") % KMER_EVERY == 0).agg(F.coalesce(F.max(F.least(F.length("sequence"), F.lit(KMER_BASES))), F.lit(0)).alias("longest"))


def kmer_enrichment(cube: DataFrame, positions: DataFrame, k: int) -> DataFrame:
    """kmer, n, grp, hits, group_total, predicted, obs_exp, p: single-precision ratios, and 4^k times the binomial tail (1 where there are no more hits than predicted)."""
    by_group = cube.join(F.broadcast(positions.select("pos", "grp")), "pos")
    hits = by_group.groupBy("kmer", "grp").agg(F.sum("n").alias("hits"))
    group_total = by_group.groupBy("grp").agg(F.sum("n").alias("group_total"))
    total = cube.agg(F.sum("n").alias("all"))
    kmers = cube.groupBy("kmer").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total))
    share = (F.col("n").cast("float") / F.col("all").cast("float")).cast("float")
    rows = hits.join(kmers.withColumn("share", share), "kmer").join(F.broadcast(group_total), "grp")
    rows = rows.withColumn("predicted", (F.col("share") * F.col("group_total").cast("float")).cast("float"))
    rows = rows.withColumn("obs_exp", F.when(F.col("predicted") > 0, (F.col("hits").cast("float") / F.col("predicted")).cast("float")).otherwise(F.lit(0).cast("float")))

    @F.pandas_udf("double")
    def tail(n: pd.Series, p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([binomial_above(int(a), float(b), int(c)) * 4.0**k for a, b, c in zip(n, p, h, strict=True)])

    rows = rows.withColumn("candidate", (F.col("hits").cast("float") > F.col("predicted")) & (F.col("obs_exp") > 5))
    # Only candidates can be significant, so the tail is worked out for them alone.
    near = rows.where("candidate").withColumn("p", tail("group_total", F.col("share").cast("double"), "hits").cast("float"))
    far = rows.where("not candidate").withColumn("p", F.lit(1).cast("float"))
    return near.unionByName(far).drop("candidate", "all", "share")


def top_kmers(enriched: DataFrame, positions: DataFrame, most: int = 20) -> DataFrame:
    """kmer, count (times 5), p, max_obs_exp, position: k-mers significant in a group (p < 0.01, obs/exp > 5), highest ratio first, ties by k-mer."""
    labels = positions.select("grp", "label").distinct()
    best = enriched.groupBy("kmer").agg(
        (F.first("n") * 5).alias("count"), F.min(F.when((F.col("p") < 0.01) & (F.col("obs_exp") > 5), F.col("p"))).alias("p"),
        F.max("obs_exp").alias("max_obs_exp"), F.max_by("grp", F.struct("obs_exp", -F.col("grp"))).alias("grp"),
    )
    found = best.where(F.col("p") < 0.01).orderBy(F.desc("max_obs_exp"), "kmer").limit(most)
    return found.join(F.broadcast(labels), "grp").select("kmer", "count", "p", "max_obs_exp", F.col("label").alias("position")).orderBy(F.desc("max_obs_exp"), "kmer")


def minus_log10(p: float) -> float:
    return -math.log10(p) if p > 0 else math.inf
