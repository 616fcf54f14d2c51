"""Base, tile and read quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A position has percentiles only with more qualities than this.
ENOUGH = 100
PERCENTS = {"p10": 10, "lower_quartile": 25, "median": 50, "upper_quartile": 75, "p90": 90}
MOST_TILES = 2500


def encoding_name(lowest: Column) -> Column:
    return F.when(lowest < 33, "Unknown").when(lowest < 64, "Sanger / Illumina 1.9").when(lowest == 65, "Illumina 1.3").when(lowest <= 126, "Illumina 1.5").otherwise("Unknown")


def encoding_offset(lowest: Column) -> Column:
    return F.when((lowest >= 64) & (lowest <= 126), 64).otherwise(33)


def offset_row(cube: DataFrame) -> DataFrame:
    """One row: the offset that the least quality character tells."""
    return cube.agg(encoding_offset(F.min("q")).alias("off"))


def position_stats(cube: DataFrame, offset: DataFrame | int) -> DataFrame:
    """pos, total, mean and percentiles (null up to ENOUGH qualities) of cube (pos, q, n).

    A percentile is the least quality whose running count reaches total * p / 100, rounded down; characters below the offset
    count in the total only.
    """
    df = cube.withColumn("off", F.lit(offset)) if isinstance(offset, int) else cube.crossJoin(F.broadcast(offset))
    w = Window.partitionBy("pos")
    usable = F.when(F.col("q") >= F.col("off"), F.col("n")).otherwise(0)
    df = df.withColumn("total", F.sum("n").over(w)).withColumn("cum", F.sum(usable).over(w.orderBy("q")))
    reached = lambda p: F.min(F.when((F.col("q") >= F.col("off")) & (F.col("cum") >= F.floor(F.col("total") * p / 100)), F.col("q") - F.col("off")))
    value = F.col("q") - F.col("off")
    stats = df.groupBy("pos").agg(
        F.max("total").alias("total"), F.try_divide(F.sum(F.when(value >= 0, F.col("n") * value)), F.sum(usable)).alias("mean"),
        *[F.coalesce(reached(p), F.lit(-1)).alias(name) for name, p in PERCENTS.items()],
    )
    return stats.select("pos", "total", F.coalesce("mean", F.lit(0.0)).alias("mean"), *[F.when(F.col("total") > ENOUGH, F.col(c)).cast("double").alias(c) for c in PERCENTS])


def per_base_quality(cube: DataFrame, positions: DataFrame, offset: DataFrame | int) -> DataFrame:
    """grp, base (label), mean and percentiles: unweighted means over a group's positions; NaN percentiles where no position has enough."""
    stats = position_stats(cube, offset)
    grouped = F.broadcast(positions).join(stats, "pos", "left").groupBy("grp", F.col("label").alias("base"))
    nan = F.lit(float("nan"))
    return grouped.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("mean"), *[F.coalesce(F.avg(c), nan).alias(c) for c in ("median", "lower_quartile", "upper_quartile", "p10", "p90")])


def per_tile_quality(cube: DataFrame, positions: DataFrame, offset: DataFrame | int) -> DataFrame:
    """tile, grp, base, deviation of the tile's mean from the mean over all tiles; a tile without data in a group counts as 0."""
    df = cube.withColumn("off", F.lit(offset)) if isinstance(offset, int) else cube.crossJoin(F.broadcast(offset))
    value = F.col("q") - F.col("off")
    means = df.where(value >= 0).groupBy("tile", "pos").agg((F.sum(F.col("n") * value) / F.sum("n")).alias("m"))
    by_group = means.join(F.broadcast(positions), "pos").groupBy("tile", "grp").agg(F.avg("m").alias("m"))
    labels = positions.select("grp", F.col("label").alias("base")).distinct()
    # At most MOST_TILES tiles by as many groups as there are labels.
    full = cube.select("tile").distinct().crossJoin(F.broadcast(labels))
    dense = full.join(by_group, ["tile", "grp"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    return dense.select("tile", "grp", "base", (F.col("m") - F.avg("m").over(Window.partitionBy("grp"))).alias("deviation"))


def per_sequence_quality(cube: DataFrame, offset: DataFrame | int) -> DataFrame:
    """quality, n from the least to the largest mean quality, with zeros between, of the read cube."""
    counts = cube.where(F.col("avgq").isNotNull()).groupBy("avgq").agg(F.sum("n").alias("n"))
    ends = counts.agg(F.min("avgq").alias("lo"), F.max("avgq").alias("hi")).where("lo is not null")
    axis = ends.select(F.explode(F.sequence("lo", "hi")).alias("avgq"))
    dense = axis.join(counts, "avgq", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = dense.withColumn("off", F.lit(offset)) if isinstance(offset, int) else dense.crossJoin(F.broadcast(offset))
    return dense.select((F.col("avgq") - F.col("off")).cast("int").alias("quality"), "n")


def quality_mode(per_sequence: DataFrame) -> DataFrame:
    """The commonest mean quality, the lowest of equally common ones."""
    return per_sequence.agg(F.max_by("quality", F.struct("n", -F.col("quality"))).alias("mode"))
