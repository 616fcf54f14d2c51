"""Duplication levels and overrepresented sequences, from the duplicate cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The level (less one) above which a read counts in a wider slot, and the slots' labels.
SLOT_EDGES = (9, 49, 99, 499, 999, 4999, 9999)
SLOT_LABELS = ("1", "2", "3", "4", "5", "6", "7", "8", "9", ">10", ">50", ">100", ">500", ">1k", ">5k", ">10k+")


def admitted(cube: DataFrame, limit: int | None) -> DataFrame:
    """The prefixes that came before the limit on different ones was reached: a top-k by first occurrence, and only if there are more. All without a limit."""
    if limit is None or cube.count() <= limit:
        return cube
    return cube.orderBy("first_ord").limit(limit)


def count_at_limit(kept: DataFrame, limit: int) -> DataFrame:
    """One row: reads so far when the last prefix was admitted; all reads if the limit wasn't reached."""
    return kept.agg(F.when(F.count("*") >= limit, F.max("first_ord")).otherwise(F.coalesce(F.sum("n"), F.lit(0))).alias("at_limit"))


def corrected(level: Column, seen: Column, at_limit: Column, total: Column) -> Column:
    """How many prefixes of this level there are, if `seen` were met among the first `at_limit` of `total` reads.

    The chance that a prefix with `level` reads has none among the first at_limit is the product over its reads of the shares of the places behind.
    After 40 * total / at_limit of them it is below e^-40, which no number of prefixes cares for, so a level of any height takes no more steps.
    """
    steps = F.least(level, F.ceil(40.0 * total / at_limit).cast("long"))
    missed = F.aggregate(F.sequence(F.lit(0).cast("long"), steps - 1), F.lit(1.0), lambda p, j: p * F.greatest(total - at_limit - j, F.lit(0)) / (total - j))
    careless = 1 - seen / (seen + 0.01)
    chance = F.when(missed < careless, 0.0).otherwise(missed)
    return F.when((at_limit == total) | (total - seen < at_limit), seen.cast("double")).otherwise(seen / (1 - chance))


def duplication_levels(cube: DataFrame, total: int, limit: int | None = 100_000) -> DataFrame:
    """slot (0..15), level (label), percent of all reads after deduplication is corrected; deduplicated: percent left (100 if empty), in every row.

    Without a limit every prefix is counted and nothing is corrected.
    """
    if limit is None or cube.count() < limit:  # nothing was frozen: one aggregation of the cube
        levels = cube.groupBy("n").agg(F.count("*").alias("seen")).withColumn("at_limit", F.lit(total).cast("long"))
    else:
        kept = admitted(cube, limit)
        levels = kept.groupBy("n").agg(F.count("*").alias("seen")).crossJoin(F.broadcast(count_at_limit(kept, limit)))
    exact = levels.select("n", corrected(F.col("n"), F.col("seen"), F.col("at_limit"), F.lit(total).cast("long")).alias("unique"))
    over = F.col("n") - 1
    slot = over
    for k, edge in enumerate(SLOT_EDGES):
        slot = F.when(over > edge, 9 + k).otherwise(slot)
    slots = exact.groupBy(slot.cast("int").alias("slot")).agg(F.sum("unique").alias("u"), F.sum(F.col("unique") * F.col("n")).alias("r"))
    axis = cube.sparkSession.createDataFrame(list(enumerate(SLOT_LABELS)), "slot int, level string")
    sums = slots.agg(F.sum("u").alias("all_u"), F.sum("r").alias("all_r"))
    dense = F.broadcast(axis).join(slots, "slot", "left").crossJoin(F.broadcast(sums))
    return dense.select(
        "slot", "level", (F.coalesce(F.try_divide(F.col("r"), F.col("all_r")), F.lit(0.0)) * 100).alias("percent"),
        (F.coalesce(F.try_divide(F.col("all_u"), F.col("all_r")), F.lit(1.0)) * 100).alias("deduplicated"),
    )


def overrepresented(cube: DataFrame, total: int, limit: int | None = 100_000, least: float = 0.1) -> DataFrame:
    """prefix, n, percent (of all reads, over `least`), most frequent first, then in order of the sequence."""
    percent = F.col("n") / F.lit(float(total or 1)) * 100
    return admitted(cube, limit).select("prefix", "n", percent.alias("percent")).where(F.col("percent") > least).orderBy(F.desc("n"), "prefix") if total else cube.select("prefix", "n", F.lit(0.0).alias("percent")).limit(0)
