"""The shared aggregates that all modules are derived from. Each is one partial and final aggregation over the reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import adapter_index, dup_prefix
from ..functions.letters import PLACES, READS, count_places, count_reads

QUALITY_SLOTS = 149
KMER_BASES, KMER_EVERY = 500, 50
TILE_ALL, TILE_EVERY = 10_000, 10


def _chars(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """A row for each character: keys, pos (1-based), c. Column pruning leaves only what is named to the scan."""
    long = df.select(*keys, F.posexplode(F.split(column, "")).alias("pos", "c")).where("c <> ''")
    return long.withColumn("pos", F.col("pos") + 1)


def _places(reads: DataFrame, column: str) -> DataFrame:
    """pos (1-based), c, n: counted in Arrow batches, so no row a character is made."""
    return reads.select(column).mapInArrow(count_places, PLACES).groupBy("pos", "c").agg(F.sum("n").alias("n"))


def base_cube(reads: DataFrame) -> DataFrame:
    """pos, base, n."""
    return _places(reads, "sequence").withColumnRenamed("c", "base")


def quality_cube(reads: DataFrame) -> DataFrame:
    """pos, q (ASCII code), n."""
    return _places(reads, "quality").select("pos", F.least(F.ascii("c"), F.lit(QUALITY_SLOTS)).alias("q"), "n")


def read_cube(reads: DataFrame) -> DataFrame:
    """len, tlen (truncated), gc (within tlen), avgq (null without qualities), n."""
    return reads.select("sequence", "quality").mapInArrow(count_reads, READS).groupBy("len", "tlen", "gc", "avgq").agg(F.sum("n").alias("n"))


def duplicate_cube(reads: DataFrame, dup_length: int = 0) -> DataFrame:
    """prefix, n, first_ord."""
    return reads.select(dup_prefix(F.col("sequence"), dup_length).alias("prefix"), "ord_pf").groupBy("prefix").agg(F.count("*").alias("n"), F.min("ord_pf").alias("first_ord"))


def adapter_cube(reads: DataFrame, adapters: list[tuple[str, str]], keep: Column | None = None) -> DataFrame:
    """adapter (number), idx (0-based first hit), n."""
    hits = F.array(*[F.struct(F.lit(k).alias("adapter"), adapter_index(F.col("sequence"), a).alias("idx")) for k, (_, a) in enumerate(adapters)])
    rows = reads.select(*(["run_max"] if keep is not None else []), F.explode(F.filter(hits, lambda h: h["idx"] >= 0)).alias("h")).select("*", "h.adapter", "h.idx")
    return (rows.where(keep) if keep is not None else rows).groupBy("adapter", "idx").agg(F.count("*").alias("n"))


def tile_cube(reads: DataFrame, field: int) -> DataFrame:
    """tile, pos, q, n of the sampled reads. field: the place of the tile in the id, from 0."""
    tile = F.element_at(F.split("id", ":"), field + 1)
    sampled = tile_sample(reads).select(F.try_to_number(tile, F.lit("999999999")).cast("int").alias("tile"), "quality")
    long = _chars(sampled, "quality", "tile").groupBy("tile", "pos", "c").agg(F.count("*").alias("n"))
    return long.select("tile", "pos", F.least(F.ascii("c"), F.lit(QUALITY_SLOTS)).alias("q"), "n")


def tile_sample(reads: DataFrame) -> DataFrame:
    """The place first: the quality of the reads left out need not be made."""
    return reads.where(((F.col("ord_q") <= TILE_ALL) | (F.col("ord_q") % TILE_EVERY == 0)) & (F.length("quality") > 0))


def kmer_cube(reads: DataFrame, k: int) -> DataFrame:
    """kmer, pos (1-based), n over the sampled reads' first bases; k-mers with N are left out."""
    s = F.substring("sequence", 1, KMER_BASES)
    sampled = reads.where((F.col("ord_pf") % KMER_EVERY == 0) & (F.length("sequence") >= k)).select(s.alias("s"))
    long = sampled.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.length("s") - k + 1), lambda i: F.substring("s", i, F.lit(k)))).alias("pos", "kmer"))
    return long.where(~F.contains("kmer", F.lit("N"))).groupBy("kmer", (F.col("pos") + 1).alias("pos")).agg(F.count("*").alias("n"))
