"""Basic statistics, base, N and GC content, and lengths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base_count
from .quality import encoding_name

#: The lowest quality character of reads that have none.
NO_QUALITY = 126


def basic_stats(reads: DataFrame) -> DataFrame:
    """One row: total and filtered reads, bases, lengths, %GC, lowest character, encoding. Filtered reads count only as such."""
    ok = ~F.col("is_filtered")
    n = lambda b: F.sum(F.when(ok, base_count(F.col("sequence"), b))).alias(b)
    lowest = F.when(F.length("quality") > 0, F.ascii(F.array_min(F.split("quality", ""))))
    one = reads.agg(
        F.count_if(ok).alias("total_sequences"), F.count_if(~ok).alias("filtered_sequences"),
        F.coalesce(F.sum(F.when(ok, F.length("sequence"))), F.lit(0)).alias("total_bases"),
        F.coalesce(F.min(F.when(ok, F.length("sequence"))), F.lit(0)).alias("min_length"), F.coalesce(F.max(F.when(ok, F.length("sequence"))), F.lit(0)).alias("max_length"),
        n("G"), n("C"), n("A"), n("T"), F.least(F.lit(NO_QUALITY), F.coalesce(F.min(F.when(ok, lowest)), F.lit(NO_QUALITY))).alias("lowest_char"),
    )
    gc, acgt = F.col("G") + F.col("C"), F.col("A") + F.col("C") + F.col("G") + F.col("T")
    return one.select(
        "total_sequences", "filtered_sequences", "total_bases", "min_length", "max_length",
        F.when(acgt > 0, F.floor(gc * 100 / acgt)).otherwise(0).cast("long").alias("gc_percent"), "lowest_char", encoding_name(F.col("lowest_char")).alias("encoding"),
    )


def _by_group(cube: DataFrame, positions: DataFrame, *sums: str) -> DataFrame:
    when = {"G": "G", "A": "A", "T": "T", "C": "C", "N": "N"}
    cols = [F.coalesce(F.sum(F.when(F.col("base") == when[b], F.col("n"))), F.lit(0)).alias(f"n_{b}") for b in sums]
    return F.broadcast(positions).join(cube, "pos", "left").groupBy("grp", F.col("label").alias("label")).agg(*cols, F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))


def per_base_content(cube: DataFrame, positions: DataFrame) -> DataFrame:
    """grp, base (label), g, a, t, c: percent of the group's A, C, G and T."""
    counts = _by_group(cube, positions, "G", "A", "T", "C")
    total = F.col("n_G") + F.col("n_A") + F.col("n_T") + F.col("n_C")
    return counts.select("grp", F.col("label").alias("base"), *[(F.coalesce(F.try_divide(F.col(f"n_{b}").cast("double"), total), F.lit(0.0)) * 100).alias(b.lower()) for b in "GATC"])


def per_base_n(cube: DataFrame, positions: DataFrame) -> DataFrame:
    """grp, base, n_percent."""
    counts = _by_group(cube, positions, "N")
    return counts.select("grp", F.col("label").alias("base"), F.coalesce(F.try_divide(100.0 * F.col("n_N"), F.col("n_all")), F.lit(0.0)).alias("n_percent"))


def _bins(frame: DataFrame) -> DataFrame:
    """frame (tlen, gc, ...) with every percent bin that the count claims: those that its interval of half a count each way rounds to."""
    edge = lambda p: F.floor((p * 100 + F.col("tlen")) / (2 * F.col("tlen"))).cast("int")
    lo = F.when(F.col("gc") == 0, 0).otherwise(edge(2 * F.col("gc").cast("long") - 1))
    hi = F.when(F.col("gc") == F.col("tlen"), 100).otherwise(edge(2 * F.col("gc").cast("long") + 1))
    return frame.withColumn("bin", F.explode(F.sequence(lo, hi)))


def gc_distribution(cube: DataFrame) -> DataFrame:
    """bin (0..100), n: each read adds 1 / (counts of its length that claim the bin) to every bin it claims."""
    rows = cube.where("tlen > 0").groupBy("tlen", "gc").agg(F.sum("n").alias("n"))
    # A length's counts as one map, at most tlen + 1 entries, so that the cube is read once for the claims and the reads.
    by_length = rows.groupBy("tlen").agg(F.map_from_entries(F.collect_list(F.struct("gc", "n"))).alias("found"))
    model = by_length.select("tlen", "found", F.explode(F.sequence(F.lit(0), F.col("tlen"))).alias("gc")).select("tlen", "gc", F.coalesce(F.try_element_at("found", F.col("gc")), F.lit(0)).alias("n"))
    claims = _bins(model).groupBy("tlen", "bin").agg(F.count("*").alias("claims"), F.sum("n").alias("n"))
    got = claims.groupBy("bin").agg(F.sum(F.col("n") / F.col("claims")).alias("n"))
    axis = cube.sparkSession.range(101).select(F.col("id").cast("int").alias("bin"))
    return axis.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0.0)).alias("n"))


def length_plan(lo: int, hi: int, nogroup: bool = False) -> tuple[int, int, int]:
    """(first start, width, bins): the least width of 1, 2, 5, 10, ... with at most 50 steps, aligned; one bin of padding at either end."""
    lo, hi = max(lo - 1, 0), hi + 1
    if nogroup:
        return lo, 1, hi - lo + 1
    width = next(w for n in count() for w in (10**n, 2 * 10**n, 5 * 10**n) if (hi - lo) // w <= 50)
    start = lo // width * width
    return start, width, (hi - start) // width + 1


def length_distribution(cube: DataFrame, nogroup: bool = False) -> DataFrame:
    """lo, hi (bounds of the bin), label, n: empty first and last bins are left out."""
    counts = cube.groupBy("len").agg(F.sum("n").alias("n"))
    ends = counts.agg(F.min("len"), F.max("len")).first()
    spark = cube.sparkSession
    if ends[0] is None:
        return spark.createDataFrame([], "lo int, hi int, label string, n long")
    start, width, bins = length_plan(ends[0], ends[1], nogroup)
    got = counts.groupBy(F.floor((F.col("len") - start) / width).cast("int").alias("i")).agg(F.sum("n").alias("n"))
    axis = spark.range(bins).select(F.col("id").cast("int").alias("i"))
    dense = axis.join(got, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n")).where(f"not (n = 0 and (i = 0 or i = {bins - 1}))")
    lo = F.lit(start) + F.col("i") * width
    hi = F.least(lo + (width - 1), F.lit(ends[1] + 1))
    text = lo.cast("string") if width == 1 else F.concat_ws("-", lo.cast("string"), hi.cast("string"))
    return dense.select(lo.alias("lo"), hi.alias("hi"), text.alias("label"), "n")
