"""Mixing sources to target weights by entropy balancing.

Every source has a token target. Among all document rates of at most `MOST` that meet it, those are taken that depart least, in
relative entropy, from one copy of each document. The convex dual has one multiplier a source, and its solution is the
exponentially tilted rate min(MOST, exp(lambda * size)). Newton's method finds the multipliers of all sources side by side: every
iteration is one aggregation of gradient and curvature over the numbers of documents by source and size, a table that the first pass
writes and that is never collected. A step that leaves the bracket of the root is replaced by its middle. Sums are exact decimals, so
that reruns agree.

Rates become whole copies by ordered rounding: every document has floor(rate) copies, and further ones go to documents
in order of hash / fraction until the source's tokens are nearest to its target. The threshold is found by three
histograms of 1024 classes, never by sorting a source. What documents get depends on their own row and on their source's few numbers
alone, so that no text is shuffled.

Defined cases: a null text has size 0 and gets no words, as does an empty one. A null source is a source of its own, last in order. An empty
table gives an empty result. Repeated rows are separate documents of the same rate, which share their hash; documents of one hash / fraction
are taken together or not at all. A very long text counts by its size like any other. Other columns are ignored by `mix`, and kept by `resample`,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, Scratch, columns, join_small, text_or_empty, unused

MOST = 3
LEVEL_BITS, LEVELS = 10, 3
#: Newton's method ends when every source's tokens are this near to its target, or the bracket can't be halved any more.
NEAR, STEPS = 0.25, 200
EXACT = "decimal(38,8)"


def size_of(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")).cast("long")


def key_of(source: Column) -> Column:
    """Sources as keys that a join finds equal, null too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def targets(sources: DataFrame) -> DataFrame:
    """sources: source, source_size, ... (a row each). Adds target: shares of all tokens by weights 1, 2, 3 repeating, none above MOST times its size."""
    rows = sources.withColumn("_w", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("_cap", MOST * F.col("source_size").cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_r", "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("_r", "source")
    total, weights = F.sum("source_size").over(every).cast("double"), F.sum("_w").over(every)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (weights - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_full", F.col("_r") <= level)
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(every), F.lit(0.0))
    rows = rows.withColumn("_level", F.try_divide(total - capped("_cap"), weights - capped("_w")))
    return rows.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_level")))).drop("_w", "_cap", "_r", "_full", "_level")


def multipliers(by_size: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources (key, source, source_size, target, longest, ...) with lam, the exponent of a token. by_size: key, size, n."""
    # At the upper end every document with words has all its copies, at the lower end none has any to speak of.
    ends = sources.withColumns({"lo": F.lit(-800.0), "hi": F.log(F.lit(float(MOST))), "lam": F.lit(0.0), "near": F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)})
    ends = ends.withColumn("lam", F.when(F.col("near"), F.col("hi")).otherwise(F.col("lam")))
    now = scratch.write(ends.withColumn("near", F.col("near") | (F.col("source_size") == 0)))
    rate = F.exp(F.col("lam") * F.col("size"))
    tokens = F.col("size") * F.col("n")
    exact = lambda x: F.sum(F.round(x, 8).cast(EXACT)).cast("double")
    for _ in range(STEPS):
        todo = now.where(~F.col("near"))
        if not todo.limit(1).count():
            break
        met = join_small(by_size.where("size > 0"), todo.select("key", "lam"), "key", F.col("size")).where(F.col("lam").isNotNull())
        sums = met.groupBy("key").agg(exact(tokens * F.least(F.lit(float(MOST)), rate)).alias("got"), exact(F.when(rate < MOST, tokens * F.col("size") * rate).otherwise(0.0)).alias("curve"))
        step = now.join(sums, "key", "left").withColumn("g", F.col("got") - F.col("target"))
        step = step.withColumns({"lo": F.when(F.col("g") <= 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.try_divide(F.col("g"), F.col("curve"))
        middle = (F.col("lo") + F.col("hi")) / 2
        inside = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle)
        done = F.col("near") | (F.abs("g") <= NEAR) | (middle <= F.col("lo")) | (middle >= F.col("hi"))
        step = step.withColumn("near", done).withColumn("lam", F.when(done, F.col("lam")).otherwise(inside)).drop("got", "curve", "g")
        new = scratch.write(step)
        scratch.drop_table(now)
        now = new
    return now.drop("lo", "hi", "near")


def copies(sized: DataFrame, scratch: Scratch, docs: DataFrame | None = None) -> DataFrame:
    """docs (sized itself if not given; doc_id, source, _size and any others) with _key, _source_size, _target, _rate, _copies. sized: a
    written table of doc_id, source, _size of the same rows."""
    rows = sized.select(key_of(F.col("source")).alias("key"), "source", F.col("_size").alias("size"), "doc_id")
    by_size = scratch.write(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    sources = by_size.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = scratch.write(multipliers(by_size, scratch.write(targets(sources)), scratch).select("key", "source_size", "target", "lam"))
    top = 1 << (LEVEL_BITS * LEVELS)

    def rated(df: DataFrame, key: str, size: str) -> DataFrame:
        """Adds _rate, _whole and _k: the place in the order of rounding up."""
        rate = F.when(F.col(size) == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(MOST)), F.exp(F.col("_lam") * F.col(size))))
        met = join_small(df, plan.select(F.col("key").alias(key), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("lam").alias("_lam")), key, F.xxhash64("doc_id", size))
        met = met.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate").cast("int")).drop("_lam")
        u = (F.pmod(F.xxhash64("doc_id", size, F.lit(4)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        order = F.try_divide(u, F.col("_rate") - F.col("_whole"))
        return met.withColumn("_k", F.when(order.isNull(), F.lit(top)).otherwise(F.least(F.floor(order / (1 + order) * top).cast("long"), F.lit(top - 1))))

    open_ = rated(rows, "key", "size")
    base = open_.groupBy("key").agg(F.sum(F.col("size") * F.col("_whole")).alias("got"), F.first("_target").alias("target"))
    state = scratch.write(base.select("key", (F.col("target") - F.col("got")).alias("left"), F.lit(0).cast("long").alias("prefix")))
    open_ = open_.where(F.col("_k") < top).select("key", "size", "_k", "doc_id")
    beside = lambda: join_small(open_, state, "key", F.xxhash64("doc_id", "_k"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        part = beside().where(F.shiftright("_k", shift + LEVEL_BITS) == F.shiftright("prefix", LEVEL_BITS) if level else F.lit(True))
        hist = part.groupBy("key", F.shiftright("_k", shift).alias("c")).agg(F.sum("size").alias("tokens"), F.first("left").alias("left"))
        cum = hist.withColumn("cum", F.sum("tokens").over(Window.partitionBy("key").orderBy("c")))
        # All classes that fit are taken; the first that doesn't is looked into at the next level.
        found = cum.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("cum") <= F.col("left"), F.col("cum"))), F.lit(0)).alias("fits"), F.min(F.when(F.col("cum") > F.col("left"), F.col("c"))).alias("c"), F.max("c").alias("most"))
        nxt = state.drop("prefix").join(found, "key", "left").select("key", (F.col("left") - F.coalesce("fits", F.lit(0))).alias("left"), F.coalesce("c", F.col("most") + 1, F.lit(0)).alias("c"))
        last = level == LEVELS - 1
        state = scratch.write(nxt.select("key", "left", (F.col("c") if last else F.shiftleft("c", LEVEL_BITS)).cast("long").alias("prefix")))
    # Of the class at the threshold, which has one document as a rule, all are taken if that comes nearer to the target.
    edge = beside().where(F.col("_k") == F.col("prefix")).groupBy("key").agg((F.sum("size") < 2 * F.first("left")).alias("edge"))
    state = scratch.write(state.join(edge, "key", "left").select(F.col("key").alias("_key"), F.col("prefix").alias("_t"), F.coalesce("edge", F.lit(False)).alias("_edge")))
    given = (sized if docs is None else docs).withColumn("_key", key_of(F.col("source")))
    met = join_small(rated(given, "_key", "_size"), state, "_key", F.xxhash64("doc_id", "_k"))
    more = (F.col("_k") < F.col("_t")) | ((F.col("_k") == F.col("_t")) & F.col("_edge"))
    return met.withColumn("_copies", F.col("_whole") + F.when((F.col("_k") < top) & more, 1).otherwise(0)).drop("_whole", "_k", "_t", "_edge")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies), copies, rate, source."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.write(docs.select("doc_id", "source", size_of(text_or_empty()).alias("_size")))
    return copies(sized, scratch).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"), F.col("_rate").alias("rate"), "source",
    )


def resample(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as it is taken, with their own columns. A document without words isn't taken."""
    scratch = Scratch(docs.sparkSession)
    (whole,) = unused(docs, "_document")
    sized = scratch.write(docs.select("doc_id", "source", size_of(text_or_empty()).alias("_size")))
    # The document goes along as one struct, so that its columns can have any names.
    packed = docs.select("doc_id", "source", size_of(text_or_empty()).alias("_size"), F.struct(*columns(docs)).alias(whole))
    taken = copies(sized, scratch, packed).where("_copies > 0")
    return taken.select(whole, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(f"{whole}.*")
