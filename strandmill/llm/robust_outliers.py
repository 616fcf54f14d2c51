"""Quality rules by robust multivariate outliers.

Every document gets counts of its words, symbols, repeated lines and repeated five-word windows, and from them a vector
of five transformed statistics. For each language and source (and, where that has few documents, for the language, or
for all) a minimum-covariance-determinant estimate of location and scatter is made; a document is rejected whose squared
Mahalanobis distance from its group's estimate exceeds a chi-square bound.

The estimate takes concentration steps from two starts: keep the `coverage` share of documents nearest to the present
centre, and take their mean and covariance as the next one, until the determinant falls no further. Each step is one aggregation
into at most `BINS` distance classes a group, so that no group is ever sorted or gathered; groups that have settled take no part in
further steps. Statistics are whole thousandths, so sums are exact and reruns agree. Everything on the main path is DataFrame expressions.

A group of under `least_group` documents that pass the base rules has too few to estimate 20 numbers from, and uses its language's
estimate, or that of all. Documents meet their estimates in one join, on language and source.

Defined cases: a null text counts as no words (base_failed). Null lang and null source are groups of their own. An empty
table gives an empty result. Repeated rows each get a row, and count each; equal distances have one class, which is taken whole.
A very long text is one row like any other: its words and windows are arrays of that row. Columns other than doc_id, text, lang,
source are ignored, whatever their names, and kept by `keep`. A statistic that never varies in a group has the variance floor of
`FLOORS`, so it can't make the scatter singular.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, UPPER, join_small, text_or_empty, unused, words

SYMBOLS = "[#*$%&|<>]"
STATS = ("x0", "x1", "x2", "x3", "x4")
D = len(STATS)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
SCALE = 1000
#: Least standard deviation of each statistic, in its own (log) unit.
FLOORS = (0.08, 0.35, 0.5, 0.5, 0.35)
#: Distance classes: BINS_PER_UNIT for each unit of log squared distance, BINS in all.
BINS, BINS_PER_UNIT = 1024, 32
#: Concentration ends when no step lowers a log determinant by this much.
SETTLED = 1e-6
#: Fixed values. For 5 dimensions: the factor that makes the covariance of the nearest 75 % consistent for a normal
#: distribution; the 0.975 and the 1 - 1e-10 quantile of chi-square with 5 degrees of freedom.
CONSISTENCY_75, CHI2_5_0975, CHI2_5_FAR = 1.41, 12.83, 55.6


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each whole text, in one pass over it."""
    text = F.col("_text")
    df = docs.select("doc_id", "lang", "source", text_or_empty().alias("_text"))
    df = df.select("*", words(text).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    df = df.select(
        "doc_id", "lang", "source",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (F.length(text) - F.length(F.translate(text, UPPER + "!0123456789", ""))).cast("long").alias("n_loud"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    window = lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(5)])
    df = df.withColumn("_g", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_h") - 5, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    df = df.withColumn("_twice", F.size("_g") > F.size(F.array_distinct("_g")))
    # Sorted by hash and place, equal windows are neighbours; their places then tell how many words they cover.
    df = df.withColumn("_s", F.when(F.col("_twice"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    equal = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.when(F.col("_twice"), F.array_sort(F.transform(F.filter("_s", lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"])))).drop("_s")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("_twice"), covered).otherwise(F.lit(0).cast("long")))
    return df.drop("_p", "_twice").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _stat(value: Column) -> Column:
    return F.round(value * SCALE).cast("long")


def statistics(counts: DataFrame) -> DataFrame:
    """The counts with x0..x4: logs of rates, each drawn to a common value by 50 words' worth of it so that short texts don't stand out."""
    n = F.col("n_words") + 50
    rate = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    return counts.select(
        "*",
        _stat(F.log((F.col("word_chars") + 300.0) / n)).alias("x0"),
        _stat(rate("n_symbols", n)).alias("x1"),
        _stat(rate("n_dup_lines", F.col("n_lines") + 20)).alias("x2"),
        _stat(rate("n_repeat_words", n)).alias("x3"),
        _stat(rate("n_loud", F.col("word_chars") + 200)).alias("x4"),
    )


def _key(level: int) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return F.concat_ws("\x01", F.lit(str(level)), *[part(c) for c in ("lang", "source")[: 2 - level]])


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(STATS)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]]


def _resum() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(D)], *[f"q{i}{j}" for i, j in PAIRS])]


def _factor(sums: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Means and the Cholesky factor of the covariance, from exact sums."""
    n = F.col("n").cast("double")
    df = sums.select(*keys, "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(D)], *[(F.col(f"q{i}{j}") / n).alias(f"q{i}{j}") for i, j in PAIRS])
    cov = lambda i, j: (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency + (F.lit((FLOORS[i] * SCALE) ** 2) if i == j else 0)
    df = df.select(*keys, "n", *[f"m{i}" for i in range(D)], *[cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS])
    for j in range(D):
        below = lambda i: F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: E731, B023
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(below(j), F.lit(1e-6))))
        df = df.withColumns({f"l{i}{j}": below(i) / F.col(f"l{j}{j}") for i in range(j + 1, D)}) if j < D - 1 else df
    det = sum((F.log(f"l{j}{j}") for j in range(D)), F.lit(0.0))
    return df.select(*keys, "n", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS], det.alias("log_det"))


def _distance(df: DataFrame) -> DataFrame:
    """d2: squared Mahalanobis distance, by forward substitution."""
    for i in range(D):
        df = df.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0))).drop(*[f"z{i}" for i in range(D)])


def _quantiles(points: DataFrame, shares: dict[str, float]) -> DataFrame:
    """For each group and statistic: the least multiple of SCALE / 100 that at least that share reaches."""
    step = SCALE // 100
    long = points.select("g", F.posexplode(F.array(*STATS)).alias("dim", "x")).groupBy("g", "dim", F.floor(F.col("x") / step).alias("b")).count()
    w = Window.partitionBy("g", "dim")
    cum = long.withColumn("cum", F.sum("count").over(w.orderBy("b"))).withColumn("all", F.sum("count").over(w))
    return cum.groupBy("g", "dim").agg(*[F.min(F.when(F.col("cum") >= share * F.col("all"), F.col("b") * step)).alias(name) for name, share in shares.items()])


def _median_start(points: DataFrame) -> DataFrame:
    q = _quantiles(points, {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    one = q.groupBy("g").agg(*[F.max(F.when(F.col("dim") == i, F.col("mid"))).cast("double").alias(f"m{i}") for i in range(D)], *[F.max(F.when(F.col("dim") == i, F.col("hi") - F.col("lo"))).alias(f"r{i}") for i in range(D)])
    diag = lambda i: F.sqrt((F.col(f"r{i}") / 1.349) ** 2 + (FLOORS[i] * SCALE) ** 2)
    return one.select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(D)], *[(diag(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS])


def _bin(d2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.log(d2 + 1e-6) + 14) * BINS_PER_UNIT).cast("int")))


def estimate(points: DataFrame, scratch: Scratch, coverage: float = 0.75) -> DataFrame:
    """One row a group g: n, means m*, Cholesky factor l* of the reweighted MCD scatter. points: g, spread, x0..x4."""
    names = [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in PAIRS]
    by_start = lambda df: df.groupBy("g").agg(F.collect_list(F.struct("start", *names)).alias("centres"))  # noqa: E731  two a group at most
    classical = _factor(points.groupBy("g").agg(*_sums()), ["g"], 1.0).select("g", F.lit(1).alias("start"), *names)
    now = scratch.write(_median_start(points).unionByName(classical).withColumn("log_det", F.lit(float("inf"))).select("g", "start", *names, "log_det"))
    settled = []
    keys = ["g", "start"]
    while now.limit(1).count():
        centres = scratch.write(by_start(now))
        met = join_small(points, centres, "g", F.col("spread")).where(F.col("centres").isNotNull())
        near = met.select("g", *STATS, F.explode("centres").alias("c")).select("g", *STATS, "c.*")
        by_bin = _distance(near).withColumn("b", _bin(F.col("d2"))).groupBy(*keys, "b").agg(*_sums())
        w = Window.partitionBy(*keys)
        cum = by_bin.withColumn("_c", F.sum("n").over(w.orderBy("b"))).withColumn("_a", F.sum("n").over(w))
        nearest = cum.where(F.col("_c") - F.col("n") < coverage * F.col("_a")).groupBy(*keys).agg(*_resum())
        new = _factor(nearest, keys, CONSISTENCY_75).drop("n")
        compared = scratch.write(new.join(now.select(*keys, F.col("log_det").alias("before")), keys).withColumn("settled", F.col("log_det") > F.col("before") - SETTLED))
        settled.append(compared.where("settled").select("g", "start", *names, "log_det"))
        now = compared.where(~F.col("settled")).select("g", "start", *names, "log_det")
    if not settled:
        return scratch.write(_factor(points.groupBy("g").agg(*_sums()), ["g"], 1.0))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    best = Window.partitionBy("g").orderBy("log_det", "start")  # the start with the least determinant goes on
    centres = scratch.write(every.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("g", *names))
    # Reweighting: all that are no outliers at 0.975, not a fixed share.
    kept = _distance(join_small(points, centres, "g", F.col("spread"))).where(F.col("d2") <= CHI2_5_0975).groupBy("g").agg(*_sums())
    return scratch.write(_factor(kept, ["g"], 1.0))


def robust_outliers(docs: DataFrame, least_group: int = 50, bound: float = CHI2_5_FAR) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, distance (squared; null where no group could be estimated), group_level (0: language and source, 1: language, 2: all)."""
    scratch = Scratch(docs.sparkSession)
    names = [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in PAIRS]
    stats = scratch.write(statistics(base_counts(docs)).withColumn("g0", _key(0)))
    fit = stats.where(~F.col("base_failed")).select(F.array(_key(0), _key(1), _key(2)).alias("_g"), F.xxhash64("doc_id", *STATS).alias("spread"), *STATS)
    points = fit.select(F.explode("_g").alias("g"), "spread", *STATS)
    model = estimate(points, scratch)
    # Each language and source finds its estimate among a row a group; then documents meet the result in one join.
    groups = stats.select("lang", "source").distinct().select(*[_key(k).alias(f"g{k}") for k in range(3)])
    for level in range(3):
        own = model.where(F.col("n") >= least_group) if level < 2 else model
        groups = groups.join(own.select(F.col("g").alias(f"g{level}"), F.struct(F.lit(level).alias("group_level"), *names).alias(f"e{level}")), f"g{level}", "left")
    found = scratch.write(groups.select("g0", F.coalesce("e0", "e1", "e2").alias("e")).select("g0", "e.*"))
    df = join_small(stats, found, "g0", F.xxhash64("doc_id", *STATS))
    df = _distance(df)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= bound)).alias("kept"),
        F.col("d2").alias("distance"), "group_level",
    )


def keep(docs: DataFrame, least_group: int = 50, bound: float = CHI2_5_FAR) -> DataFrame:
    """The documents, with their own columns, that robust_outliers keeps. Rows are matched by hashes of id and text, which equal rows share."""
    key = F.xxhash64("doc_id", "lang", "source", text_or_empty())
    (name,) = unused(docs, "_key")
    named = docs.select("lang", "source", "text", key.alias("doc_id"))
    kept = robust_outliers(named, least_group, bound).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(kept, name, "left_semi").drop(name)
