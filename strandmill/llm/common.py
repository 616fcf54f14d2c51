"""What the training-data operators share: table reading, the word rule, and tables written to shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and \t..\r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A joined table of so many rows at most is broadcast; its rows are a key and a few numbers.
BROADCAST_ROWS = 20_000
#: A key that over one in so many rows has is a hot one.
HOT = 1000

_local_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. A scan of fewer partitions than cores (a small table in one row group) is dealt over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    return F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of `names` that no column of df has, in any case of letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def columns(df: DataFrame, of: str = "") -> list[Column]:
    """Its columns, whatever signs their names hold. of: an alias."""
    return [F.col(of + "`" + c.replace("`", "``") + "`") for c in df.columns]


def join_small(rows: DataFrame, small: DataFrame, key: str, spread_by: Column) -> DataFrame:
    """rows left-joined with small, which has a row at most for each value of `key`.

    A table of at most BROADCAST_ROWS rows (that is counted, not assumed) is broadcast. A larger one meets the rows on (key, salt), the
    salt being a hash of `spread_by`, so that one key with a third of all rows is spread over as many tasks as there are shuffle partitions."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, "left")
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (salt,) = unused(rows, "_salt")
    dealt = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).join(dealt, [key, salt], "left").drop(salt)


def join_hot(rows: DataFrame, named: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with named, which has a row for each value of the keys, and in n how many rows have it. Values that over 1 / HOT of
    all rows have, of which there can't be more than HOT, are broadcast, so that no task gets all rows of one; the others meet by shuffle."""
    total = named.agg(F.sum("n")).first()[0] or 0
    others = [c for c in named.columns if c not in keys and c != "n"]
    hot = named.where(F.col("n") * HOT > total).select(*keys, F.struct(*others).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    at_once = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in others])
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(named.drop("n"), keys, how)
    return rest.select(*rows.columns, *others).unionByName(at_once)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local temporary one only where that is unset and all runs in one process, as in tests."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="strandmill-"))
    return f"file://{_local_dir[0]}"


def partition_keys(n: int) -> np.ndarray:
    """n integers that repartition(n, key) deals to n different partitions (Spark's Murmur3 of an int, seed 42), so that no task gets several buckets."""
    found, start = np.full(n, -1, np.int64), 0
    while (missing := found < 0).any():
        x = np.arange(start, start + 4 * n + 16, dtype=np.uint32)
        start += len(x)
        rotate = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
        with np.errstate(over="ignore"):
            h = rotate(np.uint32(42) ^ rotate(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(4)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
            h ^= h >> np.uint32(16)
        place = h.view(np.int32).astype(np.int64) % n
        first, at = np.unique(place, return_index=True)
        new = missing[first]
        found[first[new]] = x[at[new]]
    return found


#: Spark's setting that removes the shuffle files of an execution when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to shared storage to cut lineage: a lost executor rereads them instead of redoing the work before them. As they are
    not made again, what was shuffled to write one goes at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/strandmill-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop)

    def write(self, df: DataFrame) -> DataFrame:
        """Write df now, and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(REMOVE_SHUFFLES, None)
        self.spark.conf.set(REMOVE_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(REMOVE_SHUFFLES)
            else:
                self.spark.conf.set(REMOVE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        """Delete everything written, or one table; failures are left to the cluster's own clean-up."""
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path or self.root)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
            pass

    def drop_table(self, df: DataFrame) -> None:
        """Delete one table that write() returned, when nothing reads it any more."""
        for file in df.inputFiles()[:1]:
            self.drop(file.rsplit("/", 1)[0])
