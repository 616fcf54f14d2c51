"""SAM text as DataFrame expressions over Spark's text scan, which splits a file into as many tasks as it has blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import original_strand, soft_clipped
from .records import FAILED, UNMAPPED


def sam_records(lines: DataFrame, mapped_only: bool = False) -> DataFrame:
    """The records of lines (value, and any others, which stay): id, sequence, quality, is_filtered. A line that is no record raises."""
    others = [c for c in lines.columns if c != "value"]
    line = F.rtrim(F.col("value"), F.lit("\r"))
    rows = lines.where((line != "") & ~line.startswith("@")).select(*others, line.alias("line"), F.split(line, "\t").alias("f"))
    broken = (F.size("f") < 11) | ~F.get("f", F.lit(1)).rlike("^[0-9]+$")
    flag = F.when(broken, F.raise_error(F.concat(F.lit("no SAM record: "), F.substring("line", 1, 100)))).otherwise(F.get("f", F.lit(1)).cast("int"))
    clean = lambda k: F.when(F.get("f", F.lit(k)) == "*", "").otherwise(F.get("f", F.lit(k)))
    rows = rows.select(*others, F.get("f", F.lit(0)).alias("id"), flag.alias("flag"), F.get("f", F.lit(5)).alias("cigar"), clean(9).alias("s"), clean(10).alias("q"))
    if mapped_only:
        # Qualities are cut where the sequence is, whatever their own number.
        like = F.rpad(F.col("q"), F.length("s"), " ")
        cut = F.when(F.length("s") == F.length("q"), soft_clipped(F.col("q"), F.col("cigar"))).otherwise(F.rtrim(soft_clipped(like, F.col("cigar"))))
        rows = rows.where(F.col("flag").bitwiseAND(UNMAPPED) == 0).withColumns({"s": soft_clipped(F.col("s"), F.col("cigar")), "q": cut})
    sequence, quality = original_strand(F.col("s"), F.col("q"), F.col("flag"))
    return rows.select(*others, "id", F.upper(sequence).alias("sequence"), quality.alias("quality"), (F.col("flag").bitwiseAND(FAILED) != 0).alias("is_filtered"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ord, ord_pf and ord_q, counted from 1 within each block of a file."""
    at: tuple | None = None
    before = np.zeros(3, np.int64)
    for b in batches:
        block = list(zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True))
        passed = ~np.array(b.column("is_filtered").to_pylist(), bool)
        quality = passed & np.array([bool(q) for q in b.column("quality").to_pylist()], bool)
        edges = [0, *[i for i in range(1, len(block)) if block[i] != block[i - 1]], len(block)]
        out: list[list] = [[], [], []]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if block[lo:hi] and block[lo] != at:
                at, before = block[lo], np.zeros(3, np.int64)
            for k, kept in enumerate((np.ones(hi - lo, bool), passed[lo:hi], quality[lo:hi])):
                place = before[k] + np.cumsum(kept)
                out[k] += [int(p) if x else None for p, x in zip(place, kept, strict=True)]
                before[k] += int(kept.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.int64()) for x in out]], [*b.schema.names, "ord", "ord_pf", "ord_q"])


def read_sam(spark: SparkSession, paths: list[str], sample: str, mapped_only: bool = False) -> DataFrame:
    """The canonical reads of files of any file system that Spark reads. Ordinals run on from block to block and file to file by a prefix sum of the blocks' counts."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    rows = sam_records(lines, mapped_only)
    numbered = rows.mapInArrow(_numbered, "path string, block long, id string, sequence string, quality string, is_filtered boolean, ord long, ord_pf long, ord_q long")
    order = F.lit(len(paths))
    for k, path in reversed(list(enumerate(paths))):
        order = F.when(F.col("path").endswith(path.rsplit("/", 1)[-1]) & F.col("path").endswith(path.removeprefix("file://")), k).otherwise(order)
    ords = ("ord", "ord_pf", "ord_q")
    counts = numbered.groupBy("path", "block").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ords]).withColumn("file_idx", order)
    before = Window.orderBy("file_idx", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = counts.select("path", "block", "file_idx", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ords])
    whole = numbered.join(F.broadcast(offsets), ["path", "block"])
    return whole.select(
        F.lit(sample).alias("sample"), F.col("file_idx").cast("int").alias("file_idx"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ords],
        "id", "sequence", "quality", "is_filtered", F.lit(None).cast("string").alias("colorspace"),
    )
