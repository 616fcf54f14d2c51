"""Reads from files, as the canonical relation: a Python data source with a partition a file, or a part of a plain FASTQ file; SAM goes through
Spark's own text scan."""

from __future__ import annotations

import io
import os
import re
import shutil
import sys
import tempfile
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import QcConfig
from ..reads import SCHEMA
from .records import Record, compressed, fastq, records
from .sam import read_sam

BATCH, SPLIT = 10_000, 1 << 26
ARROW = pa.schema([("sample", pa.string()), ("file_idx", pa.int32()), ("ord", pa.int64()), ("ord_pf", pa.int64()), ("ord_q", pa.int64()), ("id", pa.string()), ("sequence", pa.string()), ("quality", pa.string()), ("is_filtered", pa.bool_()), ("colorspace", pa.string()), ("part", pa.int32())])


def file_kind(path: str, given: str | None = None) -> str:
    """The format that is asked for, else by extension; FASTQ if nothing else fits."""
    if given:
        return given
    low = path.lower()
    return next((kind for end, kind in ((".ubam", "bam"), (".bam", "bam"), (".sam", "sam"), (".fast5", "fast5")) if low.endswith(end)), "fastq")


def casava_name(path: str) -> str:
    """The name without the number of the file within its sample: ..._001.fastq.gz -> ....fastq.gz."""
    return re.sub(r"_[0-9]{3}(\.fastq(?:\.gz)?)$", r"\1", os.path.basename(path))


def nanopore_name(path: str) -> str:
    return "_".join(os.path.basename(path).split("_")[:3])


def expand(paths: list[str], nano: bool = False) -> list[str]:
    """With nano, folders stand for all Fast5 files in them, in order."""
    out: list[str] = []
    for path in paths:
        if nano and os.path.isdir(path):
            out += sorted(os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.lower().endswith(".fast5"))
        else:
            out.append(path)
    return out


def spooled(path: str, stream: BinaryIO | None = None) -> str:
    """Standard input (a path that starts with stdin) as a file, which the tasks can read as they can't the driver's input; other paths as they are."""
    if not path.startswith("stdin"):
        return path
    # The file is the driver's own, so its input can be read only where tasks run on the driver's machine.
    with tempfile.NamedTemporaryFile(prefix="stdin-", suffix=".fastq", delete=False) as f:
        shutil.copyfileobj(stream or sys.stdin.buffer, f)
    return f.name


def grouped(paths: list[str], casava: bool = False) -> list[tuple[str, list[str]]]:
    """(sample, files) in order of first sight: with casava, files of one sample together, else each by itself."""
    if not casava:
        return [(os.path.basename(p), [p]) for p in paths]
    found: dict[str, list[str]] = {}
    for p in paths:
        found.setdefault(casava_name(p), []).append(p)
    return list(found.items())


class _Part(InputPartition):
    """A file, or the records of it that start in a range of its bytes."""

    def __init__(self, idx: int, path: str, part: int = 0, start: int = 0, end: int | None = None):
        super().__init__((idx, part))
        self.idx, self.path, self.part, self.start, self.end = idx, path, part, start, end


def record_start(f: BinaryIO, at: int) -> int:
    """Where the first FASTQ record begins at or after a byte of an open file: at a line with @ whose second next has +, which can't
    be a quality line with @, as behind that comes an id or blank lines and then a sequence."""
    if at <= 0:
        return 0
    f.seek(at - 1)
    f.readline()
    places, lines = [], []
    while len(lines) < 3 or not (lines[-3][:1] == b"@" and lines[-1][:1] == b"+"):
        places.append(f.tell())
        lines.append(f.readline())
        if not lines[-1]:
            return places[-1]
        if len(lines) > 12 and all(x.strip() for x in lines[-12:]):
            raise ValueError(f"no FASTQ record found behind byte {at}")
    return places[-3]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        size = int(self.options["split"])
        for k, path in enumerate(self.options["paths"].split("\n")):
            n = os.path.getsize(path) if self.options["kind"] == "fastq" and not compressed(path) else 0
            cuts = list(range(0, n, size))
            out += [_Part(k, path, j, at, at + size) for j, at in enumerate(cuts)] if len(cuts) > 1 else [_Part(k, path)]
        return out

    @staticmethod
    def _some(part: _Part, casava: bool, nofilter: bool) -> Iterator[Record]:
        with open(part.path, "rb") as f:
            first, past = (record_start(f, x) for x in (part.start, part.end))
            f.seek(0)
            colored = next((r[4] is not None for r in fastq(f, part.path)), False)  # told by the file's first record
        with open(part.path, "rb") as f:
            f.seek(first)
            data = f.read(max(past - first, 0))
        yield from fastq(io.BytesIO(data), f"{part.path} from byte {first}", casava, nofilter, colored)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        sample, kind = self.options["sample"], self.options["kind"]
        flag = lambda name: self.options.get(name, "false").lower() == "true"
        rows = records(partition.path, kind, flag("casava"), flag("nofilter")) if partition.end is None else self._some(partition, flag("casava"), flag("nofilter"))
        n = passed = with_quality = 0
        while part := list(islice(rows, BATCH)):
            ords: list[list[int | None]] = [[], [], []]
            for _, _, quality, filtered, _ in part:
                n += 1
                passed += not filtered
                with_quality += bool(not filtered and quality)
                for out, value in zip(ords, (n, None if filtered else passed, None if filtered or not quality else with_quality), strict=True):
                    out.append(value)
            cols = [list(c) for c in zip(*part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip([[sample] * len(part), [partition.idx] * len(part), *ords, *cols, [partition.part] * len(part)], ARROW, strict=True)], schema=ARROW)


class ReadsSource(DataSource):
    """format("sequencing_reads"), options paths (a line each), sample, kind, casava, nofilter."""

    @classmethod
    def name(cls) -> str:
        return "sequencing_reads"

    def schema(self) -> str:
        return SCHEMA + ", part int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_sequences(spark: SparkSession, paths: list[str], cfg: QcConfig | None = None, sample: str | None = None, split: int = SPLIT) -> DataFrame:
    """One sample's files, in order. Ordinals run on from partition to partition by a prefix sum of their counts. split: bytes of a plain FASTQ file that a task reads."""
    cfg = cfg or QcConfig()
    spark.dataSource.register(ReadsSource)
    kinds = {file_kind(p, cfg.format) for p in paths}
    if len(kinds) != 1:
        raise ValueError("files of one sample must have one format")
    kind = kinds.pop()
    if kind.startswith("sam"):
        return read_sam(spark, paths, sample or os.path.basename(paths[0]), kind.endswith("_mapped"))
    options = {"paths": "\n".join(paths), "sample": sample or os.path.basename(paths[0]), "kind": kind, "casava": str(cfg.casava), "nofilter": str(cfg.nofilter), "split": str(split)}
    df = spark.read.format("sequencing_reads").options(**options).load()
    if len(_Reader(options).partitions()) == 1:
        return df.drop("part")
    ords = ("ord", "ord_pf", "ord_q")
    counts = df.groupBy("file_idx", "part").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ords])
    before = Window.orderBy("file_idx", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("file_idx", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ords])
    whole = df.join(F.broadcast(offsets), ["file_idx", "part"])
    return whole.select([(F.col(c) + F.col(f"_{c}")).alias(c) if c in ords else F.col(c) for c in df.columns if c != "part"])
