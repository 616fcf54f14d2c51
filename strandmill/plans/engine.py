"""The whole analysis of one sample: shared cubes, module tables, verdicts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions.contaminants import possible_source
from ..functions.stats import base_total, double_text, gc_summary
from ..operators import composition, duplication, motifs, quality, verdicts
from ..reads import passed
from . import cubes
from .groups import base_groups, position_frame

#: Formats whose qualities are known to be Phred+33.
KNOWN_OFFSET = 33


@dataclass
class Module:
    name: str
    key: str
    status: str
    header: list[str]
    rows: list[list]
    hidden: bool = False
    lead: list[tuple[str, str]] = field(default_factory=list)
    data: dict = field(default_factory=dict)
    #: Hooks of further modules: (image name, SVG), the text of its section, and the HTML of its card, in place of the usual ones.
    chart: Callable[[], tuple[str, str] | None] | None = None
    text: Callable[[], str] | None = None
    html: Callable[[], str] | None = None


@dataclass
class QcResult:
    filename: str
    modules: list[Module]

    def table(self, name: str) -> Module:
        return next(m for m in self.modules if m.name == name)

    def status(self) -> dict[str, str]:
        return {m.name: m.status for m in self.modules if not m.hidden}


Build = Callable[[DataFrame, QcConfig], Module]
#: Further modules: functions from (reads, config) to a Module, and whether they see filtered reads too.
CUSTOM: list[tuple[Build, bool]] = []


def register_module(f: Build, filtered_too: bool = False) -> Build:
    CUSTOM.append((f, filtered_too))
    return f


def float_text(x: float) -> str:
    """Shortest single-precision digits, never with an exponent."""
    return np.format_float_positional(np.float32(x), unique=True, trim="-")


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]


def analyze(reads: DataFrame, cfg: QcConfig | None = None, filename: str = "reads", known_offset: int | None = None, colorspace: bool = False) -> QcResult:
    """All modules of one sample. Result tables are a few thousand rows at most, and are collected; the cubes are not."""
    cfg = cfg or QcConfig()
    limits, spark = cfg.limits, reads.sparkSession
    ok = passed(reads)
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    def positions(length: int) -> DataFrame:
        return position_frame(spark, base_groups(length, cfg.min_length, cfg.nogroup, cfg.expgroup))

    out: list[Module] = []
    basic = composition.basic_stats(reads).first()
    total = basic.total_sequences
    lengths = str(basic.min_length) if basic.min_length == basic.max_length else f"{basic.min_length}-{basic.max_length}"
    encoding = "Sanger / Illumina 1.9" if known_offset == KNOWN_OFFSET else basic.encoding
    out.append(
        Module(
            "Basic Statistics", "basic", "pass", ["Measure", "Value"],
            [["Filename", filename], ["File type", "Colorspace converted to bases" if colorspace else "Conventional base calls"], ["Encoding", encoding], ["Total Sequences", str(total)],
             ["Total Bases", base_total(basic.total_bases)], ["Sequences flagged as poor quality", str(basic.filtered_sequences)], ["Sequence length", lengths], ["%GC", str(basic.gc_percent)]],
        )
    )
    offset = known_offset or (64 if 64 <= basic.lowest_char <= 126 else 33)

    if limits.enabled("quality_base"):
        cube = keep(cubes.quality_cube(ok))
        longest, top = cube.agg(F.max("pos"), F.max("q")).first()
        rows = _rows(quality.per_base_quality(cube, positions(longest or 0), offset), "grp") if longest else []
        out.append(
            Module("Per base sequence quality", "quality_base", verdicts.base_quality(rows, limits), ["Base", "Mean", "Median", "Lower Quartile", "Upper Quartile", "10th Percentile", "90th Percentile"],
                   [[r["base"], *[double_text(r[c]) for c in ("mean", "median", "lower_quartile", "upper_quartile", "p10", "p90")]] for r in rows], not longest, data={"rows": rows, "encoding": encoding, "top": (top or 0) - offset})
        )
    if limits.enabled("tile"):
        out.append(_tiles(ok, cfg, offset, positions))
    readcube = keep(cubes.read_cube(ok))
    if limits.enabled("quality_sequence"):
        frame = quality.per_sequence_quality(readcube, offset)
        rows = _rows(frame, "quality")
        mode = max(rows, key=lambda r: (r["n"], -r["quality"]))["quality"] if rows else None
        out.append(Module("Per sequence quality scores", "quality_sequence", verdicts.sequence_quality(mode, limits), ["Quality", "Count"], [[str(r["quality"]), double_text(float(r["n"]))] for r in rows], not rows, data={"rows": rows}))
    basecube = keep(cubes.base_cube(ok)) if limits.enabled("sequence") or limits.enabled("n_content") else None
    if limits.enabled("sequence"):
        rows = _rows(composition.per_base_content(basecube, positions(basic.max_length)), "grp") if basic.max_length else []
        out.append(Module("Per base sequence content", "sequence", verdicts.base_content(rows, limits), ["Base", "G", "A", "T", "C"], [[r["base"], *[double_text(r[b]) for b in "gatc"]] for r in rows], data={"rows": rows}))
    if limits.enabled("gc_sequence"):
        bins = [r["n"] for r in _rows(composition.gc_distribution(readcube), "bin")]
        _mode, _stdev, deviation, curve = gc_summary(bins)
        out.append(Module("Per sequence GC content", "gc_sequence", verdicts.gc_content(deviation, limits), ["GC Content", "Count"], [[str(k), double_text(n)] for k, n in enumerate(bins)], data={"bins": bins, "curve": curve}))
    if limits.enabled("n_content"):
        rows = _rows(composition.per_base_n(basecube, positions(basic.max_length)), "grp") if basic.max_length else []
        out.append(Module("Per base N content", "n_content", verdicts.n_content(rows, limits), ["Base", "N-Count"], [[r["base"], double_text(r["n_percent"])] for r in rows], data={"rows": rows}))
    if limits.enabled("sequence_length"):
        rows = _rows(composition.length_distribution(readcube, cfg.nogroup), "lo")
        # The verdict asks whether there is an empty read, and whether there are several lengths.
        found = sorted({n for n in readcube.agg(F.min("len"), F.max("len")).first() if n is not None})
        if 0 not in found and basic.min_length == 0 and total:
            found.append(0)
        out.append(Module("Sequence Length Distribution", "sequence_length", verdicts.length_distribution(found, limits), ["Length", "Count"], [[r["label"], double_text(float(r["n"]))] for r in rows], data={"rows": rows}))
    # Without the overrepresented module nothing fills the shared duplicates, and the duplication module reports an empty table.
    dup = keep(cubes.duplicate_cube(ok if limits.enabled("overrepresented") else ok.limit(0), cfg.dup_length)) if limits.enabled("overrepresented") or limits.enabled("duplication") else None
    if limits.enabled("duplication"):
        rows = _rows(duplication.duplication_levels(dup, total, cfg.unique_limit), "slot")
        left = rows[0]["deduplicated"]
        out.append(Module("Sequence Duplication Levels", "duplication", verdicts.duplication(left, limits), ["Duplication Level", "Percentage of total"], [[r["level"], double_text(r["percent"])] for r in rows], lead=[("Total Deduplicated Percentage", double_text(left))], data={"rows": rows, "left": left}))
    if limits.enabled("overrepresented"):
        frame = duplication.overrepresented(dup, total, cfg.unique_limit, limits.get("overrepresented", "warn", 0.1))
        rows = [r.asDict() for r in frame.withColumn("source", possible_source(F.col("prefix"), cfg.contaminants)).orderBy(F.desc("n"), "prefix").collect()]
        out.append(Module("Overrepresented sequences", "overrepresented", verdicts.overrepresented(rows, limits), ["Sequence", "Count", "Percentage", "Possible Source"] if rows else [], [[r["prefix"], str(r["n"]), double_text(r["percent"]), r["source"]] for r in rows], data={"rows": rows}))
    if limits.enabled("adapter"):
        out.append(_adapters(ok, cfg, total, basic.max_length, positions))
    if limits.enabled("kmer"):
        cube = keep(cubes.kmer_cube(ok, cfg.kmer_size))
        longest = motifs.sampled_longest(ok).first().longest
        axis = positions(max(longest - cfg.kmer_size + 1, 0))
        rows = [r.asDict() for r in motifs.top_kmers(motifs.kmer_enrichment(cube, axis, cfg.kmer_size), axis).collect()]
        hidden = ("kmer", "ignore") not in limits.values
        out.append(Module("Kmer Content", "kmer", verdicts.kmer_content(rows, limits), ["Sequence", "Count", "PValue", "Obs/Exp Max", "Max Obs/Exp Position"] if rows else [], [[r["kmer"], str(r["count"]), float_text(r["p"]), float_text(r["max_obs_exp"]), r["position"]] for r in rows], hidden, data={"rows": rows}))
    out += [f(reads if filtered_too else ok, cfg) for f, filtered_too in CUSTOM]
    for df in held:
        df.unpersist()
    return QcResult(filename, out)


def _tiles(ok: DataFrame, cfg: QcConfig, offset: int, positions: Callable[[int], DataFrame]) -> Module:
    """Hidden where the first sampled id has no tile, a sampled tile is no number, or there are too many tiles."""
    name, header = "Per tile sequence quality", ["Tile", "Base", "Mean"]
    sampled = cubes.tile_sample(ok)
    first = sampled.agg(F.min_by("id", "ord").alias("id")).first().id
    fields = len(first.split(":")) if first else 0
    place = 4 if fields >= 7 else 2 if fields >= 5 else None
    if place is None:
        return Module(name, "tile", "pass", header, [], True)
    tile = F.get(F.split("id", ":"), place)
    bad = sampled.agg(F.count_if(~F.coalesce(tile.rlike(r"^[+-]?[0-9]+$"), F.lit(False)))).first()[0]
    if bad:
        return Module(name, "tile", "pass", header, [], True)
    cube = cubes.tile_cube(ok, place).persist()
    tiles, longest = cube.agg(F.count_distinct("tile"), F.max("pos")).first()
    rows = _rows(quality.per_tile_quality(cube, positions(longest or 0), offset), "tile", "grp") if tiles and tiles <= quality.MOST_TILES + 1 else []
    cube.unpersist()
    return Module(name, "tile", verdicts.tile_quality(rows, cfg.limits), header, [[str(r["tile"]), r["base"], double_text(r["deviation"])] for r in rows], not rows, data={"rows": rows, "most": cfg.limits.get("tile", "error", 10)})


def _adapters(ok: DataFrame, cfg: QcConfig, total: int, longest_read: int, positions: Callable[[int], DataFrame]) -> Module:
    longest = max((len(a) for _, a in cfg.adapters), default=0)
    seen = longest_read if longest_read > longest else 0
    axis = motifs.adapter_axis(longest_read, cfg.adapters)
    rows = _rows(motifs.adapter_content(motifs.adapter_hits(ok, cfg.adapters), positions(axis), cfg.adapters, total, axis), "grp", "adapter")
    by_group: dict[int, list] = {}
    for r in rows:
        by_group.setdefault(r["grp"], [r["position"]]).append(double_text(r["percent"]))
    status = verdicts.adapter_content(rows, seen, longest, cfg.limits)
    return Module("Adapter Content", "adapter", status, ["Position", *[n for n, _ in cfg.adapters]], list(by_group.values()), data={"rows": rows})


def output_name(path: str) -> str:
    """The base of a sample's output files: known endings are cut, each once, in this order."""
    for end in (".gz", ".bz2", ".txt", ".fastq", ".fq", ".csfastq", ".sam", ".bam", ".ubam", ".fast5"):
        path = re.sub(re.escape(end) + "$", "", path)
    return path
