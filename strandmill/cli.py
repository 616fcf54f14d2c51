"""strandmill FILE...: quality reports of sequence files. A failed sample doesn't stop the others; the exit code is then 1."""

from __future__ import annotations

import argparse
import os
import sys

from .config import DEFAULT_LIMITS, Limits, QcConfig, read_pairs
from .plans.engine import analyze
from .report.bundle import TEMPLATES, write
from .session import session
from .sources.files import expand, file_kind, grouped, read_sequences, spooled


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def parse(argv: list[str]) -> tuple[argparse.Namespace, QcConfig]:
    p = argparse.ArgumentParser(prog="strandmill", description=__doc__)
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--outdir")
    p.add_argument("-f", "--format", choices=["fastq", "bam", "sam", "bam_mapped", "sam_mapped", "fast5"])
    for flag in ("casava", "nano", "nofilter", "nogroup", "expgroup", "extract", "delete", "svg", "quiet"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--min_length", type=int, default=0)
    p.add_argument("--dup_length", type=int, default=0)
    p.add_argument("-k", "--kmers", type=int, default=7)
    p.add_argument("-c", "--contaminants")
    p.add_argument("-a", "--adapters")
    p.add_argument("-l", "--limits")
    p.add_argument("-t", "--threads", type=int, default=0)
    p.add_argument("--template", choices=sorted(TEMPLATES), default="modern")
    p.add_argument("-d", "--dir", help="accepted, not used")
    a = p.parse_args(argv)
    if a.outdir and not os.path.isdir(a.outdir):
        p.error(f"{a.outdir} is no folder")
    if not 2 <= a.kmers <= 10:
        p.error("k-mer size must be between 2 and 10")
    cfg = QcConfig(
        casava=a.casava, nofilter=a.nofilter, nano=a.nano, nogroup=a.nogroup, expgroup=a.expgroup, format=a.format, min_length=a.min_length, dup_length=a.dup_length,
        kmer_size=a.kmers, outdir=a.outdir, extract=a.extract, delete=a.delete, svg=a.svg, template=a.template, limits=Limits(_text(a.limits) if a.limits else DEFAULT_LIMITS),
    )
    if a.adapters:
        cfg.adapters = read_pairs(_text(a.adapters))
    if a.contaminants:
        cfg.contaminants = read_pairs(_text(a.contaminants))
    return a, cfg


def main(argv: list[str] | None = None) -> int:
    a, cfg = parse(sys.argv[1:] if argv is None else argv)
    spark = session(f"local[{a.threads}]" if a.threads else None)
    failed = 0
    for name, paths in grouped(expand(a.files, cfg.nano), cfg.casava):
        try:
            if missing := [p for p in paths if not p.startswith("stdin") and not os.path.exists(p)]:
                raise FileNotFoundError(", ".join(missing))
            kind = file_kind(paths[0], cfg.format)
            reads = read_sequences(spark, [spooled(p) for p in paths], cfg, name).persist()
            colors = reads.where("colorspace is not null").limit(1).count() > 0
            result = analyze(reads, cfg, name, 33 if kind.startswith(("sam", "bam")) else None, colors)
            write(result, os.path.join(os.path.dirname(paths[0]), name), cfg.outdir, cfg.template, cfg.extract, cfg.delete)
            reads.unpersist()
            if not a.quiet:
                print(f"{name}: done")
        except Exception as e:  # noqa: BLE001  the other samples go on
            failed += 1
            print(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
