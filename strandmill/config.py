"""Options, limits, adapters and contaminants."""

from __future__ import annotations

from dataclasses import dataclass, field

from .known import CONTAMINANTS

#: The limits in force where a limits file gives no others.
DEFAULT_LIMITS = """
duplication ignore 0
kmer ignore 1
n_content ignore 0
overrepresented ignore 0
quality_base ignore 0
sequence ignore 0
gc_sequence ignore 0
quality_sequence ignore 0
tile ignore 0
sequence_length ignore 0
adapter ignore 0
duplication warn 70
duplication error 50
kmer warn 2
kmer error 5
n_content warn 5
n_content error 20
overrepresented warn 0.1
overrepresented error 1
quality_base_lower warn 10
quality_base_lower error 5
quality_base_median warn 25
quality_base_median error 20
sequence warn 10
sequence error 20
gc_sequence warn 15
gc_sequence error 30
quality_sequence warn 27
quality_sequence error 20
tile warn 5
tile error 10
sequence_length warn 1
sequence_length error 1
adapter warn 5
adapter error 10
"""
#: The usual adapters.
DEFAULT_ADAPTERS = [
    ("Illumina Universal Adapter", "AGATCGGAAGAG"),
    ("Illumina Small RNA 3' Adapter", "TGGAATTCTCGG"),
    ("Illumina Small RNA 5' Adapter", "GATCGTCGGACT"),
    ("Nextera Transposase Sequence", "CTGTCTCTTATA"),
    ("PolyA", "AAAAAAAAAAAA"),
    ("PolyG", "GGGGGGGGGGGG"),
]


class Limits:
    """(module, level) -> number. Lines: module level value; blank lines, lines with #, short lines and bad numbers are skipped."""

    def __init__(self, text: str = DEFAULT_LIMITS):
        self.values: dict[tuple[str, str], float] = {}
        for line in text.splitlines():
            parts = line.split()
            if len(parts) >= 3 and not parts[0].startswith("#"):
                try:
                    self.values[parts[0], parts[1]] = float(parts[2])
                except ValueError:
                    continue

    def get(self, module: str, level: str, fallback: float = 0.0) -> float:
        return self.values.get((module, level), fallback)

    def enabled(self, module: str) -> bool:
        return self.get(module, "ignore") == 0


def read_pairs(text: str) -> list[tuple[str, str]]:
    """name<TAB>sequence lines; blank lines and lines with # are skipped."""
    out = []
    for line in text.splitlines():
        name, tab, sequence = line.strip().partition("\t")
        if name and tab and not name.startswith("#") and sequence.strip():
            out.append((name.strip(), sequence.strip().upper()))
    return out


@dataclass
class QcConfig:
    casava: bool = False
    nofilter: bool = False
    nano: bool = False
    nogroup: bool = False
    expgroup: bool = False
    format: str | None = None
    min_length: int = 0
    dup_length: int = 0
    kmer_size: int = 7
    outdir: str | None = None
    extract: bool = False
    delete: bool = False
    svg: bool = False
    template: str = "modern"
    unique_limit: int = 100_000
    limits: Limits = field(default_factory=Limits)
    adapters: list[tuple[str, str]] = field(default_factory=lambda: list(DEFAULT_ADAPTERS))
    contaminants: list[tuple[str, str]] = field(default_factory=lambda: read_pairs(CONTAMINANTS))

    def __post_init__(self) -> None:
        if not 2 <= self.kmer_size <= 10:
            raise ValueError("k-mer size must be between 2 and 10")
        if self.format not in (None, "fastq", "bam", "sam", "bam_mapped", "sam_mapped", "fast5"):
            raise ValueError(f"unknown format {self.format}")
