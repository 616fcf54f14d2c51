"""Records of sequence files: FASTQ (plain, gzip, bzip2), SAM, BAM and Fast5, as plain Python generators.

Each gives (id, sequence, quality, is_filtered, colorspace). A broken record raises ValueError, which fails the file.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

Record = tuple[str, str, str, bool, str | None]
COLORS = re.compile(r"^[GATCNgatcn][.0-6]+$")
STEP = {"0": "ACGT", "1": "CATG", "2": "GTAC", "3": "TGCA"}
#: Fixed values of the BAM format: the letters of its 4-bit bases and of its CIGAR operations.
BAM_BASES, BAM_CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
BAM_HEX, UP_33 = str.maketrans("0123456789abcdef", BAM_BASES), bytes((q + 33) % 256 for q in range(256))
UNMAPPED, REVERSED, FAILED = 0x4, 0x10, 0x200


def compressed(path: str) -> str:
    """gzip (any number of members) and bzip2 are told by extension or by their first bytes."""
    with open(path, "rb") as f:
        magic = f.read(2)
    if magic == b"\x1f\x8b" or path.lower().endswith(".gz"):
        return "gzip"
    return "bzip2" if magic == b"BZ" or path.lower().endswith(".bz2") else ""


def open_bytes(path: str) -> BinaryIO:
    """The decompressed stream of a path."""
    kind = compressed(path)
    return gzip.open(path, "rb") if kind == "gzip" else bz2.open(path, "rb") if kind else open(path, "rb")


def decode_colors(colors: str) -> str:
    """Bases of a colour string; N from the first colour that isn't 0 to 3 on."""
    last, out = colors[:1].upper(), []
    for c in colors[1:]:
        last = STEP[c]["ACGT".index(last)] if c in STEP and last in "ACGT" else "N"
        out.append(last)
    return "".join(out)


def fastq(stream: BinaryIO, name: str = "", casava: bool = False, nofilter: bool = False, colored: bool | None = None) -> Iterator[Record]:
    """Four lines a record; blank lines are skipped only before an id. Whether a file has colours is told by its first record, unless given."""
    lines = ((n, x.rstrip("\r\n")) for n, x in enumerate(io.TextIOWrapper(stream, encoding="utf-8", newline="\n"), 1))
    for n, read_id in lines:
        if not read_id:
            continue
        if not read_id.startswith("@"):
            raise ValueError(f"{name}: line {n} should start with @")
        rest = [next(lines, None) for _ in range(3)]
        if None in rest:
            raise ValueError(f"{name}: record at line {n} is cut short")
        (_, sequence), (m, plus), (_, quality) = rest  # type: ignore[misc]
        if not plus.startswith("+"):
            raise ValueError(f"{name}: line {m} should start with +")
        if colored is None:
            colored = bool(COLORS.match(sequence))
        bad = casava and not nofilter and read_id.find(":Y:") > 0
        yield read_id, (decode_colors(sequence) if colored else sequence).upper(), quality, bad, sequence if colored else None


def _clipped(sequence: str, quality: str, cigar: str) -> tuple[str, str]:
    if m := re.search(r"(\d+)S$", cigar):
        n = max(len(sequence) - int(m[1]), 0)
        sequence, quality = sequence[:n], quality[:n]
        cigar = cigar[: m.start()]
    if (m := re.match(r"(\d+)S", cigar)) and int(m[1]) <= len(sequence):
        sequence, quality = sequence[int(m[1]) :], quality[int(m[1]) :]
    return sequence, quality


def _aligned(read_id: str, flag: int, cigar: str, sequence: str, quality: str, mapped_only: bool) -> Record | None:
    if mapped_only:
        if flag & UNMAPPED:
            return None
        sequence, quality = _clipped(sequence, quality, cigar)
    if flag & REVERSED:
        sequence, quality = sequence[::-1].translate(str.maketrans("ACGT", "TGCA")), quality[::-1]
    return read_id, sequence.upper(), quality, bool(flag & FAILED), None


def sam(stream: BinaryIO, name: str = "", mapped_only: bool = False) -> Iterator[Record]:
    for n, line in enumerate(io.TextIOWrapper(stream, encoding="utf-8"), 1):
        line = line.rstrip("\r\n")
        if not line or line.startswith("@"):
            continue
        part = line.split("\t")
        if len(part) < 11 or not part[1].isdigit():
            raise ValueError(f"{name}: line {n} is no SAM record")
        clean = lambda x: "" if x == "*" else x
        if record := _aligned(part[0], int(part[1]), part[5], clean(part[9]), clean(part[10]), mapped_only):
            yield record


def bam(stream: BinaryIO, name: str = "", mapped_only: bool = False) -> Iterator[Record]:
    """BGZF is gzip with many members, so the stream is decompressed already."""

    def take(n: int, may_end: bool = False) -> bytes:
        data = stream.read(n)
        if len(data) < n and not (may_end and not data):
            raise ValueError(f"{name}: cut short")
        return data

    if take(4) != b"BAM\1":
        raise ValueError(f"{name}: no BAM file")
    take(struct.unpack("<i", take(4))[0])
    for _ in range(struct.unpack("<i", take(4))[0]):
        take(struct.unpack("<i", take(4))[0])
        take(4)
    while size := take(4, True):
        data = take(struct.unpack("<i", size)[0])
        _, _, name_len, _, _, n_cigar, flag, length, _, _, _ = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32 + name_len
        ops = struct.unpack_from(f"<{n_cigar}I", data, at)
        cigar = "".join(f"{x >> 4}{BAM_CIGAR[x & 15]}" for x in ops)
        at += 4 * n_cigar
        packed = data[at : at + (length + 1) // 2]
        sequence = packed.hex().translate(BAM_HEX)[:length]
        raw = data[at + len(packed) : at + len(packed) + length]
        quality = "" if raw[:1] == b"\xff" else raw.translate(UP_33).decode("latin-1")
        if record := _aligned(data[32 : at - 4 * n_cigar - 1].decode(), flag, cigar, sequence, quality, mapped_only):
            yield record


def fast5(path: str) -> Iterator[Record]:
    """Base-called reads of an HDF5 file; needs h5py. Reads without a FASTQ text are skipped; a file without any is an error."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("Fast5 files need h5py, which isn't installed") from e
    places = [f"Analyses/Basecall_{a}/BaseCalled_{b}/Fastq" for a, b in (("2D_000", "2D"), ("2D_000", "template"), ("1D_000", "template"), ("1D_000", "1D"))]
    found = 0
    with h5py.File(path, "r") as f:
        roots = [f[k] for k in f if k.startswith("read_")] or [f]
        for root in roots:
            text = next((root[p][()] for p in places if p in root), None)
            part = (text.decode() if isinstance(text, bytes) else str(text or "")).split("\n")
            if len(part) >= 4:
                found += 1
                yield part[0], part[1].strip().upper(), part[3].strip(), False, None
    if not found:
        raise ValueError(f"{path}: no base-called reads")


def records(path: str, kind: str, casava: bool = False, nofilter: bool = False) -> Iterator[Record]:
    if kind == "fast5":
        yield from fast5(path)
        return
    with open_bytes(path) as stream:
        if kind == "fastq":
            yield from fastq(stream, path, casava, nofilter)
        else:
            yield from (bam if kind.startswith("bam") else sam)(stream, path, kind.endswith("_mapped"))
