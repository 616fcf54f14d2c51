"""Scalar functions on reads, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def _without(s: Column, letter: str) -> Column:
    """By bytes; translate() looks each character up in a map."""
    return F.replace(s, F.lit(letter), F.lit(""))


def gc_count(s: Column) -> Column:
    return F.length(s) - F.length(_without(_without(s, "G"), "C"))


def base_count(s: Column, base: str) -> Column:
    return (F.length(s) - F.length(_without(s, base))).cast("long")


def truncated_length(n: Column) -> Column:
    """Lengths over 1000 and over 100 are rounded down to whole thousands and hundreds."""
    whole = lambda by: F.floor(n / by).cast("int") * by
    return F.when(n > 1000, whole(1000)).when(n > 100, whole(100)).otherwise(n)


def dup_prefix(s: Column, dup_length: int = 0) -> Column:
    """dup_length, if set and shorter than the read; else 50 for reads longer than 50."""
    cut = F.when(F.length(s) > 50, F.substring(s, 1, 50)).otherwise(s)
    return F.when(F.length(s) > dup_length, F.substring(s, 1, dup_length)).otherwise(cut) if dup_length else cut


def mean_quality(q: Column) -> Column:
    """The whole-number mean of the ASCII codes; null without qualities."""
    codes = F.aggregate(F.split(q, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))
    return F.when(F.length(q) > 0, F.floor(codes / F.length(q)).cast("int"))


def adapter_index(s: Column, adapter: str) -> Column:
    return F.instr(s, adapter) - 1


def casava_filtered(read_id: Column) -> Column:
    return F.instr(read_id, ":Y:") > 1


def is_colorspace(s: Column) -> Column:
    return s.rlike("^[GATCNgatcn][.0-6]+$")


#: The base that a colour leads to from a base.
COLOR_STEPS = {"0": "ACGT", "1": "CATG", "2": "GTAC", "3": "TGCA"}


def decode_colors(s: Column) -> Column:
    """Bases of a colour string; from the first colour other than 0-3 (or an unknown base) on they are N."""
    step = F.lit("N")
    empty = F.struct(F.upper(F.substring(s, 1, 1)).alias("last"), F.lit("").alias("out"))

    def follow(a: Column, c: Column) -> Column:
        base = step
        for color, to in COLOR_STEPS.items():
            base = F.when((c == color) & F.contains(F.lit("ACGT"), a["last"]), F.translate(a["last"], "ACGT", to)).otherwise(base)
        return F.struct(base.alias("last"), F.concat(a["out"], base).alias("out"))

    return F.aggregate(F.filter(F.split(F.substring(s, 2, 1_000_000_000), ""), lambda c: c != ""), empty, follow, lambda a: a["out"])


def _clip(cigar: Column, end: bool) -> Column:
    found = F.regexp_extract(cigar, r"(\d+)S$" if end else r"^(\d+)S", 1)
    return F.coalesce(F.when(found != "", found.cast("int")), F.lit(0))


def soft_clipped(s: Column, cigar: Column) -> Column:
    """Without the soft-clipped ends; the front only as far as something remains."""
    back, front = _clip(cigar, True), F.when(cigar.rlike(r"^\d+S$"), 0).otherwise(_clip(cigar, False))
    rest = F.substring(s, F.lit(1), F.greatest(F.length(s) - back, F.lit(0)))
    return F.when(front <= F.length(rest), F.substring(rest, front + 1, F.length(rest))).otherwise(rest)


def original_strand(s: Column, q: Column, flag: Column) -> tuple[Column, Column]:
    """Sequence and quality as read: reverse-strand records are turned back."""
    turned = flag.bitwiseAND(0x10) != 0
    return F.when(turned, reverse_complement(s)).otherwise(s), F.when(turned, F.reverse(q)).otherwise(q)
