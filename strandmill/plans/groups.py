"""Base groups: bins of read positions. (lo, hi) are 0-based and inclusive; labels are 1-based."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession

#: An exponential plan widens its bins from a position on, if the reads are longer than that.
WIDER = {10: (75, 5), 50: (200, 10), 100: (300, 50), 500: (1000, 100), 1000: (2000, 500)}


def label(lo: int, hi: int) -> str:
    return str(lo + 1) if lo == hi else f"{lo + 1}-{hi + 1}"


def ungrouped(length: int) -> list[tuple[int, int]]:
    return [(p, p) for p in range(length)]


def exponential(length: int) -> list[tuple[int, int]]:
    out, width, at = [], 1, 1
    while at <= length:
        out.append((at - 1, min(at + width - 1, length) - 1))
        at += width
        if at in WIDER and length > WIDER[at][0]:
            width = WIDER[at][1]
    return out


def linear_width(length: int) -> int:
    """The least of 2, 5, 10, 20, 50, ... that makes fewer than 75 bins, the first nine positions being alone."""
    return next(w for n in count() for w in (2 * 10**n, 5 * 10**n, 10 * 10**n) if 9 + -(-(length - 9) // w) < 75)


def linear(length: int) -> list[tuple[int, int]]:
    if length <= 75:
        return ungrouped(length)
    width = linear_width(length)
    out, at = [(p, p) for p in range(9)], 10
    while at <= length:
        nxt = width if at == 10 < width else at + width  # the first wide bin ends before a round number
        out.append((at - 1, min(nxt - 1, length) - 1))
        at = nxt
    return out


def base_groups(max_length: int, min_length: int = 0, nogroup: bool = False, expgroup: bool = False) -> list[tuple[int, int]]:
    length = max(max_length, min_length)
    return ungrouped(length) if nogroup else exponential(length) if expgroup else linear(length)


def group_frame(spark: SparkSession, groups: list[tuple[int, int]]) -> DataFrame:
    """grp (0-based number), lo, hi (1-based), label."""
    rows = [(g, lo + 1, hi + 1, label(lo, hi)) for g, (lo, hi) in enumerate(groups)]
    return spark.createDataFrame(rows, "grp int, lo int, hi int, label string")


def position_frame(spark: SparkSession, groups: list[tuple[int, int]]) -> DataFrame:
    """pos (1-based), grp, label: the range join as an equi-join. Its size is bounded by the longest read."""
    frame = group_frame(spark, groups)
    return frame.selectExpr("explode(sequence(lo, hi)) as pos", "grp", "label")


def duckdb_values(groups: list[tuple[int, int]]) -> str:
    return "(values " + ",".join(f"({g},{lo + 1},{hi + 1},'{label(lo, hi)}')" for g, (lo, hi) in enumerate(groups)) + ") grps(grp,lo,hi,label)"
