"""Matching of overrepresented sequences with known contaminants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, SHORT, SEED = 20, 8, 10


def _turned(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _stretches(equal: np.ndarray) -> list[tuple[int, int]]:
    """(length, mismatches) of stretches with at most one mismatch: each ends with its last match before a second one, and
    the next starts behind that. A stretch keeps a mismatch that it starts with."""
    bad = np.flatnonzero(~equal)
    out, start = [], 0
    while start < len(equal):
        own = bad[np.searchsorted(bad, start) :]
        stop = int(own[1]) if len(own) > 1 else len(equal)
        hits = np.flatnonzero(equal[start:stop])
        if len(hits):
            out.append((int(hits[-1]) + 1, min(len(own), 1)))
        start = stop + 1
    return out


def _seeds(s: str) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i in range(len(s) - SEED + 1):
        out.setdefault(s[i : i + SEED], []).append(i)
    return out


def best_hit(query: str, contaminants: list[tuple[str, str]]) -> tuple[str, int, int] | None:
    """(name, length, percent identity) of the longest match, then the most identical one, then the first listed."""
    best: tuple[str, int, int] | None = None

    def offer(name: str, length: int, identity: int) -> None:
        nonlocal best
        if best is None or (length, identity) > best[1:]:
            best = (name, length, identity)

    q = np.frombuffer(query.encode(), np.uint8)
    seeds = _seeds(query)
    for name, sequence in contaminants:
        for strand in (sequence, _turned(sequence)):
            if SHORT <= len(query) < LEAST:
                if query in strand:
                    offer(name, len(query), 100)
                continue
            s = np.frombuffer(strand.encode(), np.uint8)
            # A stretch of over LEAST bases with a mismatch at most holds SEED equal ones in a row, so other offsets have none.
            shared = {j - i for i in range(len(s) - SEED + 1) for j in seeds.get(strand[i : i + SEED], ())}
            for offset in sorted(x for x in shared if LEAST - len(s) <= x < len(q) - LEAST):
                lo, hi = max(0, -offset), min(len(s), len(q) - offset)
                for length, bad in _stretches(s[lo:hi] == q[lo + offset : hi + offset]) if hi - lo > LEAST else ():
                    if length > LEAST:
                        offer(name, length, (length - bad) * 100 // length)
    return best


def hit_text(hit: tuple[str, int, int] | None) -> str:
    return f"{hit[0]} ({hit[2]}% over {hit[1]}bp)" if hit else "No Hit"


def possible_source(prefix: Column, contaminants: list[tuple[str, str]]) -> Column:
    """The best contaminant of each of the few overrepresented prefixes; a constant where no list is given."""
    if not contaminants:
        return F.lit("No Hit")

    @F.pandas_udf("string")
    def match(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hit_text(best_hit(x, contaminants)))

    return match(prefix)


def contaminant_hits(prefixes: DataFrame, contaminants: list[tuple[str, str]]) -> DataFrame:
    return prefixes.withColumn("possible_source", possible_source(F.col("prefix"), contaminants))
