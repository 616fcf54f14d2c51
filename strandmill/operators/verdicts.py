"""pass, warn or fail of each module, from its collected result rows (which are few) and the limits."""

from __future__ import annotations

import math
from collections.abc import Iterable

from ..config import Limits
from .motifs import minus_log10


def _above(x: float, limits: Limits, module: str) -> str:
    return "fail" if x > limits.get(module, "error") else "warn" if x > limits.get(module, "warn") else "pass"


def base_quality(rows: Iterable[dict], limits: Limits) -> str:
    groups = [r for r in rows if not math.isnan(r["lower_quartile"])]
    for level, status in (("error", "fail"), ("warn", "warn")):
        if any(r["lower_quartile"] < limits.get("quality_base_lower", level) or r["median"] < limits.get("quality_base_median", level) for r in groups):
            return status
    return "pass"


def tile_quality(rows: Iterable[dict], limits: Limits) -> str:
    return _above(max((abs(r["deviation"]) for r in rows), default=0.0), limits, "tile")


def sequence_quality(mode: float | None, limits: Limits) -> str:
    if mode is None:
        return "pass"
    return "fail" if mode <= limits.get("quality_sequence", "error") else "warn" if mode <= limits.get("quality_sequence", "warn") else "pass"


def base_content(rows: Iterable[dict], limits: Limits) -> str:
    return _above(max((max(abs(r["g"] - r["c"]), abs(r["t"] - r["a"])) for r in rows), default=0.0), limits, "sequence")


def gc_content(deviation: float, limits: Limits) -> str:
    return "pass" if math.isnan(deviation) else _above(deviation, limits, "gc_sequence")


def n_content(rows: Iterable[dict], limits: Limits) -> str:
    return _above(max((r["n_percent"] for r in rows), default=0.0), limits, "n_content")


def length_distribution(lengths: Iterable[int], limits: Limits) -> str:
    found = set(lengths)
    if limits.get("sequence_length", "error") != 0 and 0 in found:
        return "fail"
    return "warn" if limits.get("sequence_length", "warn") != 0 and len(found) > 1 else "pass"


def duplication(deduplicated: float, limits: Limits) -> str:
    return "fail" if deduplicated < limits.get("duplication", "error") else "warn" if deduplicated < limits.get("duplication", "warn") else "pass"


def overrepresented(rows: list[dict], limits: Limits) -> str:
    if not rows:
        return "pass"
    return "fail" if rows[0]["percent"] > limits.get("overrepresented", "error") else "warn"


def adapter_content(rows: Iterable[dict], longest_read: int, longest_adapter: int, limits: Limits) -> str:
    most = max((r["percent"] for r in rows if not math.isnan(r["percent"])), default=0.0)
    if most > limits.get("adapter", "error"):
        return "fail"
    return "warn" if longest_adapter > longest_read or most > limits.get("adapter", "warn") else "pass"


def kmer_content(rows: list[dict], limits: Limits) -> str:
    return _above(minus_log10(rows[0]["p"]), limits, "kmer") if rows else "pass"
