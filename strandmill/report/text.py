"""Data and summary text."""

from __future__ import annotations

from ..plans.engine import QcResult

HEADER = "##strandmill\t0.1"


def data_text(result: QcResult) -> str:
    """Every visible module: >>name, status; header and rows, tab-separated; >>END_MODULE."""
    lines = [HEADER]
    for m in result.modules:
        if m.hidden:
            continue
        lines.append(f">>{m.name}\t{m.status}")
        if m.text:
            lines += [*m.text().splitlines(), ">>END_MODULE"]
            continue
        lines += [f"#{k}\t{v}" for k, v in m.lead]
        if m.header:
            lines.append("#" + "\t".join(m.header))
        lines += ["\t".join(r) for r in m.rows]
        lines.append(">>END_MODULE")
    return "\n".join(lines) + "\n"


def summary_text(result: QcResult) -> str:
    return "".join(f"{m.status.upper()}\t{m.name}\t{result.filename}\n" for m in result.modules if not m.hidden)
