"""Charts as SVG text: lines, quality boxes, and the tile map."""

from __future__ import annotations

import math
import re
from itertools import count
from xml.sax.saxutils import escape

from ..plans.engine import Module

WIDTH, HEIGHT, LEFT, TOP, RIGHT, BOTTOM = 800, 600, 60, 40, 20, 60
COLORS = ("#c0392b", "#2060c0", "#239b56", "#333333", "#8e44ad", "#d68910", "#148f77", "#7b7d7d")
CHAR_WIDTH = 7


def xml(text: str) -> str:
    return escape(text, {'"': "&quot;"})


def y_interval(top: float) -> float:
    """The least of 1, 2, 2.5, 5 times a power of ten that makes at most ten steps."""
    if top <= 0 or math.isnan(top):
        return 1.0
    start = math.floor(math.log10(top)) - 1
    return next(f * 10.0**k for k in count(start) for f in (1, 2, 2.5, 5) if top / (f * 10.0**k) <= 10)


def number(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


class Plot:
    """A frame with a title, axes and labels that don't overlap."""

    def __init__(self, title: str, x_label: str, labels: list[str], low: float, high: float):
        self.low, self.high, self.labels = low, max(high, low + 1e-9), labels
        self.parts = [f'<rect x="0" y="0" width="{WIDTH}" height="{HEIGHT}" fill="#fff"/>', self.text(WIDTH / 2, 24, title, "middle"), self.text(WIDTH / 2, HEIGHT - 12, x_label, "middle")]
        self.step = (WIDTH - LEFT - RIGHT) / max(len(labels), 1)

    @staticmethod
    def text(x: float, y: float, what: str, anchor: str = "end", color: str = "#000") -> str:
        return f'<text x="{number(x)}" y="{number(y)}" text-anchor="{anchor}" fill="{color}" font-family="Arial,sans-serif" font-size="12">{xml(what)}</text>'

    def x(self, k: float) -> float:
        return LEFT + (k + 0.5) * self.step

    def y(self, v: float) -> float:
        return HEIGHT - BOTTOM - (v - self.low) / (self.high - self.low) * (HEIGHT - TOP - BOTTOM)

    def rect(self, x: float, y: float, w: float, h: float, fill: str, stroke: str = "none") -> None:
        self.parts.append(f'<rect x="{number(x)}" y="{number(y)}" width="{number(w)}" height="{number(max(h, 0))}" fill="{fill}" stroke="{stroke}"/>')

    def line(self, points: list[tuple[float, float]], color: str) -> None:
        if points:
            self.parts.append(f'<polyline fill="none" stroke="{color}" points="{" ".join(f"{number(a)},{number(b)}" for a, b in points)}"/>')

    def axes(self, grid: float | None = None) -> None:
        step = grid or y_interval(self.high - self.low)
        for k in range(int((self.high - self.low) / step + 1e-9) + 1):
            v = self.low + k * step
            self.parts.append(self.text(LEFT - 5, self.y(v) + 4, number(v)))
        last = -math.inf
        for k, label in enumerate(self.labels):
            half = len(label) * CHAR_WIDTH / 2
            if self.x(k) - half > last:
                self.parts.append(self.text(self.x(k), HEIGHT - BOTTOM + 18, label, "middle"))
                last = self.x(k) + half + 4
        self.line([(LEFT, TOP), (LEFT, HEIGHT - BOTTOM), (WIDTH - RIGHT, HEIGHT - BOTTOM)], "#000")

    def svg(self) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}">' + "".join(self.parts) + "</svg>"


def line_graph(title: str, x_label: str, labels: list[str], series: dict[str, list[float]], high: float, low: float = 0.0) -> str:
    p = Plot(title, x_label, labels, low, high)
    p.axes()
    for k, (name, values) in enumerate(series.items()):
        color = COLORS[k % len(COLORS)]
        p.line([(p.x(i), p.y(v)) for i, v in enumerate(values) if not math.isnan(v)], color)
        p.parts.append(p.text(WIDTH - RIGHT - 10, TOP + 18 + 16 * k, name, color=color))
    return p.svg()


def quality_boxes(title: str, rows: list[dict], top: int) -> str:
    """Zones below 20, to 28 and above; a box between the quartiles with whiskers to the tenths, the median and the mean's line."""
    p = Plot(title, "Position in read (bp)", [r["base"] for r in rows], 0, max(35, top))
    for lo, hi, fill in ((0, 20, "#f5c6c6"), (20, 28, "#f7e3c0"), (28, p.high, "#cdeccd")):
        p.rect(LEFT, p.y(hi), WIDTH - LEFT - RIGHT, p.y(lo) - p.y(hi), fill)
    for k, r in enumerate(rows):
        if not math.isnan(r["median"]):
            w = p.step * 0.6
            p.rect(p.x(k) - w / 2, p.y(r["upper_quartile"]), w, p.y(r["lower_quartile"]) - p.y(r["upper_quartile"]), "#f0f000", "#000")
            p.line([(p.x(k), p.y(r["p90"])), (p.x(k), p.y(r["upper_quartile"]))], "#000")
            p.line([(p.x(k), p.y(r["p10"])), (p.x(k), p.y(r["lower_quartile"]))], "#000")
            p.line([(p.x(k) - w / 2, p.y(r["median"])), (p.x(k) + w / 2, p.y(r["median"]))], "#c00000")
    p.line([(p.x(k), p.y(r["mean"])) for k, r in enumerate(rows)], "#0000c0")
    p.axes(2)
    return p.svg()


def gradient(share: float) -> str:
    """Blue over green to red, in 100 steps of the square root."""
    t = round(math.sqrt(min(max(share, 0), 1)) * 99) / 99
    r, g, b = (0, 2 * t, 1 - 2 * t) if t < 0.5 else (2 * t - 1, 2 - 2 * t, 0)
    return f"#{round(255 * r):02x}{round(255 * g):02x}{round(255 * b):02x}"


def tile_map(title: str, rows: list[dict], most: float) -> str:
    tiles = sorted({r["tile"] for r in rows})
    labels = list(dict.fromkeys(r["base"] for r in sorted(rows, key=lambda r: r["grp"])))
    p = Plot(title, "Position in read (bp)", labels, 0, max(len(tiles), 1))
    place = {t: k for k, t in enumerate(tiles)}
    height = (HEIGHT - TOP - BOTTOM) / max(len(tiles), 1)
    for r in rows:
        k = place[r["tile"]]
        p.rect(LEFT + r["grp"] * p.step, p.y(k + 1), p.step, height, gradient(-r["deviation"] / most if most else 0))
    last = math.inf
    for t, k in place.items():
        if last - p.y(k + 0.5) > 14:
            p.parts.append(p.text(LEFT - 5, p.y(k + 0.5) + 4, str(t)))
            last = p.y(k + 0.5)
    p.axes(max(len(tiles), 1))
    return p.svg()


def chart(m: Module) -> tuple[str, str] | None:
    """(file name, SVG) of a module; basic statistics and overrepresented sequences have none."""
    if m.chart:
        return m.chart()
    d = m.data
    rows = d.get("rows", [])
    if m.key == "quality_base" and rows:
        return "per_base_quality", quality_boxes(f"Quality scores across all bases ({d['encoding']} encoding)", rows, d["top"])
    if m.key == "tile" and rows:
        return "per_tile_quality", tile_map("Quality per tile", rows, d["most"])
    if m.key == "quality_sequence" and rows:
        return "per_sequence_quality", line_graph("Quality score distribution over all sequences", "Mean Sequence Quality (Phred Score)", [str(r["quality"]) for r in rows], {"Average Quality per read": [r["n"] for r in rows]}, max(r["n"] for r in rows))
    if m.key == "sequence" and rows:
        return "per_base_sequence_content", line_graph("Sequence content across all bases", "Position in read (bp)", [r["base"] for r in rows], {f"%{b.upper()}": [r[b] for r in rows] for b in "tcag"}, 100)
    if m.key == "gc_sequence":
        curve = [0.0 if math.isnan(x) else x for x in d["curve"]]
        return "per_sequence_gc_content", line_graph("GC distribution over all sequences", "Mean GC content (%)", [str(k) for k in range(101)], {"GC count per read": d["bins"], "Theoretical Distribution": curve}, max(d["bins"] + curve))
    if m.key == "n_content" and rows:
        return "per_base_n_content", line_graph("N content across all bases", "Position in read (bp)", [r["base"] for r in rows], {"%N": [r["n_percent"] for r in rows]}, 100)
    if m.key == "sequence_length" and rows:
        return "sequence_length_distribution", line_graph("Distribution of sequence lengths over all sequences", "Sequence Length (bp)", [r["label"] for r in rows], {"Sequence Length": [r["n"] for r in rows]}, max(r["n"] for r in rows))
    if m.key == "duplication":
        return "duplication_levels", line_graph(f"Percent of seqs remaining if deduplicated {d['left']:.2f}%", "Sequence Duplication Level", [r["level"] for r in rows], {"% Total sequences": [r["percent"] for r in rows]}, 100)
    if m.key == "adapter":
        names = list(dict.fromkeys(r["name"] for r in rows))
        return "adapter_content", line_graph("% Adapter", "Position in read (bp)", list(dict.fromkeys(r["position"] for r in rows)), {n: [r["percent"] for r in rows if r["name"] == n] for n in names}, 100)
    if m.key == "kmer" and rows:
        top = rows[:6]
        return "kmer_profiles", line_graph("Log2 Obs/Exp", "Position in read (bp)", [r["position"] for r in top], {r["kmer"]: [r["max_obs_exp"] if k == i else 0.0 for k in range(len(top))] for i, r in enumerate(top)}, max(r["max_obs_exp"] for r in top))
    return None


LINE = re.compile(r'<line x1="([^"]*)" y1="([^"]*)" x2="([^"]*)" y2="([^"]*)"([^>]*)/>')
RECT = re.compile(r'<rect x="([^"]*)" y="([^"]*)" width="([^"]*)" height="([^"]*)"([^>]*)/>')


def _joined(svg: str, pattern: re.Pattern, follows, together) -> str:
    """Replaces runs of neighbouring elements: follows(a, b) tells whether b goes on from a, together(run) what stands for a run."""
    out, run, at = [], [], 0

    def flush() -> None:
        out.append(together(run) if run else "")
        run.clear()

    for m in pattern.finditer(svg):
        if m.start() != at or run and not follows(run[-1], m):
            flush()
        out.append(svg[at : m.start()])
        run.append(m)
        at = m.end()
    flush()
    return "".join([*out, svg[at:]])


def _polyline(run: list[re.Match]) -> str:
    if len(run) < 3:
        return "".join(m[0] for m in run)
    points = " ".join(f"{x},{y}" for x, y in [(run[0][1], run[0][2]), *[(m[3], m[4]) for m in run]])
    return f'<polyline points="{points}" fill="none"{run[0][5]}/>'


def _wide_rect(run: list[re.Match]) -> str:
    first = run[0]
    return f'<rect x="{first[1]}" y="{first[2]}" width="{number(sum(float(m[3]) for m in run))}" height="{first[4]}"{first[5]}/>' if len(run) > 1 else first[0]


def minify(svg: str) -> str:
    """Drops the prolog, comments and space between elements; joins chains of lines, and rows of touching boxes of one look."""
    svg = re.sub(r"<\?xml.*?\?>|<!DOCTYPE.*?>|<!--.*?-->", "", svg, flags=re.S)
    svg = re.sub(r">\s+<", "><", svg).strip()
    svg = _joined(svg, LINE, lambda a, b: (a[3], a[4], a[5]) == (b[1], b[2], b[5]), _polyline)
    return _joined(svg, RECT, lambda a, b: a.group(2, 4, 5) == b.group(2, 4, 5) and 'stroke="none"' in a[5] and abs(float(a[1]) + float(a[3]) - float(b[1])) < 0.01, _wide_rect)
