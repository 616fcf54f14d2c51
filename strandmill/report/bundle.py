"""HTML (two templates), XSL-FO, and the ZIP bundle."""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Callable
from datetime import date

from ..plans.engine import Module, QcResult, output_name
from .svg import chart, minify, xml
from .text import data_text, summary_text

ALT = {"pass": "PASS", "warn": "WARNING", "fail": "FAIL"}
ALT_HEAD = {"pass": "OK", "warn": "WARN", "fail": "FAIL"}
ICON = {"pass": ("#2e9d4c", "M4 9l4 4 8-9"), "warn": ("#d9910f", "M10 3v9M10 15v1"), "fail": ("#c0332b", "M4 4l12 12M16 4L4 16")}


def long_date(day: date) -> str:
    return f"{day:%a} {day.day} {day:%b %Y}"


def icon(status: str) -> str:
    color, path = ICON[status]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="20" height="20"><path d="{path}" stroke="{color}" stroke-width="3" fill="none"/></svg>'


def table(m: Module) -> str:
    head = "".join(f"<th>{xml(h)}</th>" for h in m.header)
    body = "".join("<tr>" + "".join(f"<td>{xml(c)}</td>" for c in r) + "</tr>" for r in m.rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" if m.header else "<p>No rows</p>"


#: What each module shows, by key.
ABOUT = {
    "basic": "Counts of the reads and bases of the file, and the coding of its qualities.",
    "quality_base": "How qualities are spread at each position: a box from the lower to the upper quartile, whiskers at a tenth and nine tenths, and the mean. It fails where quality falls off towards the end of the reads.",
    "tile": "How far the mean quality of each tile is from the mean of all tiles at the same position. Single tiles that stand out had a local fault, such as a bubble.",
    "quality_sequence": "How many reads have which mean quality. A second peak at low values means that a part of the reads is poor as a whole.",
    "sequence": "The share of each base at each position. In a random library the lines run in parallel; the first bases may differ by the way fragments were primed.",
    "gc_sequence": "How many reads have which share of G and C, beside a normal curve of the same peak and width. Narrow extra peaks hint at a contaminant.",
    "n_content": "The share of bases that could not be called, at each position.",
    "sequence_length": "How long the reads are.",
    "duplication": "How much of the library consists of sequences that occur so many times, and what would remain without repeats.",
    "overrepresented": "Sequences that make up more than a thousandth of all reads, with the best match among known contaminants.",
    "adapter": "The share of reads in which each adapter has begun up to a position.",
    "kmer": "Short words that occur at some positions far more often than their share of all positions.",
}


def about(m: Module) -> str:
    return f"<details><summary>About this module</summary><p>{xml(ABOUT[m.key])}</p></details>" if m.key in ABOUT else ""


def _body(m: Module) -> str:
    if m.html:
        return m.html()
    found = chart(m)
    return minify(found[1]) if found else table(m)


def classic(result: QcResult, day: date) -> str:
    """A plain page with a list of modules and their verdicts beside them."""
    seen = [m for m in result.modules if not m.hidden]
    side = "".join(f'<li><span title="[{ALT[m.status]}]">[{ALT[m.status]}]</span> <a href="#M{k}">{xml(m.name)}</a></li>' for k, m in enumerate(seen))
    main = "".join(f'<div class="module"><h2 id="M{k}"><span>[{ALT_HEAD[m.status]}]</span> {xml(m.name)}</h2>{_body(m)}</div>' for k, m in enumerate(seen))
    style = "body{font-family:sans-serif}.summary{float:left;width:16em}.main{margin-left:17em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 8px}"
    return f'<html><head><meta charset="utf-8"/><title>{xml(result.filename)} report</title><style>{style}</style></head><body><div class="header">{xml(result.filename)} {long_date(day)}</div><div class="summary"><h2>Summary</h2><ul>{side}</ul></div><div class="main">{main}</div></body></html>'


def modern(result: QcResult, day: date) -> str:
    """Cards with verdict icons; each card's table folds out."""
    seen = [m for m in result.modules if not m.hidden]
    nav = "".join(f'<a class="{m.status}" href="#M{k}">{icon(m.status)}{xml(m.name)}</a>' for k, m in enumerate(seen))
    cards = "".join(f'<section id="M{k}" class="{m.status}"><h2>{icon(m.status)} {xml(m.name)}</h2>{_body(m)}{about(m)}<details><summary>Table</summary>{table(m)}</details></section>' for k, m in enumerate(seen))
    style = ":root{font-family:system-ui,sans-serif}body{display:grid;grid-template-columns:18em 1fr;margin:0}nav{position:sticky;top:0;height:100vh;overflow:auto}nav a{display:block;padding:.4em}section{border:1px solid #ddd;border-radius:8px;margin:1em;padding:1em}td,th{padding:2px 8px;text-align:left}"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{xml(result.filename)} report</title><style>{style}</style></head><body><nav><h1>{xml(result.filename)}</h1><p>{long_date(day)}</p>{nav}</nav><main>{cards}</main></body></html>'


#: Templates by name; others can be added.
TEMPLATES: dict[str, Callable[[QcResult, date], str]] = {"classic": classic, "modern": modern}


def fo(result: QcResult) -> str:
    """A page a module; those without a chart have their rows as a table."""
    pages = []
    for m in result.modules:
        if m.hidden:
            continue
        body = ""
        if not chart(m) and m.rows:
            body = "<fo:table><fo:table-body>" + "".join("<fo:table-row>" + "".join(f"<fo:table-cell><fo:block>{xml(c)}</fo:block></fo:table-cell>" for c in r) + "</fo:table-row>" for r in m.rows) + "</fo:table-body></fo:table>"
        pages.append(f'<fo:page-sequence master-reference="page"><fo:flow flow-name="xsl-region-body"><fo:block font-size="16pt">{xml(m.name)} [{ALT[m.status]}]</fo:block>{body}</fo:flow></fo:page-sequence>')
    return '<?xml version="1.0" encoding="UTF-8"?><fo:root xmlns:fo="http://www.w3.org/1999/XSL/Format"><fo:layout-master-set><fo:simple-page-master master-name="page"><fo:region-body/></fo:simple-page-master></fo:layout-master-set>' + "".join(pages) + "</fo:root>"


def write(result: QcResult, path: str, outdir: str | None = None, template: str = "modern", extract: bool = False, delete: bool = False, day: date | None = None) -> tuple[str, str]:
    """The HTML file and the ZIP bundle of a sample, beside its first file or in outdir. Gives both paths."""
    base = output_name(os.path.basename(path)) + "_qc"
    folder = outdir or os.path.dirname(path) or "."
    page = TEMPLATES[template](result, day or date.today())
    html_path, zip_path = os.path.join(folder, f"{base}.html"), os.path.join(folder, f"{base}.zip")
    with open(html_path, "w", encoding="utf-8") as f:
        f.write(page)
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as z:
        for d in ("", "Icons/", "Images/"):
            z.writestr(f"{base}/{d}", "")
        for status in ICON:
            z.writestr(f"{base}/Icons/{status}.svg", icon(status))
        z.writestr(f"{base}/summary.txt", summary_text(result))
        for m in result.modules:
            if not m.hidden and (found := chart(m)):
                z.writestr(f"{base}/Images/{found[0]}.svg", minify(found[1]))
        z.writestr(f"{base}/report.html", page)
        z.writestr(f"{base}/data.txt", data_text(result))
        z.writestr(f"{base}/report.fo", fo(result))
    if extract:
        shutil.rmtree(os.path.join(folder, base), ignore_errors=True)
        with zipfile.ZipFile(zip_path) as z:
            z.extractall(folder)
        if delete:
            os.remove(zip_path)
    return html_path, zip_path
