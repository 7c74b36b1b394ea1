"""Table grids on one page: which candidates are tables, and their text.

A candidate is a dict: box, header (number of header cells), rows (lists of
cells; a cell is (box or None, raw text)), and source ('lines' from ruled
lines, 'mixed' from ruled columns and text rows).  Merged cells have no box.
"""

from __future__ import annotations

import re

from . import page as P

_BREAKS = re.compile("[\t\n\r]+")
LONE = re.compile("^[؀-ۿ]\\s+(?=\\d)")


def admitted(t: dict) -> bool:
    return len(t["rows"]) >= 2 or len(t["rows"]) == 1 and t["header"] > 2


def chosen(found: list[dict], page: tuple, clip: tuple, strategy: str | None) -> list[dict]:
    """The tables of a page by top: cut-off ones replaced by a longer scan, other scans only where none was ruled, no containers."""
    first = [t for t in found if t["source"] != "mixed" and admitted(t)]
    mixed = [t for t in found if t["source"] == "mixed"]
    if strategy is None and first:
        out = []
        for t in first:
            best, cols = t, t["header"]
            if cols >= 5:
                cut = clip[3] - t["box"][3] > max(80.0, 0.15 * (page[3] - page[1]))
                least = max(5, cols - 2) if cut else cols
                for m in mixed:
                    if m["header"] >= least and len(m["rows"]) > len(best["rows"]) + 2 and abs(m["box"][0] - t["box"][0]) < 100:
                        best = m
            out.append(best)
    elif strategy is None:
        out = [t for t in mixed if t["header"] >= 3 and admitted(t)]
    else:
        out = first
    out.sort(key=lambda t: t["box"][1])

    def holds(a: tuple, b: tuple) -> bool:
        return a[0] <= b[0] + 1 and a[1] <= b[1] + 1 and a[2] >= b[2] - 1 and a[3] >= b[3] - 1

    return [t for i, t in enumerate(out) if not any(j != i and holds(t["box"], o["box"]) for j, o in enumerate(out))]


def stretched(box: tuple, page: tuple, clip: tuple) -> tuple | None:
    """Within the clip, and to its edges where the table is wide."""
    box = P.intersect(box, clip)
    if not P.area(box):
        return None
    left, right = abs(box[0] - clip[0]) < 100, abs(box[2] - clip[2]) < 100
    if box[2] - box[0] > 0.6 * (page[2] - page[0]) or left and right:
        box = (clip[0] if left else box[0], box[1], clip[2] if right else box[2], box[3])
    return box


def cell_text(blocks: list[dict], box: tuple, raw: str | None) -> str:
    lines = [ln for b in P.clipped(blocks, box, 0.5) for ln in b["lines"]]
    text = LONE.sub("", " ".join(t for t in (P.text_of_spans(r["spans"]) for r in P.merged_rows(lines)) if t))
    if raw and text:
        extra = len("".join(text.split())) - len("".join(raw.split()))
        cut = text
        if 0 < extra <= 2:
            while extra and cut and cut[-1] in P.ALEFS:
                cut, extra = cut[:-1].rstrip(), extra - 1
        text = cut or text
    return text


def sliced(blocks: list[dict], box: tuple, t: dict) -> list[list[str]]:
    """Rows of a table that its cells don't part, by the columns of its first row, from right to left."""
    width = max(t["header"], len(t["rows"][0]))
    rows: dict[float, list[str]] = {}
    for k, (cell, _) in enumerate(t["rows"][0][::-1]):
        if cell is None:
            continue
        own = P.clipped(blocks, (cell[0] - 2.0, box[1], cell[2] + 2.0, box[3]))
        for r in P.merged_rows([ln for b in own for ln in b["lines"]]):
            text = LONE.sub("", P.text_of_spans(r["spans"]))
            if text:
                y = next((y for y in rows if abs(y - r["cy"]) < 5.0), r["cy"])
                rows.setdefault(y, [""] * width)[k] = text
    return [rows[y] for y in sorted(rows)]


def filled(grid: list[list[str]], merged: list[list[bool]]) -> list[list[str]]:
    """Merged cells take the text above."""
    out: list[list[str]] = []
    for row, gone in zip(grid, merged):
        above = out[-1] if out else []
        out.append([above[k] if gone[k] and k < len(above) and above[k] else v for k, v in enumerate(row)])
    return out


def rendered(grid: list[list[str]]) -> str | None:
    """Rows by lines and cells by ' | ', without empty columns and rows; None for less than two rows, and for layout that is no table."""
    if len(grid) < 2:
        return None
    width = max(map(len, grid))
    grid = [r + [""] * (width - len(r)) for r in grid]
    keep = [k for k in range(width) if any(r[k].strip() for r in grid)]
    if not keep:
        return None
    lines = [" | ".join(re.sub(" +", " ", _BREAKS.sub(" ", r[k].strip())) for k in keep) for r in grid if any(v.strip() for v in r)]
    text = "\n".join(lines)
    pipes = text.count("|")
    return text if len(re.sub(r"[|\s]+", "", text)) >= 0.5 * pipes else None


def tables(found: list[dict], blocks: list[dict], page: tuple, clip: tuple, strategy: str | None = None) -> list[tuple[tuple, str]]:
    """(box, text) of each table in the clip, by top."""
    out = []
    for t in chosen(found, page, clip, strategy):
        box = stretched(t["box"], page, clip)
        if box is None:
            continue
        inside = P.clipped(blocks, box)
        if len(t["rows"]) == 1 and t["header"] > 2 or any("\n" in (raw or "") for r in t["rows"] for _, raw in r):
            grid = sliced(inside, box, t)
        else:
            text, gone = [], []
            for r in t["rows"]:
                row = []
                for cell, raw in r[::-1]:
                    if cell is not None:
                        x0 = box[0] if abs(cell[0] - t["box"][0]) < 5 else cell[0]
                        x1 = box[2] if abs(cell[2] - t["box"][2]) < 5 else cell[2]
                        row.append(cell_text(inside, (x0, cell[1], x1, cell[3]), raw))
                    else:
                        row.append("")
                text.append(row)
                gone.append([cell is None for cell, _ in r[::-1]])
            grid = filled(text, gone)
        body = rendered(grid)
        if body is not None:
            out.append((box, body))
    return out
