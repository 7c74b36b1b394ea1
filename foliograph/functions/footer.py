"""Where the footnotes of a page begin."""

from __future__ import annotations

import re
from statistics import median_high

from . import page as P

_OPENING = re.compile("^\\s*([0-9\\d]+)", re.M)
_DASHED = re.compile("[_\u0640.-]{10,}")
LEGAL = re.compile("^[\"\u00ab]?\\s*(\u0637\u0628\u0642\u0627|\u0623\u0646\u0638\u0631|\u0627\u0644\u0645\u0627\u062f\u0629\\s+\\d+)")


def weighted_mode(pairs) -> float:
    """The key of most weight; of several the first met; 0 of none."""
    total: dict = {}
    for k, n in pairs:
        total[k] = total.get(k, 0) + n
    return max(total, key=total.get) if total else 0


def page_body_size(blocks: list[dict]) -> float:
    sizes = [(round(s["size"]), len(P.span_text(s))) for b in blocks for ln in b["lines"] for s in ln["spans"] if P.span_text(s) and round(s["size"]) < 20]
    return weighted_mode(sizes) or 12.0


def marker(text: str) -> str | None:
    """The number that opens a note."""
    m = re.match(r"(\d+)(.*)", "".join(text.split()), re.S)
    if m and (m[2][:1] in ("-", "\u0640") and m[2] or len(m[2]) >= 6 and any(c.isalpha() for c in m[2])):
        return m[1]
    return None


def apart(a: float, b: float, c: float, d: float) -> float:
    return max(0.0, max(a, c) - min(b, d))


def tips(blocks: list, clip: tuple) -> dict:
    """Bottoms of the superscript numbers, by number."""
    out: dict[str, list[float]] = {}
    end = clip[1] + 0.95 * (clip[3] - clip[1])
    for b in blocks:
        lines = [ln for ln in b["lines"] if ln["box"][1] < end]
        spans = [s for ln in lines for s in ln["spans"]]
        if len({s["size"] for s in spans}) < 2:
            continue  # none is smaller than the most of its line or block
        texts = {id(s): P.span_text(s) for s in spans}
        mode_b = weighted_mode((s["size"], len(texts[id(s)])) for s in spans if texts[id(s)])
        letters_b = any(c.isalpha() for s in spans for c in texts[id(s)])
        for ln in lines:
            mode = weighted_mode((s["size"], len(texts[id(s)])) for s in ln["spans"] if texts[id(s)])
            letters = any(c.isalpha() for s in ln["spans"] for c in texts[id(s)])
            for s in ln["spans"]:
                if not mode or not (letters and s["size"] < 0.9 * mode or letters_b and mode_b and s["size"] < 0.9 * mode_b):
                    continue
                number = P._NO_DIGIT.sub("", texts[id(s)])
                if not number:
                    continue
                if not any(_numbering(s, o) for o in spans if o is not s):
                    out.setdefault(number, []).append(s["box"][3])
    return {k: sorted(v) for k, v in out.items()}


def _numbering(s: dict, o: dict) -> bool:
    """Whether ``o`` makes ``s`` a part of a number like 3-7-1."""
    t = P.span_text(o)
    if not t:
        return False
    sibling = any(c.isdigit() for c in t) and o["font"] == s["font"] and abs(o["size"] - s["size"]) < 0.5
    if not sibling and not all(c in P.DASHES for c in t):
        return False
    a, b = s["box"], o["box"]
    return apart(a[0], a[2], b[0], b[2]) <= 30 and apart(a[1], a[3], b[1], b[3]) <= 30


def rules(drawings: list[dict], clip: tuple) -> list[tuple[float, float]]:
    """(y, middle x) of drawn lines and flat boxes of 15 % of the width."""
    least, out = 0.15 * (clip[2] - clip[0]), []
    for d in drawings:
        w = abs(d["x1"] - d["x0"])
        if d["kind"] == "l" and abs(d["y1"] - d["y0"]) < 2 and w >= least:
            out.append((max(d["y0"], d["y1"]), (d["x0"] + d["x1"]) / 2))
        elif d["kind"] == "re" and d["y1"] - d["y0"] < 3 and w >= least:
            out.append((d["y0"], d["x0"] + w / 2))
    return out


def text_rules(blocks: list[dict]) -> list[tuple[float, float]]:
    """(y, middle x) of lines of dashes, or of many blanks."""
    out = []
    for b in blocks:
        for ln in b["lines"]:
            raw = P.line_text(ln)
            t = raw.strip().replace(" ", "")
            if _DASHED.fullmatch(t) or not t and len(raw) >= 30:
                out.append((ln["box"][1], (ln["box"][0] + ln["box"][2]) / 2))
    return out


def linked_below(blocks: list[dict], clip: tuple, y: float, found: dict) -> bool:
    """A note within 240 below, whose number was used above it."""
    below = P.clipped(blocks, (clip[0], y, clip[2], min(clip[3], y + 240)))
    return any(b["box"][1] > y + 1 and any(t < b["box"][1] for t in found.get(marker(P.block_text(b).strip()), ())) for b in below)


def note_just_below(blocks: list[dict], clip: tuple, y: float) -> bool:
    """The first text within 40 below starts within 25, as a note does."""
    below = sorted(P.clipped(blocks, (clip[0], y, clip[2], min(clip[3], y + 40))), key=lambda b: b["box"][1])
    for b in below:
        t = " ".join(P.block_text(b).split())
        if t and b["box"][1] > y + 1:
            return b["box"][1] - y <= 25 and bool(marker(t) or LEGAL.match(t))
    return False


def separates(blocks: list[dict], clip: tuple, y: float, found: dict) -> bool:
    if not clip[1] < y < clip[3]:
        return False
    return y > clip[3] - 0.25 * (clip[3] - clip[1]) or note_just_below(blocks, clip, y) and linked_below(blocks, clip, y, found)


def in_table(y: float, x: float, tables: list[tuple]) -> bool:
    return any(t[1] - 2 <= y <= t[3] + 2 and t[0] <= x <= t[2] for t in tables)


def confirmed(blocks: list[dict], found: dict) -> list[float]:
    """Tops of the lowest block for each number that opens a line of it and was used above."""
    last: dict[str, float] = {}
    for b in blocks:
        top = b["box"][1]
        for m in _OPENING.finditer(P.block_text(b)):
            if any(t < top for t in found.get(m[1], ())):
                last[m[1]] = max(top, last.get(m[1], top))
                break
    return list(last.values())


def separator_above(blocks: list[dict], drawings: list[dict], clip: tuple, limit: float, tables: list[tuple]) -> float | None:
    h = clip[3] - clip[1]
    ys = [y for y, x in rules(drawings, clip) + text_rules(blocks) if clip[1] + 0.45 * h <= y < limit and limit - y <= 0.16 * h and not in_table(y, x, tables)]
    return max(ys, default=None)


_STYLE = re.compile("[, -](?:bold|italic|oblique|regular|normal|medium|light|black)", re.I)


def profile(span: dict) -> tuple:
    """Family, style and size; the columns' :func:`~foliograph.functions.text.font_family` and ``font_style`` follow the same rule."""
    name = span["font"] or ""
    low = name.lower()
    style = "-".join(s for s, words in (("bold", "bold|black|heavy"), ("italic", "italic|oblique")) if re.search(words, low)) or "normal"
    return _STYLE.split(name.split("+")[-1], maxsplit=1)[0], style, round(span["size"], 1)


def backtrack(blocks: list[dict], drawings: list[dict], clip: tuple, limit: float, tops: list[float], tables: list[tuple]) -> float | None:
    """The top of the rows that run on upwards from the notes in one of their fonts."""
    rows = []
    for b in blocks:
        for r in P.merged_rows(b["lines"]):
            box = (min(s["box"][0] for s in r["spans"]), min(s["box"][1] for s in r["spans"]), max(s["box"][2] for s in r["spans"]), max(s["box"][3] for s in r["spans"]))
            fonts = {profile(s) for s in r["spans"] if P.span_text(s)}
            if fonts and not P.in_any(box, tables, 2.0) and P.text_of_spans(r["spans"]):
                rows.append((box[1], box[3], fonts))
    rows.sort(key=lambda r: r[0])
    start = next((i for i, r in enumerate(rows) if r[0] >= min(tops) - 2), None)
    if start is None:
        return None
    fonts = set().union(*(r[2] for r in rows[start:]))
    heights = [r[1] - r[0] for r in rows if r[1] > r[0]]
    reach = max(18.0, 2.5 * (median_high(heights) if heights else 7.0))
    best = rows[start][0]
    for top, bottom, own in rows[:start][::-1]:
        if best - bottom > reach or not own & fonts:
            break
        best = top
    if best >= limit - 1:
        return None
    line = separator_above(blocks, drawings, clip, rows[start][0], tables)
    return line if line is not None and 0 <= best - line <= 20 else best


def small_print(blocks: list[dict], clip: tuple, body: float) -> float | None:
    """The top of the first line at the bottom from which on most lines are small."""
    lines, sizes = [], {}
    for b in blocks:
        for ln in b["lines"]:
            own = [(round(s["size"]), len(P.span_text(s))) for s in ln["spans"] if P.span_text(s) and round(s["size"]) < 20]
            if own:
                lines.append((ln["box"][1], weighted_mode(own)))
                for k, n in own:
                    sizes[k] = sizes.get(k, 0) + n
    if len(lines) < 3:
        return None
    most = max(sizes.values())
    small = next((k for k in sorted(sizes, key=lambda k: -sizes[k]) if k <= body - 2 and sizes[k] > 0.05 * most), None)
    if not small:
        return None
    lines = sorted(lines, key=lambda line: line[0])
    for i, (y, k) in enumerate(lines):
        rest = [s <= small + 0.5 for _, s in lines[i:]]
        if k <= small + 0.5 and sum(rest) / len(rest) >= 0.7 and y > clip[3] - 0.2 * (clip[3] - clip[1]) and not P.text_in(blocks, (clip[0], y - 20, clip[2], y - 1)):
            return y
    return None


def footer_top(blocks: list[dict], drawings: list[dict], clip: tuple, tables: list[tuple]) -> tuple[float | None, bool]:
    """Top of the footnotes, and whether a number links them to the text: rule, line of dashes, linked note, small print."""
    found = tips(blocks, clip)
    if not found:
        return None, False
    ys = [y for y, x in rules(drawings, clip) if not in_table(y, x, tables) and separates(blocks, clip, y, found)]
    if ys:
        return min(ys), True
    ys = [y for y, _ in text_rules(blocks) if note_just_below(blocks, clip, y) and linked_below(blocks, clip, y, found) and clip[1] < y < clip[3]]
    if ys:
        return min(ys), True
    tops = confirmed(blocks, found)
    if tops:
        y = min(tops)
        line = separator_above(blocks, drawings, clip, y, tables)
        up = backtrack(blocks, drawings, clip, y, tops, tables)
        known = [v for v in (line, up) if v is not None]
        if up is None:
            return (line if line is not None else y), True
        return min(known), True
    return small_print(blocks, clip, page_body_size(blocks)), False
