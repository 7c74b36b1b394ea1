"""Main text of HTML pages from flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags (inline tags, links among
them, stay inside).  A block has a word count and a link density (the share of
its words inside links); those of the block before, the block itself and the
block after are the six features of a decision tree (CART on Gini impurity)
that is trained on the small labelled table below.  Blocks it takes for content
are joined by newlines.

Defined results: a null page has NULL text and no blocks; an empty page, or one
without content, has the empty text; unclosed tags, comments, scripts and styles
end at the end of the page at the latest; a > within a quoted attribute value
does not end the tag; unknown entities stay as they are;
repeated rows are treated one by one; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._tok import slices

BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_INLINE_SKIP = re.compile(r"<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HEAD = re.compile(r"<head\b.*?(?:</head\s*>|(?=<body\b)|\Z)", re.S | re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)(?:(?:[^>"']|"[^"<]*"|'[^'<]*')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)""", re.S)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """Text, words and linked words of each block that has any word."""
    page = _HEAD.sub(" ", _INLINE_SKIP.sub(" ", _COMMENT.sub(" ", page)))
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    words = linked = 0
    depth = 0
    at = 0

    def add(piece: str) -> None:
        nonlocal words, linked
        if piece:
            if "&" in piece:
                piece = _html.unescape(piece)
            parts.append(piece)
            n = len(piece.split())
            words += n
            if depth:
                linked += n

    def close() -> None:
        nonlocal words, linked
        if words:
            text = " ".join("".join(parts).split())
            if text:
                total = len(text.split())
                out.append((text, total, min(linked, total)))
        parts.clear()
        words = linked = 0

    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name == "a":
            depth = max(0, depth - 1) if m[1] else depth + 1
        elif name in BLOCK:
            close()
    add(page[at:])
    close()
    return out


#: The labelled table: words and link density of the block before, of the block
#: and of the block after, and whether it is content.  -1 words: no such block.
LABELLED = [
    # running text: long blocks among long ones
    (40, 0.0, 60, 0.0, 55, 0.0, 1), (80, 0.0, 120, 0.02, 90, 0.0, 1), (25, 0.0, 45, 0.0, 30, 0.0, 1), (60, 0.03, 35, 0.0, 70, 0.0, 1),
    (12, 0.0, 75, 0.0, 64, 0.0, 1), (150, 0.0, 200, 0.01, 20, 0.0, 1), (33, 0.0, 28, 0.05, 41, 0.0, 1), (90, 0.0, 22, 0.0, 85, 0.0, 1),
    (45, 0.0, 18, 0.0, 50, 0.0, 1), (70, 0.0, 25, 0.1, 66, 0.0, 1), (30, 0.0, 90, 0.0, 6, 1.0, 1), (55, 0.0, 48, 0.0, 3, 1.0, 1),
    (9, 0.0, 400, 0.0, 12, 0.4, 1), (1, 1.0, 55, 0.0, 40, 0.0, 1), (2, 1.0, 85, 0.0, 60, 0.0, 1), (5, 1.0, 38, 0.0, 4, 1.0, 1),
    # headings and short paragraphs beside running text
    (3, 1.0, 8, 0.0, 60, 0.0, 1), (6, 0.0, 9, 0.0, 70, 0.0, 1), (50, 0.0, 6, 0.0, 65, 0.0, 1), (80, 0.0, 12, 0.0, 75, 0.0, 1),
    (1, 1.0, 11, 0.0, 45, 0.0, 1), (40, 0.0, 4, 0.0, 52, 0.0, 1), (35, 0.0, 15, 0.0, 38, 0.0, 1), (7, 0.0, 14, 0.0, 95, 0.0, 1),
    (60, 0.0, 7, 0.0, 12, 0.0, 1), (44, 0.0, 16, 0.0, 5, 1.0, 1), (110, 0.0, 13, 0.0, 2, 1.0, 1), (28, 0.0, 10, 0.0, 33, 0.0, 1),
    (8, 0.0, 7, 0.0, 22, 0.0, 1), (8, 0.0, 6, 0.0, 13, 0.0, 1), (4, 0.0, 11, 0.0, 23, 0.0, 1), (8, 0.0, 2, 0.0, 48, 0.0, 1),
    (68, 0.0, 1, 0.0, 92, 0.0, 1), (33, 0.0, 2, 0.0, 45, 0.0, 1), (24, 0.0, 3, 0.0, 14, 0.0, 1), (15, 0.0, 1, 0.0, 30, 0.0, 1),
    (6, 0.0, 1, 0.0, 13, 0.0, 1), (50, 0.0, 5, 0.0, 11, 0.0, 1), (12, 0.0, 2, 0.0, 9, 0.0, 1), (76, 0.0, 46, 0.0, 8, 0.0, 1),
    # navigation, link lists, related articles
    (-1, 0.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0), (1, 1.0, 2, 1.0, 8, 0.0, 0),
    (5, 1.0, 9, 1.0, 7, 1.0, 0), (60, 0.0, 6, 1.0, 7, 1.0, 0), (4, 1.0, 5, 0.8, 3, 1.0, 0), (12, 0.9, 14, 0.9, 11, 1.0, 0),
    (55, 0.0, 3, 1.0, 4, 1.0, 0), (6, 1.0, 30, 0.85, 6, 1.0, 0), (3, 1.0, 25, 0.95, -1, 0.0, 0), (9, 0.7, 12, 0.6, 10, 0.7, 0),
    (40, 0.0, 20, 0.9, 35, 0.0, 0), (2, 1.0, 40, 0.9, 3, 1.0, 0), (60, 0.0, 15, 0.6, 8, 1.0, 0), (1, 1.0, 1, 1.0, 55, 0.0, 0),
    # copyright, advertising, captions of forms: short and among short or linked blocks
    (3, 1.0, 6, 0.0, -1, 0.0, 0), (4, 1.0, 5, 0.2, -1, 0.0, 0), (2, 1.0, 7, 0.0, 2, 1.0, 0), (1, 0.0, 2, 0.0, 1, 0.0, 0),
    (5, 0.5, 4, 0.0, 3, 1.0, 0), (2, 0.0, 3, 0.0, 4, 0.5, 0), (1, 1.0, 7, 0.0, 6, 0.0, 0), (6, 1.0, 8, 0.1, 2, 0.0, 0),
    (-1, 0.0, 3, 0.0, 2, 1.0, 0), (3, 0.0, 4, 0.0, -1, 0.0, 0), (7, 1.0, 9, 0.0, 1, 1.0, 0), (8, 0.9, 6, 0.3, 5, 1.0, 0),
    (58, 0.0, 15, 0.0, -1, 0.0, 0), (40, 0.0, 11, 0.0, -1, 0.0, 0), (94, 0.0, 18, 0.0, -1, 0.0, 0), (30, 0.0, 9, 0.0, -1, 0.0, 0),
    (1, 1.0, 4, 0.0, 11, 0.0, 0), (1, 1.0, 8, 0.0, 6, 0.0, 0), (1, 1.0, 8, 0.0, 7, 0.0, 0), (2, 1.0, 9, 0.0, 12, 0.0, 0),
    (5, 0.0, 12, 0.0, -1, 0.0, 0), (12, 0.0, 8, 0.0, -1, 0.0, 0), (70, 0.0, 5, 0.0, -1, 0.0, 0), (22, 0.0, 14, 0.1, -1, 0.0, 0),
]


@dataclass
class Node:
    """Leaf (``feature`` < 0) or split: at most ``limit`` goes left."""

    value: bool = False
    feature: int = -1
    limit: float = 0.0
    left: Node | None = field(default=None)
    right: Node | None = field(default=None)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2) -> Node:
    """CART: the split of least Gini impurity (ties: first feature, least limit) until pure, too deep or too small."""
    node = Node(bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for limit in (v[:-1] + v[1:]) / 2:
            left = x[:, f] <= limit
            n = left.sum()
            if least <= n <= len(y) - least:
                a, b = y[left].mean(), y[~left].mean()
                cost = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if cost < best[0] - 1e-12:
                    best = (cost, f, float(limit))
    if not np.isfinite(best[0]):
        return node
    left = x[:, best[1]] <= best[2]
    return Node(node.value, best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


@lru_cache(1)
def tree() -> Node:
    data = np.array(LABELLED, float)
    return grow(data[:, :-1], data[:, -1].astype(int))


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    """The tree's decision on each row, all rows at once."""
    if node.feature < 0:
        return np.full(len(x), node.value)
    left = x[:, node.feature] <= node.limit
    return np.where(left, classify(node.left, x), classify(node.right, x))


def block_features(words: np.ndarray, linked: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Words and link density of the block before, the block, and the block after on the same page."""
    n = len(words)
    x = np.zeros((n, 6))
    x[:, 0] = x[:, 4] = -1
    if not n:
        return x
    density = linked / np.maximum(words, 1)
    x[:, 2], x[:, 3] = words, density
    same = page[1:] == page[:-1]
    x[1:, 0][same], x[1:, 1][same] = words[:-1][same], density[:-1][same]
    x[:-1, 4][same], x[:-1, 5][same] = words[1:][same], density[1:][same]
    return x


def extracted(pages: list[list | None], model: Node) -> tuple[list[str | None], list[int], list[int]]:
    """Text, blocks and content blocks of each page, given its blocks."""
    flat = [x for g in pages if g for x in g]
    page = np.repeat(np.arange(len(pages)), [len(g or ()) for g in pages])
    keep = classify(model, block_features(np.array([x[1] for x in flat], float), np.array([x[2] for x in flat], float), page))
    text, total, content, at = [], [], [], 0
    for g in pages:
        n = len(g or ())
        chosen = [flat[i][0] for i in range(at, at + n) if keep[i]]
        text.append(None if g is None else "\n".join(chosen))
        total.append(n)
        content.append(len(chosen))
        at += n
    return text, total, content


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, text (content blocks by lines), blocks, content_blocks."""
    model = tree()

    def run(batches):
        for b in batches:
            for x in slices(b, 1, 1 << 20):
                got = [None if v is None else blocks(v) for v in x.column(1).to_pylist()]
                text, total, content = extracted(got, model)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(text, pa.string()), pa.array(total, pa.int32()), pa.array(content, pa.int32())], ["page_id", "text", "blocks", "content_blocks"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, text string, blocks int, content_blocks int")
