"""The audit of one page text, in plain Python for use inside an Arrow map."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from . import text as T

_LETTER, _LATIN = 1, 2
_S, _A = f"[{T.SPACE}]", "[؀-ۿ]"
_LONG = re.compile(f"[{T.BLOCKS}]{{4,}}")
_OTHER = re.compile("[" + T._ranges(lambda c: not re.match(f"[{T.LETTERS}]", c)) + "]")
_NO_LETTER = re.compile(f"[^{T.LETTERS}]+")
_PIECE = re.compile(f"{_A}{{4,}}")
_ROMAN = re.compile("[A-Za-z]")
# single letters between blanks; the first and the last may end and begin a word
_SPACED = re.compile(f"{_S}(?<={_A}{_S}){_A}{_S}{_A}{_S}{_A}{_S}{_A}")
_LOW_HIGH = re.compile("[A-Z](?<=[a-z][A-Z])")
_REVERSED = [re.compile(r"(?<!\w)[a-z]{2,}[A-Z]{1,2}(?!\w)"), re.compile(r"(?<!\w)[A-Z][a-z]{2,}[A-Z]{1,2}(?!\w)")]
_PARENS = re.compile(f"\\){_S}*[^{T.SPACE}]{{1,30}}{_S}*\\(")
_GUILLEMETS = re.compile("»[^\n]{1,120}«")
_ZEROS = re.compile(r"(?<!\w)0{2,}\d+(?:[.,]\d+)+(?!\w)")
_NUMBER = re.compile("[0-9][0-9.,]{17,}[0-9]")
_WHOLE_NUMBER = re.compile(r"(?<!\w)[0-9][0-9.,]{17,}[0-9](?!\w)")

#: What :func:`page` gives, in order, with the columns' types.
SCHEMA = "words int, nonempty_lines int, words_per_line double, arabic_letters int, latin_letters int, long_ar_tokens int, start_al_ratio double, end_la_ratio double, unlikely_start_ratio double, full_rtl_reversal boolean, partial_rtl_corruption boolean, spaced_letters boolean, reversed_latin_tokens array<string>, mirrored_parens boolean, swapped_guillemets boolean, leading_zero_numbers array<string>, long_numeric_runs array<string>, quote_count int, many_double_quotes boolean, fragmented_lines boolean, reversed_latin boolean"


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point below 0x900; none beyond has one."""
    out = np.zeros(0x901, np.uint8)
    for cp in range(0x900):
        c = chr(cp)
        out[cp] = (_LETTER if re.match(f"[{T.LETTERS}]", c) else 0) | (_LATIN if c.isascii() and c.isalpha() else 0)
    return out


def _counts(text: str) -> tuple[int, int]:
    """Right-to-left and Latin letters."""
    if text.isascii():
        return 0, int(np.bincount(_classes()[np.frombuffer(text.encode(), np.uint8)], minlength=4)[_LATIN])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_classes()[np.minimum(points, 0x900)], minlength=4)
    return int(n[_LETTER]), int(n[_LATIN])


def long_tokens(text: str) -> list[str]:
    """As the columns' :func:`~foliograph.functions.text.long_tokens`."""
    found = _LONG.findall(text)
    if not found or _OTHER.search(text) is None:
        return found
    out = []
    for t in found:
        t = t.strip(T.STRIP)
        n = len(t)
        if n >= 4 and len(_NO_LETTER.sub("", t)) >= max(2, int(0.6 * n)):
            out.append(t)
    return out


def _odd_line(line: str) -> bool:
    bad = sum([t[0] in T.UNLIKELY_START for t in _PIECE.findall(line)])
    return bad >= 3 or bad == 2 and _ROMAN.search(line) is not None


def _first(found, most: int) -> list[str]:
    return sorted(set(found))[:most]


def page(text: str) -> tuple:
    """Counts, ratios, flags and offending tokens of a text, as ``SCHEMA`` names them."""
    words = len(text.split())
    lines = text.splitlines()
    full_lines = sum(map(bool, map(str.strip, lines)))
    per_line = words / full_lines if full_lines else 0.0
    letters, latin = _counts(text)
    tokens = long_tokens(text) if not text.isascii() else []
    n = len(tokens)
    start = end = odd = 0.0
    unlikely = 0
    if n:
        unlikely = sum([t[0] in T.UNLIKELY_START for t in tokens])
        start, end, odd = sum([t[:2] == T.ARTICLE for t in tokens]) / n, sum([t[-2:] == T.REVERSED_ARTICLE for t in tokens]) / n, unlikely / n
    turned = n >= 15 and end >= 0.25 and start <= 0.05 or n >= 10 and odd >= 0.15 or n >= 20 and odd >= 0.10
    partly = not turned and odd >= 0.03 and unlikely >= 2 and any(map(_odd_line, lines))
    reversed_latin = _first([t for p in _REVERSED for t in p.findall(text)], 15) if _LOW_HIGH.search(text) else []
    quotes = text.count('"')
    return (
        words, full_lines, per_line, letters, latin, n, start, end, odd, turned, partly,
        not text.isascii() and _SPACED.search(text) is not None, reversed_latin, _PARENS.search(text) is not None, _GUILLEMETS.search(text) is not None,
        _first(_ZEROS.findall(text), 10) if "00" in text else [], _first(_WHOLE_NUMBER.findall(text), 10) if _NUMBER.search(text) else [],
        quotes, quotes >= 50, words >= 50 and per_line < 4.0, bool(reversed_latin),
    )
