"""Column functions on right-to-left page text.

Everything is a built-in expression, but for the cleaning chain and the
detector of scrambled text, which are Arrow UDFs.
"""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

#: Character classes for regular expressions (without brackets).
BLOCKS = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff"
BASE = "\u0621-\u064a"
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = "\\p{L}\\p{N}_"
STRIP = string.punctuation + "\u061f\u061b\u060c\u00ab\u00bb\u201c\u201d" + "\t\n\r "
ARTICLE, REVERSED_ARTICLE = "\u0627\u0644", "\u0644\u0627"
UNLIKELY_START = "\u0629\u0649"


def _ranges(keep) -> str:
    """Class body of the code points of the three blocks for which ``keep`` holds."""
    out, start, last = [], None, None
    for cp in [*range(0x600, 0x700), *range(0x750, 0x780), *range(0x8A0, 0x900)]:
        if keep(chr(cp)):
            if start is None or cp != last + 1:
                if start is not None:
                    out.append((start, last))
                start = cp
            last = cp
    out.append((start, last))
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


LETTERS = _ranges(lambda c: unicodedata.category(c).startswith("L"))


def words(text: Column) -> Column:
    """The runs of characters that are not white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines, by any line end."""
    return F.split(text, LINE_END)


def count_of(text: Column, cls: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{cls}]", ""))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _share(tokens: Column, test) -> Column:
    n = F.size(tokens)
    return F.when(n > 0, F.size(F.filter(tokens, test)) / n).otherwise(F.lit(0.0))


def starts_with_article(t: Column) -> Column:
    return t.startswith(ARTICLE)


def ends_with_reversed_article(t: Column) -> Column:
    return t.endswith(REVERSED_ARTICLE)


def unlikely_start(t: Column) -> Column:
    return F.substring(t, 1, 1).isin(*UNLIKELY_START)


def long_tokens(text: Column, letters: str = LETTERS) -> Column:
    """Tokens of at least four characters, most of them letters, without punctuation at the ends."""
    tokens = F.transform(all_matches(text, f"[{BLOCKS}]{{2,}}"), lambda t: F.btrim(t, F.lit(STRIP)))
    return F.filter(tokens, lambda t: (F.length(t) >= 4) & (count_of(t, letters) >= F.greatest(F.lit(2), F.floor(F.lit(0.6) * F.length(t)))))


def looks_scrambled(text: Column) -> Column:
    """Whether right-to-left text is probably stored backwards; an Arrow UDF, which takes the time of one regular expression."""

    @F.pandas_udf("boolean")
    def scrambled(s: pd.Series) -> pd.Series:
        from .page import looks_scrambled as one

        return s.map(lambda v: v is not None and one(v))

    return scrambled(text)


def is_page_number(text: Column) -> Column:
    """Not blank, no letter, and a digit."""
    return F.coalesce(text.rlike("\\p{Nd}|[\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468]") & ~text.rlike("\\p{L}"), F.lit(False))


def word_set(text: Column) -> Column:
    """Distinct words without punctuation and digits."""
    return F.array_distinct(words(F.regexp_replace(text, f"[^{WORD}{SPACE}]|\\p{{Nd}}", "")))


def shares_words(a: Column, b: Column) -> Column:
    """Three common words, or half of those of ``a``."""
    x, y = word_set(a), word_set(b)
    common = F.size(F.array_intersect(x, y))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & ((common >= 3) | (common >= 0.5 * F.size(x))), F.lit(False))


def reference_number(text: Column) -> Column:
    """The number that opens a note: digits and then a dash, or a tail of six characters with a letter; else NULL."""
    t = F.regexp_replace(text, f"[{SPACE}]+", "")
    number, tail = F.regexp_extract(t, "^(\\p{Nd}+)", 1), F.regexp_replace(t, "^\\p{Nd}+", "")
    ok = (number != "") & (tail.rlike("^[-\u2010-\u2015\u2212\u0640]") | ((F.length(tail) >= 6) & tail.rlike("\\p{L}")))
    return F.when(ok, number)


def font_family(font: Column) -> Column:
    """The name without subset prefix and, from the first one on, style words."""
    return F.regexp_replace(F.element_at(F.split(font, "\\+"), -1), "(?is)[, -](?:bold|italic|oblique|regular|normal|medium|light|black).*$", "")


def font_style(font: Column) -> Column:
    bold, italic = font.rlike("(?i)bold|black|heavy"), font.rlike("(?i)italic|oblique")
    return F.when(bold & italic, "bold-italic").when(bold, "bold").when(italic, "italic").otherwise("normal")


# cleaning

_PRONOUN = "\u0647\u0627|\u0647\u0645|\u0647\u0646|\u0647|\u0643|\u064a|\u0646\u0627|\u0647\u0645\u0627"
_DEMONSTRATIVE = "\u0647\u0630\u0627|\u0647\u0630\u0647|\u0630\u0644\u0643|\u062a\u0644\u0643"
_PREPOSITION = "\u0641\u064a|\u0628|\u0644|\u0645\u0646|\u0639\u0646|\u0639\u0644\u0649|\u0625\u0644\u0649"
_EITHER = "(?:\u0627\u0644|\u0644\u0627)"


def clean(text: Column) -> Column:
    """Extracted text repaired: ligatures, NFKC, invisible characters, reversed words, mirrored brackets, joined words, digits, spaces.

    An Arrow UDF, as rules that can't change a text are passed over, which takes
    a tenth of the time of the rules as expressions.
    """

    @F.pandas_udf("string")
    def repaired(s: pd.Series) -> pd.Series:
        from .page import quick_clean

        return s.map(lambda v: None if v is None else quick_clean(v))

    return repaired(text)
