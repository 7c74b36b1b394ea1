"""Broken forms made of the documents' lines, and what repairing them must give: one rule of the cleaning chain for each line.

A line's letters stand for a word of letters that no rule is about.  The
results are written down, not computed by any of the chain's patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as ST

from ..functions import text as T
from . import corpora, layout

#: (broken, repaired); W is the word.
CASES = [
    ("WW", "W-W"),  # a bullet of the private area
    ("واألW", "والأW"),  # lam and alef exchanged behind a prefix
    ("ا إ لW", "الإW"),  # and without one
    ("W ﻻ W", "W لا W"),  # a presentation form
    ("W² Ａ", "W 2 A"),  # compatibility characters
    ("‏WــW﻿", "WW"),  # invisible marks and stretching
    ("W (potS)", "W (Stop)"),
    ("W )قف(", "W (قف)"),
    (") ICD ( W", "(DCI) W"),
    ("» W «", "«W»"),
    ("Wلا Wلا", "الV الV"),  # a run stored backwards; V is W turned
    ("هذاالW", "هذا الW"),  # this, and a noun
    ("فيهاالW", "فيها الW"),  # a short pronoun, and a noun
    ("WهملاW", "Wهم الW"),  # a noun with a pronoun, and a noun
    ("لألW", "للأW"),
    ("W ال W", "W لا W"),
    ("لاليفاء W", "للإيفاء W"),
    ("W لالتفاقية", "W للاتفاقية"),
    ("بإلذن W", "بلإذن W"),
    ("W12W3", "W 12 W 3"),
    ("W  \t  W", "W W"),
    ("W ت د  م W", "W م-د-ت W"),
    ("W\n\n\n\n\nW", "W\n\nW"),
    ("W, W", "W, W"),  # nothing to repair
]


_NO_LATIN = re.compile("[^a-zA-Z]+")


def lines(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, idx, rule, broken) of the lines with at least three letters."""
    fields = [*(ST.StructField(n, ST.IntegerType()) for n in ("idx", "rule")), ST.StructField("broken", ST.StringType())]

    def made(_, own):
        words = [layout.plain(_NO_LATIN.sub("", x).lower()) for x in own]
        rules = [k % len(CASES) for k in range(len(own))]
        return range(len(own)), rules, [CASES[r][0].replace("W", w) if len(w) >= 3 else None for r, w in zip(rules, words)]

    return layout._of_lines(s, d, fields, made).filter("broken is not null")


def repaired(s: SparkSession, d: str) -> DataFrame:
    """Each line's broken form after cleaning."""
    return lines(s, d).select("doc_id", "idx", "rule", T.clean(F.col("broken")).alias("text"))


_FORMS = "[" + ", ".join(f"'{good}'" for _, good in CASES) + "]"
SQL = f"""WITH {layout.LINES_SQL}, w AS (SELECT doc_id, idx, CAST(idx % {len(CASES)} AS INTEGER) AS rule, translate(lower(regexp_replace(txt, '[^a-zA-Z]', '', 'g')), '{corpora.LATIN}', '{layout.PLAIN}') AS w FROM lines)
SELECT doc_id, idx, rule, replace(replace({_FORMS}[rule + 1], 'W', w), 'V', reverse(w)) AS text FROM w WHERE length(w) >= 3"""
