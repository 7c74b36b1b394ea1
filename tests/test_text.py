"""Text functions: columns against the plain Python rule, and known cases."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.functions import footer, page as P, text as T

AR = "ابتثجحخدذرزسشصضطظعغفقكلمنهويةىء"
PIECES = ["ال", "لا", "هذا", "في", "ها", "كتاب", "ةمصع", "ىلع", "١٢٣", "42", "potS", "aBc", "(x)", ")x(", ") ICD (", "» a b «", "\n", "\n\n\n\n", " ", "  ", "\t", "م د ت", "ت د م", "لاليفاء", "لأل", "إلذن", "ﻻ", "ﷲ", "ـ", "‏", "Stop", "lowerX", "ةى", "الكتابلا", "بالمدرسة", "هذاالبيت", "كتابهاالجديد"]


def texts(n=400):
    rng = random.Random(0)
    out = [None, ""]
    for _ in range(n):
        out.append("".join(rng.choice([*PIECES, "".join(rng.choice(AR) for _ in range(rng.randint(1, 7))), " "]) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14))))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")


def test_clean_is_the_plain_rule(sample):
    for r in sample.select("t", T.clean(F.col("t")).alias("c")).collect():
        assert r.c == (None if r.t is None else P.clean(r.t)), repr(r.t)


@pytest.mark.parametrize(
    "text, want",
    [("نص )potS(", "نص (Stop)"), ("هذا نص سليم", "هذا نص سليم"), ("م د ت", "م-د-ت"), ("»  نص «", "«نص»"), ("لاليفاء", "للإيفاء"), ("a\n\n\n\nb", "a\n\nb"), ("س5", "س 5"), ("١٢", "١ ٢")],
)
def test_known_repairs(text, want):
    assert P.clean(text) == want


def test_scrambled_text_is_seen(spark):
    straight = "المدرسة الجديدة والمكتبة الكبيرة\nالطلاب يقرؤون الكتب العربية المفيدة"
    turned = "\n".join(x[::-1] for x in straight.split("\n"))
    rows = spark.createDataFrame([(1, straight), (2, turned), (3, ""), (4, None), (5, "plain words")], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", T.looks_scrambled(F.col("t")).alias("s")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_small_predicates(spark):
    rows = spark.createDataFrame([("- 12 -", "a b c"), ("12a", "b c d e"), ("", ""), (None, None), ("١٢", "x"), ("3- text", "text")], "a string, b string")
    got = rows.select(T.is_page_number(F.col("a")), T.reference_number(F.col("a")), T.shares_words(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, True, False]
    assert [r[1] for r in got] == [None, None, None, None, None, "3"]
    assert [r[2] for r in got] == [False, False, False, False, False, True]
    names = ["ABC+Times-BoldItalic", "Arial", "Highlight", "Source Sans Normal", "Segoe-SemiBold", "Noto,Heavy", None]
    fonts = spark.createDataFrame([(x,) for x in names], "f string").select(T.font_family(F.col("f")), T.font_style(F.col("f"))).collect()
    want = [("Times", "bold-italic"), ("Arial", "normal"), ("Highlight", "normal"), ("Source Sans", "normal"), ("Segoe-SemiBold", "bold"), ("Noto,Heavy", "bold")]
    assert [tuple(f) for f in fonts[:-1]] == want
    assert [footer.profile({"font": x, "size": 9.04})[:2] for x in names[:-1]] == want and tuple(fonts[-1]) == (None, "normal")


def test_long_runs_of_any_length_are_cleaned(spark):
    turned = " ".join(["\u0629\u0633\u0631\u062f\u0645\u0644\u0627"] * 50_000)
    straight = " ".join(["\u0627\u0644\u0645\u062f\u0631\u0633\u0629"] * 50_000)
    got = spark.createDataFrame([(turned,), (straight,)], "t string").select(T.clean(F.col("t")), T.looks_scrambled(F.col("t"))).collect()
    assert got[0][0] == straight and got[1][0] == straight
    assert got[0][1] and not got[1][1]


def test_marks_that_nfkc_reorders_go_through_it(spark):
    texts = ["\u0628\u0610\u0618", "\u0628\u064f\u0651", "\u0627\u0653", "\u06c1\u0654", "e\u0301", "\u00b5\u00b2", "plain \u00e9 \u0628"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.clean(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: P.clean(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "text, part",
    [
        ("\u0639\u062f\u0645 \u0627\u062d\u062a\u0631\u0627\u0645 \"\u0642\u0641\" )potS(", "(Stop)"),
        ("\u062e\u0637\u0627\u0628 \u0635\u0627\u062d\u0628 \u0627\u0644\u062c\u0644\u0627\u0644\u0629", "\u062e\u0637\u0627\u0628 \u0635\u0627\u062d\u0628 \u0627\u0644\u062c\u0644\u0627\u0644\u0629"),
        ("(DCI) Commune \u0629\u0643\u0631\u062a\u0634\u0645\u0644\u0627 \u0629\u064a\u0644\u0648\u062f\u0644\u0627 \u0629\u064a\u0645\u0633\u062a\u0644\u0627", "\u0627\u0644\u062a\u0633\u0645\u064a\u0629 \u0627\u0644\u062f\u0648\u0644\u064a\u0629 \u0627\u0644\u0645\u0634\u062a\u0631\u0643\u0629"),
        ("- Acide DCI \u0645 \u062f \u062a \u0643\u064a\u062f\u064a\u0633\u0648\u0641\u0644\u0627 \u0636\u0645\u062d -", "\u062d\u0645\u0636 \u0627\u0644\u0641\u0648\u0633\u064a\u062f\u064a\u0643"),
        ("DCI \u0645 \u062f \u062a", "DCI \u0645-\u062f-\u062a"),
        ("\u0644\u0627\u0644\u064a\u0641\u0627\u0621 \u0648\u0644\u0627\u0644\u062a\u0641\u0627\u0642\u064a\u0629", "\u0644\u0644\u0625\u064a\u0641\u0627\u0621"),
        ("\u0644\u0627\u0644\u062a\u0641\u0627\u0642\u064a\u0629", "\u0644\u0644\u0627\u062a\u0641\u0627\u0642\u064a\u0629"),
        ("\u0644\u0627", "\u0644\u0627"),
    ],
)
def test_known_results_in_columns(spark, text, part):
    """Results known beforehand, so that they don't depend on the patterns that both versions share."""
    assert part in P.clean(text)
    assert part in spark.createDataFrame([(text,)], "t string").select(T.clean(F.col("t"))).first()[0]


def test_passing_over_rules_changes_nothing_and_saves_time():
    """Rules that can't change a text are not tried on it."""
    import time

    for t in texts(3000)[1:]:
        assert P.quick_clean(t) == P.clean(t), repr(t)
    prose = "The plain words of a page, one after the other.\n" * 2000

    def seconds(f):
        began = time.process_time()
        f(prose)
        return time.process_time() - began

    assert min(seconds(P.quick_clean) for _ in range(3)) < 0.5 * min(seconds(P.clean) for _ in range(3))


def test_cleaning_is_one_step_of_the_plan(sample):
    plan = sample.select(T.clean(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_scrambled_detector_is_one_step_and_judges_lines(spark):
    rows = [("ةكتاب ىلعلم ةدرس\nplain", True), ("ةكتاب ىلعلم درست x", True), ("ةكتاب ىلعلم درست 7", False), ("ةكتاب ىلعلم\nةدرس", False), ("؟ةكت ؟ىلع ؟ةدر", False), (" ".join(["كتابلا"] * 15), True), (" ".join(["كتابلا"] * 14), False)]
    df = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", T.looks_scrambled(F.col("t")).alias("got"))
    assert all(r.got == r.want == P.looks_scrambled(r.t) for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
