"""Glyph rows, reading order, tables, footers, page extraction and documents."""

import os
import random
import statistics

import pytest

from foliograph.functions import footer, page as P, tables
from foliograph.operators import layout as L
from foliograph.plans import extract
from foliograph.sources import layout as S


def glyphs(text, x=500.0, y=100.0, size=7.0, rtl=True):
    out = []
    for c in text:
        out.append(P.Glyph(c, x - size, y, x, y + 12) if rtl else P.Glyph(c, x, y, x + size, y + 12))
        x += -(size + 1) if rtl else size + 1
    return out


def block(text, y, x=500.0, size=12.0, font="Body", rtl=True, width=7.0):
    g = glyphs(text, x, y, width, rtl)
    box = (min(a.x0 for a in g), y, max(a.x1 for a in g), y + 12)
    return {"box": box, "lines": [{"box": box, "spans": [{"box": box, "font": font, "size": size, "glyphs": g}]}]}


def test_row_text_orders_spaces_and_digits():
    assert P.row_text(glyphs("كتاب جديد")) == "كتاب جديد"
    assert P.row_text(glyphs("abc def", 50, rtl=False)) == "abc def"
    number = [*glyphs("سنة "), *(P.Glyph(c, 440 + 8 * i, 100, 447 + 8 * i, 112) for i, c in enumerate("1977"))]
    assert P.row_text(number) == "سنة 1977"
    assert P.row_text([]) == ""
    twice = [g for g in glyphs("باب", size=20.0) for g in (g, P.Glyph(g.c, g.x0 + 0.5, g.y0, g.x1 + 0.5, g.y1))]
    assert P.row_text(twice) == "باب"


def test_glyph_repairs():
    alef, lam = P.Glyph("ا", 100, 0, 103, 10), P.Glyph("ل", 100.5, 0, 104, 10)
    assert [g.c for g in P.repaired([alef, lam])] == ["ل", "ا"]
    mark, base = P.Glyph("َ", 90, 0, 90, 10), P.Glyph("ب", 80, 0, 90, 10)
    got = P.repaired([mark, base])
    assert [g.c for g in got] == ["ب", "َ"] and got[1].x0 == pytest.approx(79.99)


def test_rows_merge_by_running_mean():
    lines = [{"box": (0, y, 1, y + 10), "spans": [y]} for y in (0, 2, 4, 20, 6)]
    assert [r["spans"] for r in P.merged_rows(lines)] == [[0, 2, 4], [6], [20]]


def test_gutter_by_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        boxes = [(a, 0, a + rng.randint(5, 250), 10) for a in (rng.randint(0, 400) for _ in range(rng.randint(0, 8)))]
        free = [not any(b[0] <= x < min(600, b[2]) for b in boxes if b[2] - b[0] <= 360) for x in range(600)]
        runs, x = [], 180
        while x < 420:
            n = 0
            while x + n < 420 and free[x + n]:
                n += 1
            if n:
                runs.append((n, -x))
            x += n + 1
        best = max(runs, default=(0, 0))
        assert P.gutter(boxes, (0, 0, 600, 700)) == (best[0] / 2 - best[1] if best[0] >= 10 else 300)


def test_reading_order_right_column_first():
    boxes = [(50, 100, 280, 120), (320, 100, 550, 120), (50, 50, 550, 80), (320, 140, 550, 160), (50, 140, 280, 160), (40, 300, 560, 330)]
    assert P.reading_order(boxes, (0, 0, 600, 700)) == [2, 1, 3, 0, 4, 5]
    assert P.reading_order([], (0, 0, 600, 700)) == []


def test_tables():
    cell = lambda r, c: ((100 + 100 * c, 100 + 20 * r, 200 + 100 * c, 120 + 20 * r), "x")
    grid = [[cell(r, c) for c in range(3)] for r in range(3)]
    grid[1][0] = (None, None)
    t = {"box": (100, 100, 400, 160), "source": "lines", "header": 3, "rows": grid}
    blocks = [block(f"word{r}{c}", 102 + 20 * r, 110 + 100 * c, rtl=False) for r in range(3) for c in range(3) if (r, c) != (1, 0)]
    outer = {"box": (90, 90, 410, 170), "source": "lines", "header": 1, "rows": [[((90, 90, 410, 130), "")], [((90, 130, 410, 170), "")]]}
    got = tables.tables([t, outer], blocks, (0, 0, 1000, 700), (0, 0, 1000, 700))
    assert [x[1] for x in got] == ["word02 | word01 | word00\nword12 | word11 | word00\nword22 | word21 | word20"]
    assert tables.rendered([["a"]]) is None and tables.rendered([["", ""], ["", ""]]) is None
    assert tables.stretched((0, 0, 5, 5), (0, 0, 600, 700), (10, 10, 590, 690)) is None
    assert tables.rendered([["a", "", " b\n c"], ["", "", ""], ["d", "", "e"]]) == "a | b c\nd | e"


def footnoted(rule=True):
    body = block("some long text of the body here", 100, 60, rtl=False)
    tip = {"box": (310, 95, 314, 100), "font": "Body", "size": 7.0, "glyphs": [P.Glyph("1", 310, 95, 314, 100)]}
    body["lines"][0]["spans"].append(tip)
    note = block("1 - the source of the text", 640, 60, 8.0, rtl=False)
    lines = [{"kind": "l", "x0": 60, "y0": 620, "x1": 300, "y1": 620}] if rule else []
    return [body, block("more text follows the first line", 130, 60, rtl=False), note], lines


def test_footer_by_rule_and_by_reference():
    clip = (0, 0, 600, 700)
    assert footer.footer_top(*footnoted(), clip, []) == (620, True)
    blocks, _ = footnoted(False)
    assert footer.footer_top(blocks, [], clip, []) == (640, True)
    assert footer.footer_top([blocks[1]], [], clip, []) == (None, False)
    assert footer.marker("12- abc") == "12" and footer.marker("12 abcdef") == "12" and footer.marker("12") is None


def row(blocks, doc="a", page=1, images=(), drawings=(), tables=()):
    box = lambda b: dict(zip(("x0", "y0", "x1", "y1"), map(float, b)))
    return {
        "doc_id": doc,
        "page_no": page,
        "rect": box((0, 0, 600, 700)),
        "blocks": [{**box(b["box"]), "lines": [{**box(ln["box"]), "spans": [{"font": s["font"], "size": s["size"], **box(s["box"]), "glyphs": [{"c": g.c, **box(g[1:])} for g in s["glyphs"]]} for s in ln["spans"]]} for ln in b["lines"]]} for b in blocks],
        "images": [{"digest": d, **box(b)} for d, b in images],
        "drawings": [{"kind": d["kind"], **box((d["x0"], d["y0"], d["x1"], d["y1"]))} for d in drawings],
        "tables": list(tables),
    }


@pytest.fixture(scope="module")
def layout(spark):
    blocks, lines = footnoted()
    head = lambda: block("yearly report of the board", 20, 60, rtl=False)
    rows = [
        row([head(), *blocks, block("- 1 -", 680, 280, rtl=False)], page=1, drawings=lines),
        row([head(), block("second page text", 200, 60, rtl=False)], page=2),
        row([block("only text", 300, 60, rtl=False)], "b", 1, images=[("d", (100, 350, 400, 600))]),
        row([], "c", 1),
        {"doc_id": "d", "page_no": 1, "rect": None, "blocks": None, "images": None, "drawings": None, "tables": None},
    ]
    return spark.createDataFrame(rows, S.PAGE)


def test_pages_and_documents(layout):
    never = extract.Options(ocr_strategy="never")
    got = {(r.doc_id, r.page_no): r for r in extract.extract_pages(layout, never).collect()}
    assert got["a", 1].text == "some long text of the body here\n\nmore text follows the first line"
    assert got["a", 2].text == "second page text" and got["a", 1].footer_y == 620
    assert got["b", 1].is_empty and not got["b", 1].is_mixed
    assert got["c", 1].text == got["d", 1].text == ""
    docs = {r.doc_id: r for r in extract.documents(extract.extract_pages(layout, never)).collect()}
    assert docs["a"].pages_total == docs["a"].pages_with_text == 2 and docs["a"].warnings == []
    assert docs["c"].empty_pages == [1] and docs["c"].warnings == ["empty_page:1"] and docs["c"].text == ""


def test_ocr_and_options(layout):
    with pytest.raises(extract.OcrUnavailableError):
        extract.extract_pages(layout)
    with pytest.raises(ValueError):
        extract.strategy("ocr")
    assert extract.strategy(None) == "auto"
    got = {(r.doc_id, r.page_no): r for r in extract.extract_pages(layout, ocr=lambda page, box: "read by eye").collect()}
    assert got["b", 1].text == "read by eye" and got["b", 1].used_ocr and not got["a", 1].used_ocr
    crop = extract.clips(layout, extract.Options(crop_top=10, crop_bottom=5, auto_crop_bottom=False)).filter("doc_id = 'b'").first()
    assert (crop.top_y, crop.bottom_y) == (70, 665)


def test_image_regions():
    text = [block("text under the picture", 300, 60, rtl=False)]
    clip = (0, 0, 600, 700)
    assert P.image_regions([{"box": (50, 100, 300, 303)}], text, clip) == [(50, 100, 300, 299)]
    assert P.image_regions([{"box": (50, 100, 300, 120)}, {"box": (50, 121, 300, 150)}], text, clip) == [(50, 100, 300, 150)]
    assert P.image_regions([{"box": (0, 0, 10, 9)}], text, clip) == []


def test_relational_operators_on_odd_rows(spark):
    boxes = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 10.0, "x"), (None, 1, 0.0, 0.0, 5.0, 5.0, "x"), ("a", 1, 0.0, 0.0, 10.0, 10.0, "x")], "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double, text string")
    tables_ = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 20.0, 20.0)], "doc_id string, page_no int, table_id int, x0 double, y0 double, x1 double, y1 double")
    assert [r.doc_id for r in L.outside_tables(boxes, tables_).collect()] == [None]
    assert L.outside_tables(boxes, tables_.limit(0)).count() == 3
    cells = spark.createDataFrame([("a", 1, 0, r, c, v, m) for r, c, v, m in ((0, 0, "k", False), (0, 1, None, False), (1, 0, None, True), (1, 1, "v|", False))], "doc_id string, page_no int, table_id int, row int, col int, value string, merged boolean")
    assert [r.text for r in L.table_texts(cells).collect()] == ["k | \nk | v|"]
    assert L.table_texts(cells.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    d = tmp_path / "all" / "doc1"
    d.mkdir(parents=True)
    (d / "page_001.txt").write_bytes("نص\nb".encode() + b"\xff")
    (d / "notes.txt").write_text("no")
    got = S.read_page_texts(spark, str(tmp_path / "all")).collect()
    assert [(r.doc, r.text) for r in got] == [("doc1", "نص\nb�")]
    assert S.heads(S.read_page_texts(spark, str(tmp_path / "all")), 1).first()["head"] == "نص"
    pdf = tmp_path / "pdf"
    pdf.mkdir()
    (pdf / "A.PDF").write_bytes(b"one")
    (pdf / "b.pdf").write_bytes(b"bad")
    (pdf / "c.txt").write_bytes(b"no")

    def decoder(name, content):
        if content == b"bad":
            raise ValueError("broken")
        yield {"doc_id": name, "page_no": 1, "blocks": []}

    rows = {r.doc_id: r for r in S.decode(S.read_files(spark, str(pdf)), decoder).collect()}
    assert rows["A.PDF"].error is None and rows["b.pdf"].error == "broken" and len(rows) == 2
    S.write_page_texts(spark.createDataFrame([("x", 1, "hello")], "doc_id string, page_no int, text string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "doc_id=x" / "page_id=page_001").exists()


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="the driver's tables are not here")
def test_files_give_the_pages_of_their_layout_without_a_shuffle(spark):
    """Whole documents decoded at once: the same rows as from nested pages, and no page of glyphs is exchanged."""
    from foliograph.plans import layout as Q

    never = extract.Options(ocr_strategy="never")
    key = lambda r: (r.doc_id, r.page_no)
    nested = spark.createDataFrame(Q.nested(spark, SMALL).collect(), S.PAGE)
    for files, pages in ((extract.extract_files(Q.files(spark, SMALL), Q.decoded, never), extract.extract_pages(nested, never)), (extract.clip_files(Q.files(spark, SMALL), Q.decoded), extract.clips(nested))):
        got, want = sorted(files.collect(), key=key), sorted(pages.collect(), key=key)
        assert got == want and len(got) > 200
    plan = Q.queries()["extract_pages"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_even_runs_are_read_as_their_glyphs():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("بتالةى ٠²19.-/aB(\u00a0ً") for _ in range(rng.randint(0, 12)))
        run = P.Run(text, 533.0 if rng.random() < 0.5 else 60.0, rng.choice([-8, 8, 5, -3, 20]), rng.choice([7.0, 4.0, 0.4]), 100.0, 112.0)
        assert P.row_text(run) == P.row_text(list(run)), repr(text)
        box = (rng.uniform(40, 600), rng.choice([0, 107]), rng.uniform(40, 600), 200)
        own = [g for g in run if box[0] <= (g.x0 + g.x1) / 2 <= box[2] and box[1] <= 106 <= box[3]]
        assert list(run.inside(*box) or ()) == own
    for _ in range(300):
        spans = [{"box": (0, 0, 1, 1), "size": rng.choice([7.0, 8.0, 12.0, 30.0]), "glyphs": P.Run("x" * rng.randint(0, 6), 0, 8, 7, 0, 9)} for _ in range(rng.randint(0, 5))]
        sizes = [s["size"] for s in spans if s["size"] < 20 for _ in s["glyphs"]]
        assert P.body_size([{"box": (0, 0, 1, 1), "lines": [{"spans": spans}]}], []) == (statistics.median(sizes) if sizes else 0.0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.exists(SMALL), reason="the driver's tables are not here")
def test_row_texts_of_runs_are_those_of_their_glyphs_without_a_shuffle(spark):
    from foliograph.plans import layout as Q

    keys = ["doc_id", "page_no", "slot"]
    got = L.run_texts(Q.runs(spark, SMALL), keys)
    plan = plan_of(Q.queries()["layout_row_text"](spark, SMALL))
    assert "Window" not in plan and "hashpartitioning" not in plan
    want = L.row_texts(Q.glyphs(spark, SMALL), keys)
    assert "Window" not in plan_of(want) and plan_of(want).count("Exchange hashpartitioning") == 1
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_visual_rows_of_odd_glyphs():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("بتاد ءaB\t19. ") for _ in range(rng.randint(0, 12)))
        run = P.Run(text, 533.0, rng.choice([-8, 8, 5, -20]), rng.choice([7.0, 4.0]), 100.0, 112.0)
        assert P.visual_rows(run) == P.visual_rows(list(run)), repr(text)
    two = [*glyphs("ab", 500, 100), *glyphs(" c", 500, 104), *glyphs(" ", 500, 120)]
    assert P.visual_rows(two) == [(0, "ab"), (1, "c")]


def test_gutters_shuffle_one_row_for_each_box(spark):
    boxes = spark.createDataFrame([("a", 1, 0.0, 200.0), ("a", 1, 260.0, 300.0), ("a", 1, 340.0, 560.0), ("a", 1, 0.0, 590.0), ("b", 1, 0.0, 590.0), ("c", 1, 170.0, 440.0)], "doc_id string, page_no int, x0 double, x1 double")
    got = L.gutters(boxes.selectExpr("*", "0D AS left", "600D AS width"))
    assert {r.doc_id: r.mid_x for r in got.collect()} == {"a": 230.0, "b": 300.0, "c": 300.0}
    assert "Generate" not in plan_of(got) and "Join" not in plan_of(got)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="the driver's tables are not here")
def test_lines_are_cut_without_a_shuffle_and_tested_as_the_columns_do(spark):
    from pyspark.sql import functions as F

    from foliograph.functions import text as T
    from foliograph.plans import cleaning, layout as Q

    for df in (Q.line_tests(spark, SMALL), cleaning.lines(spark, SMALL), Q.lines(spark, SMALL)):
        assert "Window" not in plan_of(df) and "hashpartitioning" not in plan_of(df) and "regexp" not in plan_of(df)
    assert Q.cut("a" * 130 + "\n  \n\nb\n" + " " * 60 + "c") == ["a" * 60, "a" * 60, "a" * 10, "b", "c"] and Q.cut(None) == Q.cut("") == []
    rng = random.Random(5)
    texts = ["".join(rng.choice(["12", "٣", "²", "-", "–", "ـ", " ", "a", "word ", "كلمة ", "b c ", "."]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame(list(zip(texts, texts[1:] + [""])), "a string, b string").select("a", "b", T.is_page_number(F.col("a")).alias("p"), T.reference_number(F.col("a")).alias("n"), T.shares_words(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert (P.is_page_number(r.a), P.reference_number(r.a), P.shares_words(P.word_set(r.a), P.word_set(r.b))) == (r.p, r.n, r.s), repr((r.a, r.b))
