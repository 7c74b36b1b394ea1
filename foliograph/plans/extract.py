"""From decoded pages to page texts, tables and documents.

The crop of a page needs its neighbours: the outermost text or small image of
each margin is found inside the nested row, and one window by document compares
it with those of the pages before and after.  That window is the only shuffle of
whole pages (a document's pages meet in one task); all else is page-local and
runs in one Arrow map.

A NULL list of blocks, images, drawings or tables is an empty one; a page
without rectangle, or of a crop that leaves nothing, has the empty text; rows
repeated (doc_id, page_no) are pages that stand beside each other, each gives
one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

STRATEGIES = ("never", "warn", "auto", "force")


class ExtractionError(Exception):
    """An extraction that can't begin."""


class InvalidPathError(ExtractionError):
    """No such document, or none that can be read."""


class OcrUnavailableError(ExtractionError):
    """OCR is asked for, and no engine is given."""


@dataclass(frozen=True)
class Options:
    crop_top: float = 0.0
    crop_bottom: float = 0.0
    crop_unit: str = "pct"
    auto_crop_top: bool = True
    auto_crop_bottom: bool = True
    detect_footer: bool = True
    ocr_strategy: str | None = "auto"
    table_strategy: str | None = None


def strategy(value: str | None, default: str = "auto") -> str:
    """A valid OCR strategy; None is the default."""
    got = default if value is None else value
    if got not in STRATEGIES:
        raise ValueError(f"OCR strategy must be one of {', '.join(STRATEGIES)}: {got!r}")
    return got


def capabilities(ocr: Callable | None = None) -> dict:
    return dict.fromkeys(("tables", "footer_detection"), True) | {"ocr": ocr is not None}


def _glyphs(block: Column) -> Column:
    """All glyphs of a block."""
    parts = F.flatten(F.filter(F.transform(F.coalesce(block.lines, F.array()), lambda ln: ln.spans), lambda x: x.isNotNull()))
    return F.flatten(F.filter(F.transform(parts, lambda s: s.glyphs), lambda x: x.isNotNull()))


def _joined(glyphs: Column) -> Column:
    """Their characters, stripped."""
    return T.strip(F.array_join(F.transform(glyphs, lambda g: g.c), ""))


def margins(layout: DataFrame) -> DataFrame:
    """``layout`` with top and bottom: outermost item of either margin: text or digest, edge, whether it is a page number.

    Of a block that reaches into a margin only the glyphs there count, for its
    text, its centre and its edge.
    """
    y0, y1 = F.col("rect.y0"), F.col("rect.y1")
    h = y1 - y0

    def outermost(top: bool) -> Column:
        share = 0.15 if top else 0.12
        sign = 1 if top else -1

        def inside(g: Column) -> Column:
            cy = (g.y0 + g.y1) / 2
            return (cy >= y0) & (cy <= y0 + share * h) if top else (cy >= y1 - share * h) & (cy <= y1)

        def item(glyphs: Column) -> Column:
            low, high = F.array_min(F.transform(glyphs, lambda g: g.y0)), F.array_max(F.transform(glyphs, lambda g: g.y1))
            return F.struct((sign * (low + high) / 2).alias("key"), _joined(glyphs).alias("what"), (high if top else low).alias("edge"))

        near = F.filter(F.coalesce("blocks", F.array()), lambda b: (b.y0 < y0 + share * h) if top else (b.y1 > y1 - share * h))
        own = F.filter(F.transform(near, lambda b: F.filter(_glyphs(b), inside)), lambda g: F.size(g) > 0)
        texts = F.filter(F.transform(own, item), lambda x: x.what != "")
        images = F.transform(
            F.filter(F.coalesce("images", F.array()), lambda i: ((i.y0 < y0 + 0.15 * h) if top else (i.y1 > y1 - 0.15 * h)) & (i.y1 - i.y0 < 0.2 * h)),
            lambda i: F.struct((sign * (i.y0 + i.y1) / 2).alias("key"), i.digest.alias("what"), (i.y1 if top else i.y0).alias("edge")),
        )
        t, i = F.try_element_at(F.array_sort(texts), F.lit(1)), F.try_element_at(F.array_sort(images), F.lit(1))
        return F.struct(t.alias("t"), i.alias("i"))

    def picked(c: str) -> Column:
        t, i = F.col(f"{c}.t"), F.col(f"{c}.i")
        is_text = t.isNotNull() & (i.isNull() | (t.key < i.key))
        pick = F.when(is_text, t).otherwise(i)
        return F.struct(is_text.alias("is_text"), pick.what.alias("what"), pick.edge.alias("edge"), (is_text & T.is_page_number(pick.what)).alias("number"), t.what.alias("first_text"), i.what.alias("first_image"))

    found = layout.withColumns({"_top": outermost(True), "_bottom": outermost(False)})
    return found.withColumns({"top": picked("_top"), "bottom": picked("_bottom")}).drop("_top", "_bottom")


_COLUMNS = ["doc_id", "page_no", "rect", "blocks", "images", "drawings", "tables"]


def clipped(layout: DataFrame, o: Options = Options()) -> DataFrame:
    """The columns of ``layout`` with top_y and bottom_y of each page after its crop; the only shuffle is the window by document."""
    m = margins(layout.select(*_COLUMNS))
    w = Window.partitionBy("doc_id").orderBy("page_no")
    m = m.withColumns({f"{a}_{b}": f(F.col(a)).over(w) for a in ("top", "bottom") for b, f in (("prev", F.lag), ("next", F.lead))})

    def repeats(side: str) -> Column:
        me, texts, same = F.col(side), F.lit(False), F.lit(False)
        for n in ("prev", "next"):
            other = F.col(f"{side}_{n}")
            if side == "top":
                texts = texts | T.shares_words(me.what, other.first_text)
            same = same | F.coalesce(me.what == other.first_image, F.lit(False))
        return F.when(me.is_text, me.number | texts).otherwise(me.what.isNotNull() & same)

    y0, y1 = F.col("rect.y0"), F.col("rect.y1")
    by = (lambda v: (y1 - y0) * v / 100) if o.crop_unit == "pct" else F.lit
    top, bottom = y0 + by(o.crop_top), y1 - by(o.crop_bottom)
    if o.auto_crop_top:
        top = F.when(repeats("top"), F.col("top.edge") + 5).otherwise(top)
    if o.auto_crop_bottom:
        bottom = F.when(repeats("bottom"), F.col("bottom.edge") - 5).otherwise(bottom)
    return m.select(*_COLUMNS, top.alias("top_y"), bottom.alias("bottom_y"))


def clips(layout: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, page_no, top_y, bottom_y) of each page after its crop."""
    return clipped(layout, o).select("doc_id", "page_no", "top_y", "bottom_y")


def _box(v: dict) -> tuple:
    return v["x0"], v["y0"], v["x1"], v["y1"]


def _page(row: dict) -> tuple:
    """Blocks, images, drawings and table candidates of a row, as the page functions take them."""
    from ..functions.page import Glyph

    blocks = [
        {"box": _box(b), "lines": [{"box": _box(ln), "spans": [{"box": _box(s), "font": s["font"], "size": s["size"] or 0.0, "glyphs": [Glyph(g["c"], *_box(g)) for g in s["glyphs"] or () if g["c"]]} for s in ln["spans"] or ()]} for ln in b["lines"] or ()]}
        for b in row["blocks"] or ()
    ]
    images = [{"box": _box(i), "digest": i["digest"]} for i in row["images"] or ()]
    found = []
    for t in row["tables"] or ():
        cells: dict[int, dict[int, tuple]] = {}
        for c in t["cells"] or ():
            cells.setdefault(c["row"], {})[c["col"]] = (None if c["x0"] is None else _box(c), c["raw"])
        rows = [[r.get(k, (None, None)) for k in range(max(r) + 1)] for _, r in sorted(cells.items())]
        if rows:
            found.append({"box": _box(t), "source": t["source"] or "lines", "header": t["header"] or len(rows[0]), "rows": rows})
    return blocks, images, list(row["drawings"] or ()), found


def page_result(row: dict, o: Options, ocr: Callable | None, decoded: tuple | None = None) -> dict:
    """Text, pieces in reading order, and labels of one page; ``decoded`` are its items, if ``row`` doesn't hold them as columns."""
    from ..functions import footer, page as P, tables

    out = {"text": "", "pieces": [], "is_empty": False, "is_mixed": False, "used_ocr": False, "footer_y": None}
    if row["rect"] is None or row["top_y"] is None:
        return out
    rect = _box(row["rect"]) if decoded is None else row["rect"]
    clip = whole = (rect[0], row["top_y"], rect[2], row["bottom_y"])
    blocks, images, drawings, found = decoded or _page(row)
    empty = P.looks_empty(images, blocks, clip)
    regions = P.image_regions(images, blocks, clip)
    out["is_empty"], out["is_mixed"] = empty, not empty and bool(regions)
    use = strategy(o.ocr_strategy)
    pieces: list[tuple[str, tuple, str]] = []
    if use == "force" or use == "auto" and (empty or regions or row["scrambled"]):
        out["used_ocr"] = True
        text = P.clean(ocr(row, whole) or "").strip()
        if text:
            pieces.append(("ocr", whole, text))
    else:
        inside = P.clipped(blocks, clip)
        if o.detect_footer:
            first = [t["box"] for t in found if t["source"] != "mixed"]
            y, _ = footer.footer_top(inside, drawings, clip, first)
            if y is not None and not any(b[1] <= y <= b[3] for b in first):
                clip = (clip[0], clip[1], clip[2], y - 1)
                inside = P.clipped(blocks, clip)
                out["footer_y"] = y
        made = tables.tables(found, blocks, rect, clip, o.table_strategy)
        boxes = [b for b, _ in made]
        pieces += [("table", b, t) for b, t in made]
        body, zone = P.body_size(inside, boxes), clip[3] - 0.12 * (clip[3] - clip[1])
        for b in inside:
            if P.in_any(b["box"], boxes):
                continue
            lines = []
            for r in P.merged_rows(b["lines"]):
                t = P.text_of_spans([s for s in r["spans"] if not P.superscript(s, body)])
                if t and not (r["cy"] >= zone and P.page_number(t)):
                    lines.append(t)
            if lines:
                pieces.append(("text", b["box"], "\n".join(lines)))
    order = P.reading_order([b for _, b, _ in pieces], clip)
    out["pieces"] = [{"kind": pieces[i][0], "text": pieces[i][2], **dict(zip(("x0", "y0", "x1", "y1"), map(float, pieces[i][1])))} for i in order]
    out["text"] = "\n\n".join(p["text"] for p in out["pieces"])
    return out


_PIECES = "pieces array<struct<kind:string,text:string,x0:double,y0:double,x1:double,y1:double>>, "
RESULT = f"doc_id string, page_no int, text string, {_PIECES}is_empty boolean, is_mixed boolean, used_ocr boolean, footer_y double"


def extract_pages(layout: DataFrame, o: Options = Options(), ocr: Callable[[dict, tuple], str] | None = None) -> DataFrame:
    """One row for each page: text, pieces in reading order, labels. ``ocr(page row, box)`` gives the text of a picture."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    _checked(o, ocr)
    joined = clipped(layout, o)
    scrambled = F.lit(False)
    if strategy(o.ocr_strategy) == "auto":
        inside = F.filter(F.coalesce("blocks", F.array()), lambda b: ((b.y0 + b.y1) / 2 >= F.col("top_y")) & ((b.y0 + b.y1) / 2 <= F.col("bottom_y")))
        scrambled = T.looks_scrambled(F.array_join(F.transform(inside, lambda b: _joined(_glyphs(b))), "\n"))
    joined = joined.withColumn("scrambled", scrambled)
    schema = to_arrow_schema(_parse_datatype_string(RESULT))

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            if rows:
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "page_no": r["page_no"], **page_result(r, o, ocr)} for r in rows], schema=schema)

    return joined.mapInArrow(run, RESULT)


# files: a decoder gives all pages of one at once, so nothing is shuffled and no page is ever a row of glyphs


def _checked(o: Options, ocr: Callable | None) -> None:
    if strategy(o.ocr_strategy) in ("auto", "force") and ocr is None:
        raise OcrUnavailableError("the OCR strategy needs an engine; give one, or take the strategy 'never'")
    if o.crop_unit not in ("pct", "px"):
        raise ValueError(f"crop unit must be pct or px: {o.crop_unit!r}")


def _with_neighbours(pages):
    """(page, its margins, those of the pages beside it) in order; two pages at a time are held."""
    from ..functions.page import Margins

    before, held = [], None
    for p in pages:
        m = Margins(p["blocks"], p["images"], p["rect"])
        if held:
            yield *held, before + [m]
            before = [held[1]]
        held = (p, m)
    if held:
        yield *held, before


def crop(page: dict, margins, others: list, o: Options) -> tuple[float | None, float | None]:
    """top_y and bottom_y of a decoded page."""
    if page["rect"] is None:
        return None, None
    _, y0, _, y1 = page["rect"]
    by = (lambda v: (y1 - y0) * v / 100) if o.crop_unit == "pct" else float
    top, bottom = y0 + by(o.crop_top), y1 - by(o.crop_bottom)
    if o.auto_crop_top and (edge := margins.repeats("top", others)) is not None:
        top = edge + 5
    if o.auto_crop_bottom and (edge := margins.repeats("bottom", others)) is not None:
        bottom = edge - 5
    return float(top), float(bottom)


def _map_files(files: DataFrame, decoder: Callable[[dict], Iterable[dict]], schema: str, result: Callable[[dict, float | None, float | None], dict], o: Options) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        out, size = [], 0
        for b in batches:
            for row in range(b.num_rows):
                for p, m, others in _with_neighbours(decoder(b.slice(row, 1).to_pylist()[0])):
                    out.append({"doc_id": p["doc_id"], "page_no": p["page_no"], **result(p, *crop(p, m, others, o))})
                    size += 1
                    if size >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.mapInArrow(run, schema)


def clip_files(files: DataFrame, decoder: Callable[[dict], Iterable[dict]], o: Options = Options()) -> DataFrame:
    """As :func:`clips`, of the pages that ``decoder(row)`` yields in order for each row of ``files``.

    A decoded page is a dict: doc_id, page_no, rect, and blocks, images,
    drawings and tables as :mod:`foliograph.functions.page` takes them.
    """
    return _map_files(files, decoder, "doc_id string, page_no int, top_y double, bottom_y double", lambda p, top, bottom: {"top_y": top, "bottom_y": bottom}, o)


def extract_files(files: DataFrame, decoder: Callable[[dict], Iterable[dict]], o: Options = Options(), ocr: Callable[[dict, tuple], str] | None = None, pieces: bool = True) -> DataFrame:
    """As :func:`extract_pages`, of the pages that ``decoder(row)`` yields (see :func:`clip_files`); the column of pieces can be left out."""
    _checked(o, ocr)
    auto = strategy(o.ocr_strategy) == "auto"

    def result(p: dict, top: float | None, bottom: float | None) -> dict:
        from ..functions import page as P

        inside = [b for b in p["blocks"] if top <= (b["box"][1] + b["box"][3]) / 2 <= bottom] if auto and top is not None else []
        scrambled = bool(inside) and P.looks_scrambled("\n".join("".join(map(P.line_text, b["lines"])).strip() for b in inside))
        return page_result(p | {"top_y": top, "bottom_y": bottom, "scrambled": scrambled}, o, ocr, (p["blocks"], p["images"], p["drawings"], p["tables"]))

    return _map_files(files, decoder, RESULT if pieces else RESULT.replace(_PIECES, ""), result, o)


def documents(pages: DataFrame) -> DataFrame:
    """One row for each document: text, page counts and lists, warnings; a page is empty if it has no text and is not mixed."""
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(f"[^{T.SPACE}]")
    lone = blank & ~F.col("is_mixed")
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("page_no", value.alias("v"))))), lambda x: x.v)
    number = F.col("page_no").cast("string")
    warning = F.concat(F.when(F.col("is_mixed"), F.array(F.concat(F.lit("mixed_page:"), number))).otherwise(F.array()), F.when(lone, F.array(F.concat(F.lit("empty_page:"), number))).otherwise(F.array()))
    return pages.groupBy("doc_id").agg(
        F.array_join(in_order(~blank, F.col("text")), "\n\n").alias("text"),
        F.count(F.lit(1)).alias("pages_total"),
        F.count_if(~blank).alias("pages_with_text"),
        in_order(lone, F.col("page_no")).alias("empty_pages"),
        in_order(F.col("is_mixed"), F.col("page_no")).alias("mixed_pages"),
        F.flatten(in_order(F.lit(True), warning)).alias("warnings"),
    )


def tables(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, place, text) of each table, in reading order."""
    return pages.select("doc_id", "page_no", F.posexplode("pieces").alias("place", "p")).filter("p.kind = 'table'").select("doc_id", "page_no", "place", F.col("p.text").alias("text"))


def layout_items(pages: DataFrame) -> DataFrame:
    """What an overlay draws: (doc_id, page_no, nth, kind, box) of each piece in reading order."""
    return pages.select("doc_id", "page_no", F.posexplode("pieces").alias("place", "p")).select("doc_id", "page_no", (F.col("place") + 1).alias("nth"), "p.kind", "p.x0", "p.y0", "p.x1", "p.y1")
