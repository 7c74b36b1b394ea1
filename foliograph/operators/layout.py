"""Relational operators on exploded layout: glyph rows, sizes, gutters, spatial joins, notes, tables.

Keys of a page are (doc_id, page_no); all joins and windows are on them or on
finer keys, so one hash partitioning by page serves.  Rows whose key or needed
coordinate is NULL belong to no page and are left out by joins; an empty input
gives an empty result; repeated rows count as often as they occur; columns not
named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import page as P, text as T

PAGE = ["doc_id", "page_no"]


def glyphs(layout: DataFrame) -> DataFrame:
    """(doc_id, page_no, block, line, span, place, font, size, c, x0, y0, x1, y1): every glyph of nested pages."""
    b = layout.select(*PAGE, F.posexplode("blocks").alias("block", "b")).select(*PAGE, "block", F.posexplode("b.lines").alias("line", "l"))
    s = b.select(*PAGE, "block", "line", F.posexplode("l.spans").alias("span", "s"))
    return s.select(*PAGE, "block", "line", "span", "s.font", "s.size", F.posexplode("s.glyphs").alias("place", "g")).select(*PAGE, "block", "line", "span", "place", "font", "size", "g.c", "g.x0", "g.y0", "g.x1", "g.y1")


def row_texts(glyph: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row and text of right-to-left glyph rows: rows part where y0 jumps by 3, spaces stand for blanks and wide gaps.

    The glyphs of a key are gathered into one list by the only shuffle.
    """
    each = glyph.filter("c is not null").groupBy(*keys).agg(F.collect_list(F.struct("c", "x0", "y0", "x1", "y1")).alias("_glyphs"))
    return _row_texts(each, keys, ["_glyphs"], lambda glyphs: [P.Glyph(*g.values()) for g in glyphs])


def run_texts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`row_texts`, of keys whose glyphs are one row (text, x0, step, width, y0, y1) in even steps; nothing is shuffled."""
    return _row_texts(runs, keys, ["text", "x0", "step", "width", "y0", "y1"], P.Run)


def _row_texts(rows: DataFrame, keys: list[str], columns: list[str], made: Callable) -> DataFrame:
    schema = ST.StructType([*(rows.schema[k] for k in keys), ST.StructField("row", ST.LongType()), ST.StructField("text", ST.StringType())])
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches):
        for b in batches:
            at, row, text = [], [], []
            for i, v in enumerate(zip(*(c.to_pylist() for c in b.columns[n:]))):
                for k, t in P.visual_rows(made(*v)):
                    at.append(i)
                    row.append(k)
                    text.append(t)
            own = b.select([*range(n)]).take(pa.array(at, pa.int64()))  # never the glyphs
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own.columns, arrow)), pa.array(row, pa.int64()), pa.array(text, pa.string())], schema=arrow)

    return rows.select(*keys, *columns).mapInArrow(run, schema)


def body_sizes(spans: DataFrame) -> DataFrame:
    """Median size of each page's characters below 20; spans are (doc_id, page_no, size, n characters)."""
    small = spans.filter((F.col("size") < 20) & (F.col("n") > 0))
    return small.groupBy(*PAGE).agg(F.expr("percentile(size, 0.5D, n)").alias("body_size"))


def page_fonts(spans: DataFrame) -> DataFrame:
    """The rounded size with most characters of each page (ties: the one that comes first)."""
    sizes = spans.filter((F.rint("size") < 20) & (F.col("n") > 0)).groupBy(*PAGE, F.rint("size").cast("int").alias("size")).agg(F.sum("n").alias("n"), F.min("place").alias("first"))
    return sizes.groupBy(*PAGE).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("main_size"), F.sum("n").alias("characters"))


def gutters(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_no, mid_x): middle of the longest strip in the middle 40 % that no narrow box covers, if 10 wide, else of the page; boxes are (doc_id, page_no, x0, x1, left, width)."""
    w = F.col("width")
    low, high = F.floor(F.greatest(F.lit(0.0), F.col("x0") - F.col("left"))), F.floor(F.least(w, F.col("x1") - F.col("left")))
    narrow = F.when((F.col("x1") - F.col("x0") <= 0.6 * w) & (high > low), F.struct(low.cast("int").alias("a"), high.cast("int").alias("b")))
    each = boxes.groupBy(*PAGE, "left", "width").agg(F.collect_set(narrow).alias("spans"))
    schema = ST.StructType([*(boxes.schema[k] for k in PAGE), ST.StructField("mid_x", ST.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            mid = []
            for left, width, spans in zip(*(c.to_pylist() for c in b.columns[2:])):
                start, n = P.longest_gap([(x["a"], x["b"]) for x in spans], width)
                mid.append(float(left + start + n / 2 if n >= 10 else left + width / 2))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns[:2], arrow)), pa.array(mid, pa.float64())], schema=arrow)

    return each.mapInArrow(run, schema)


def _inside(cx: Column, cy: Column, slack: float = 0.0) -> Column:
    return (cx >= F.col("t.x0")) & (cx <= F.col("t.x1")) & (cy >= F.col("t.y0") - slack) & (cy <= F.col("t.y1") + slack)


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """The blocks whose centre is in no table of their page."""
    b, t = blocks.alias("b"), tables.alias("t")
    on = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page_no") == F.col("t.page_no")) & _inside((F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2)
    return b.join(t, on, "left_anti")


def leaf_tables(tables: DataFrame) -> DataFrame:
    """Tables that hold no other table of their page (within 1); table_id tells them apart."""
    a, t = tables.alias("a"), tables.alias("t")
    on = (F.col("a.doc_id") == F.col("t.doc_id")) & (F.col("a.page_no") == F.col("t.page_no")) & (F.col("a.table_id") != F.col("t.table_id"))
    on = on & (F.col("a.x0") <= F.col("t.x0") + 1) & (F.col("a.y0") <= F.col("t.y0") + 1) & (F.col("a.x1") >= F.col("t.x1") - 1) & (F.col("a.y1") >= F.col("t.y1") - 1)
    return a.join(t, on, "left_anti")


def note_starts(tips: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, page_no, y): top of the notes; tips are (doc_id, page_no, num, y), references (doc_id, page_no, num, y0)."""
    r, t = references.alias("r"), tips.alias("t")
    on = (F.col("r.doc_id") == F.col("t.doc_id")) & (F.col("r.page_no") == F.col("t.page_no")) & (F.col("r.num") == F.col("t.num")) & (F.col("t.y") < F.col("r.y0"))
    last = r.join(t, on, "left_semi").groupBy(*PAGE, "num").agg(F.max("y0").alias("y0"))
    return last.groupBy(*PAGE).agg(F.min("y0").alias("y"))


def table_texts(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_id, text) of grids (row, col, value, merged): merged cells filled from above, empty columns and rows left out, poor grids dropped."""
    key = [*PAGE, "table_id"]
    down = Window.partitionBy(*key, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.last(F.when(~F.col("merged") | (F.col("row") == 0), F.when(F.col("merged"), "").otherwise(F.coalesce("value", F.lit("")))), ignorenulls=True).over(down), F.lit(""))
    full = cells.withColumn("v", F.regexp_replace(F.regexp_replace(T.strip(value), "[\r\n\t]+", " "), " +", " "))
    grid = full.withColumn("used", F.max(F.col("v") != "").over(Window.partitionBy(*key, "col"))).withColumn("height", F.size(F.collect_set("row").over(Window.partitionBy(*key)))).filter(F.col("used") & (F.col("height") >= 2))
    lines = grid.groupBy(*key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x.v), " | ").alias("line"), F.max(F.col("v") != "").alias("any")).filter("any")
    text = lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x.line), "\n").alias("text"))
    pipes = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    return text.filter(F.length(F.regexp_replace("text", f"[|{T.SPACE}]+", "")) >= 0.5 * pipes)
