"""Schema and readers of decoded page layout, page text, and files.

A layout row is one page: its rectangle and, nested, its text blocks, images,
drawn items and table candidates, as a decoder writes them.  Rectangles are in
points, y downwards; page numbers begin at 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BOX = [T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields] + BOX)


GLYPH = _struct(("c", T.StringType()))
SPAN = _struct(("font", T.StringType()), ("size", T.DoubleType()), ("glyphs", T.ArrayType(GLYPH)))
LINE = _struct(("spans", T.ArrayType(SPAN)))
BLOCK = _struct(("lines", T.ArrayType(LINE)))
IMAGE = _struct(("digest", T.StringType()))
DRAWING = _struct(("kind", T.StringType()))
CELL = _struct(("row", T.IntegerType()), ("col", T.IntegerType()), ("raw", T.StringType()))
TABLE = _struct(("source", T.StringType()), ("header", T.IntegerType()), ("cells", T.ArrayType(CELL)))
PAGE = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("rect", T.StructType(BOX)),
        T.StructField("blocks", T.ArrayType(BLOCK)),
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("drawings", T.ArrayType(DRAWING)),
        T.StructField("tables", T.ArrayType(TABLE)),
    ]
)


def read_layout(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Decoded pages; the schema is declared, never inferred."""
    return spark.read.schema(PAGE).format(format).load(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the PDF files in a folder, or of one file; other files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def decode(files: DataFrame, decoder: Callable[[str, bytes], Iterable[dict]]) -> DataFrame:
    """Layout rows of files by ``decoder(name, content)``, which yields a dict like ``PAGE`` a page.

    A file that the decoder can't read is a row of page_no 0 with the message in ``error``.
    """
    import pyarrow as pa

    schema = T.StructType([*PAGE.fields, T.StructField("error", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    rows = [{**p, "error": None} for p in decoder(name, content)]
                except Exception as e:  # a bad file is a row, the others go on
                    rows = [{"doc_id": name, "page_no": 0, "error": str(e)}]
                yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in rows], schema=arrow)

    return files.select("name", "content").mapInArrow(run, schema)


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc, text) of all ``page_*.txt`` below a folder; bytes that are no UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.txt").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("doc"), F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8").alias("text"))


def heads(pages: DataFrame, n: int = 10) -> DataFrame:
    """(path, head): the first n lines of each page."""
    return pages.select("path", F.array_join(F.slice(F.split("text", "\n"), 1, n), "\n").alias("head"))


def write_page_texts(pages: DataFrame, path: str) -> None:
    """One text a page under doc_id=.../page_id=...; rows (doc_id, page_no, text)."""
    pages.select("doc_id", F.format_string("page_%03d", "page_no").alias("page_id"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id", "page_id").text(path)


def write_document_texts(documents: DataFrame, path: str) -> None:
    """One text a document under doc_id=...; rows (doc_id, text)."""
    documents.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
