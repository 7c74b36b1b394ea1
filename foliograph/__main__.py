"""Command line: ``python -m foliograph extract|audit``."""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import audit
from .plans import extract
from .sources import layout


def _extract(spark: SparkSession, a: argparse.Namespace) -> int:
    options = extract.Options(a.crop_top, a.crop_bottom, a.crop_unit, not a.no_auto_crop_top, not a.no_auto_crop_bottom, not a.no_footer_detection, a.ocr_strategy, a.table_strategy)
    pages = layout.read_layout(spark, a.layout) if a.layout else None
    if pages is None:
        module, _, name = a.decoder.partition(":")
        decoded = layout.decode(layout.read_files(spark, a.input), getattr(importlib.import_module(module), name))
        decoded = decoded.persist()
        for r in decoded.filter("error is not null").select("doc_id", "error").toLocalIterator():
            print(f"{r.doc_id}: {r.error}", file=sys.stderr)
        pages = decoded.filter("error is null").drop("error")
    layout.write_document_texts(extract.documents(extract.extract_pages(pages, options)).select("doc_id", "text"), a.output)
    return 0


def _audit(spark: SparkSession, a: argparse.Namespace) -> int:
    pages = layout.read_page_texts(spark, a.input_dir)
    found = audit.audit_pages(pages).persist()
    Path(a.out_md).write_text(audit.report(found, layout.heads(pages), str(date.today())), "utf-8")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliograph", description=__doc__)
    sub = p.add_subparsers(required=True)
    e = sub.add_parser("extract", help="texts of documents")
    source = e.add_mutually_exclusive_group(required=True)
    source.add_argument("-l", "--layout", help="decoded pages as Parquet")
    source.add_argument("-i", "--input", help="a PDF file, or a folder of them; needs --decoder")
    e.add_argument("--decoder", help="module:function that decodes (name, bytes) into pages")
    e.add_argument("-o", "--output", required=True)
    for side in ("top", "bottom"):
        e.add_argument(f"--crop-{side}", default=0.0, type=float)
        e.add_argument(f"--no-auto-crop-{side}", action="store_true")
    e.add_argument("--crop-unit", choices=("pct", "px"), default="pct")
    e.add_argument("--no-footer-detection", action="store_true")
    e.add_argument("--ocr-strategy", choices=extract.STRATEGIES, default="never")
    e.add_argument("--table-strategy", choices=("lines", "lines_strict", "text"))
    e.set_defaults(run=_extract)
    d = sub.add_parser("audit", help="report on page texts")
    d.add_argument("--input-dir", required=True)
    d.add_argument("--out-md", required=True)
    d.set_defaults(run=_audit)
    a = p.parse_args(argv)
    if getattr(a, "input", None) and not a.decoder:
        p.error("--input needs --decoder")
    spark = SparkSession.builder.getOrCreate()
    try:
        return a.run(spark, a)
    except extract.ExtractionError as x:
        print(x, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
