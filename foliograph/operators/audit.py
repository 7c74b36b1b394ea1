"""Quality audit of extracted page text: flags by page, counters by document, worst examples by flag.

A page is a row (path, doc, text); a NULL text is the empty text, a repeated
row is another page, and other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import quality as Q

FLAGS = ("full_rtl_reversal", "partial_rtl_corruption", "spaced_letters", "reversed_latin", "mirrored_parens", "swapped_guillemets", "leading_zero_numbers", "long_numeric_runs", "many_double_quotes", "fragmented_lines")


def audit_pages(pages: DataFrame) -> DataFrame:
    """One row for each page: counts, reversal ratios, flags and offending tokens; one Arrow map, in which each text is read by plain searches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"path string, doc string, {Q.SCHEMA}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                rows = [Q.page(t) for t in part.column(2).to_pylist()]
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[2:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), *made], schema=arrow)

    return pages.select("path", "doc", F.coalesce(F.col("text"), F.lit("")).alias("t")).mapInArrow(run, schema)


def flag(name: str) -> Column:
    """Whether a flag holds; a list of tokens does where it isn't empty."""
    return F.size(name) > 0 if name in ("leading_zero_numbers", "long_numeric_runs") else F.col(name)


def summary(audit: DataFrame) -> DataFrame:
    """Pages and pages with each flag, by document."""
    return audit.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(flag(f)).alias(f) for f in FLAGS])


def totals(audit: DataFrame) -> DataFrame:
    """Pages with each flag, over all documents."""
    return audit.agg(*[F.count_if(flag(f)).alias(f) for f in FLAGS]).unpivot([], list(FLAGS), "flag", "pages")


#: What makes a page a worse example of a flag.
KEYS = {
    "full_rtl_reversal": lambda: (F.col("end_la_ratio") - F.col("start_al_ratio"), F.col("unlikely_start_ratio")),
    "partial_rtl_corruption": lambda: (F.col("unlikely_start_ratio"), F.lit(0.0)),
    "spaced_letters": lambda: (F.col("words").cast("double"), F.lit(0.0)),
    "reversed_latin": lambda: (F.size("reversed_latin_tokens").cast("double"), F.lit(0.0)),
    "mirrored_parens": lambda: (F.col("words").cast("double"), F.lit(0.0)),
    "swapped_guillemets": lambda: (F.col("words").cast("double"), F.lit(0.0)),
    "leading_zero_numbers": lambda: (F.size("leading_zero_numbers").cast("double"), F.lit(0.0)),
    "long_numeric_runs": lambda: (F.size("long_numeric_runs").cast("double"), F.lit(0.0)),
    "many_double_quotes": lambda: (F.col("quote_count").cast("double"), F.lit(0.0)),
    "fragmented_lines": lambda: (-F.col("words_per_line"), F.lit(0.0)),
}


def flagged(audit: DataFrame) -> DataFrame:
    """A row (flag, doc, path, key, second) for each flag of each page."""
    each = F.array(*[F.struct(F.lit(f).alias("flag"), flag(f).alias("on"), KEYS[f]()[0].alias("key"), KEYS[f]()[1].alias("second")) for f in FLAGS])
    return audit.select("doc", "path", F.explode(F.filter(each, lambda x: x.on)).alias("f")).select("f.flag", "doc", "path", "f.key", "f.second")


def examples(audit: DataFrame, most: int = 10) -> DataFrame:
    """The worst pages of each flag, in order."""
    w = Window.partitionBy("flag").orderBy(F.desc("key"), F.desc("second"), "path")
    return flagged(audit).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("flag", "rank", "doc", "path")


def report(audit: DataFrame, heads: DataFrame, title_date: str) -> str:
    """Markdown of counters, examples (with the pages' first lines from ``heads``: path, head) and flagged pages."""
    out = [f"# Page text audit ({title_date})", "", "| document | pages | " + " | ".join(FLAGS) + " |", "|" + "---|" * (len(FLAGS) + 2)]
    for r in summary(audit).orderBy(F.desc("pages"), "doc").toLocalIterator():
        out.append("| " + " | ".join(str(v) for v in r) + " |")
    last = None
    for r in examples(audit).join(heads, "path", "left").orderBy("flag", "rank").toLocalIterator():
        if r.flag != last:
            out += ["", f"## {r.flag}", ""]
            last = r.flag
        out += [f"- `{r.path}`", "", *(f"      {x}" for x in (r["head"] or "").split("\n")), ""]
    for r in totals(audit).orderBy("flag").toLocalIterator():
        out += [f"{r.flag}: {r.pages}"]
    out += ["", "## Flagged pages", ""]
    for r in flagged(audit).orderBy("flag", "doc", "path").toLocalIterator():
        out.append(f"- {r.flag}: `{r.path}`")
    return "\n".join(out) + "\n"
