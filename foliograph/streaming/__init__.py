"""The audit and cleaning over a stream of page texts.

All page operators are row-local, so they run unchanged on a streaming frame;
counters by document use a stateful aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import audit


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, doc, text) of page files as they arrive below a folder."""
    stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "page_*.txt").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return stream.select("path", F.element_at(F.split("path", "/"), -2).alias("doc"), F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8").alias("text"))


def audit_stream(pages: DataFrame) -> DataFrame:
    """The audit of each page as it comes."""
    return audit.audit_pages(pages)


def summary_stream(pages: DataFrame) -> DataFrame:
    """Counters by document, for output mode 'update' or 'complete'."""
    return audit.summary(audit.audit_pages(pages))


def clean_stream(pages: DataFrame) -> DataFrame:
    """Page texts repaired as they come."""
    return pages.withColumn("text", T.clean(F.col("text")))
