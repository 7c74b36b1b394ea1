"""Pages and layouts derived from the ``documents`` table, whole texts and all rows.

The tables at hold neither right-to-left text nor page layout; these rules make
some of them, by functions that any SQL engine has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LATIN = "abcdefghijklmnopqrstuvwxyz"
RTL = "وبثجاحخدذرزسشلصضطظعةغفقكمن"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; a scan that leaves most cores idle (few row groups) is spread over them, as the page operators are bound by the CPU."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(2 * cores) if d.rdd.getNumPartitions() < cores else d


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages (path, doc, text) a document: transliterated, transliterated backwards, and with an artefact by doc_id."""
    d = documents(spark, sf_dir)
    t = F.translate(F.lower("text"), LATIN, RTL)
    m = F.col("doc_id") % 8
    text = F.col("text")
    first = F.regexp_extract(text, "^([^ \\n]*)", 1)
    inner = F.regexp_replace(F.substring(text, 1, 40), "[\\n»«]", " ")
    artefact = (
        F.when(m == 0, F.reverse(text))
        .when(m == 1, F.concat(F.lit(")"), first, F.lit("( "), text))
        .when(m == 2, F.concat(F.lit("»"), inner, F.lit("« "), text))
        .when(m == 3, F.concat(F.lit("00"), F.col("doc_id").cast("string"), F.lit(".5 "), text))
        .when(m == 4, F.concat(F.lit("12345678901234567890.25 "), text))
        .when(m == 5, F.concat(F.lit('"' * 60), text))
        .when(m == 6, F.replace(text, F.lit(" "), F.lit("\n")))
        .otherwise(F.concat(F.lit("ا ت د م ا "), text))
    )
    kinds = F.explode(F.array(F.struct(F.lit("fwd").alias("kind"), t.alias("text")), F.struct(F.lit("rev").alias("kind"), F.reverse(t).alias("text")), F.struct(F.lit("art").alias("kind"), artefact.alias("text"))))
    return d.select("doc_id", "source", kinds.alias("k")).select(F.concat_ws("/", "source", "k.kind", F.format_string("page_%08d.txt", "doc_id")).alias("path"), F.concat_ws("/", "source", "k.kind").alias("doc"), F.col("k.text").alias("text"))


PAGES_SQL = f"""pages AS (
  SELECT source || '/' || kind || '/' || format('page_{{:08d}}.txt', doc_id) AS path, source || '/' || kind AS doc,
         CASE kind WHEN 'fwd' THEN translate(lower(text), '{LATIN}', '{RTL}')
                   WHEN 'rev' THEN reverse(translate(lower(text), '{LATIN}', '{RTL}'))
                   ELSE CASE doc_id % 8 WHEN 0 THEN reverse(text)
                     WHEN 1 THEN ')' || regexp_extract(text, '^([^ \\n]*)', 1) || '( ' || text
                     WHEN 2 THEN '»' || regexp_replace(substring(text, 1, 40), '[\\n»«]', ' ', 'g') || '« ' || text
                     WHEN 3 THEN '00' || doc_id || '.5 ' || text
                     WHEN 4 THEN '12345678901234567890.25 ' || text
                     WHEN 5 THEN repeat('"', 60) || text
                     WHEN 6 THEN replace(text, ' ', chr(10))
                     ELSE 'ا ت د م ا ' || text END END AS text
  FROM documents CROSS JOIN (SELECT unnest(['fwd', 'rev', 'art']) AS kind))"""
