"""The audit on odd rows and against its SQL, and the entry without the optional operators."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliograph.operators import audit
from foliograph.plans import queries

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_flags(spark):
    rows = [
        ("p1", "d", None), ("p2", "d", ""), ("p3", "d", "potS here )1977( 00123.5 " + "1" * 25), ("p3", "d", "» x « ا ت د م ا"), ("p4", "e", '"' * 50),
        ("p5", "e", "\n".join(["word"] * 60)), ("p6", "e", "المدرسة " * 20), ("p7", None, " ".join(["ةسردملا"] * 20)),
    ]
    got = audit.audit_pages(spark.createDataFrame([(*r, True) for r in rows], "path string, doc string, text string, reversed_latin boolean")).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, []).append(r)
    assert len(got) == len(rows) and by["p1"][0].words == by["p2"][0].words == 0
    a, b = sorted(by["p3"], key=lambda r: r.swapped_guillemets)
    assert a.reversed_latin_tokens == ["potS"] and a.mirrored_parens and a.leading_zero_numbers == ["00123.5"] and a.long_numeric_runs == ["1" * 25]
    assert b.swapped_guillemets and b.spaced_letters
    assert by["p4"][0].many_double_quotes and by["p5"][0].fragmented_lines
    assert not by["p6"][0].full_rtl_reversal and by["p6"][0].start_al_ratio == 1.0 and by["p7"][0].full_rtl_reversal


def test_summary_examples_and_report(spark):
    pages = spark.createDataFrame([(f"p{i}", f"d{i % 2}", '"' * (50 + i)) for i in range(15)], "path string, doc string, text string")
    a = audit.audit_pages(pages)
    assert {r.doc: (r.pages, r.many_double_quotes) for r in audit.summary(a).collect()} == {"d0": (8, 8), "d1": (7, 7)}
    assert [r.path for r in audit.examples(a).orderBy("rank").collect()] == [f"p{i}" for i in range(14, 4, -1)]
    text = audit.report(a, pages.select("path", F.col("text").alias("head")), "2020-01-01")
    assert "many_double_quotes: 15" in text and text.count("- many_double_quotes: `p") == 15
    nothing = audit.audit_pages(pages.limit(0))
    assert nothing.count() == 0 and audit.summary(nothing).count() == 0 and audit.totals(nothing).count() == len(audit.FLAGS)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]

    def norm(v):
        return round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v

    expected = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    got = queries.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == columns
    assert sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr) == expected


def test_entry_without_the_optional_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name in ('corpus_pipeline', 'foliograph.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'audit_pages' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_audit_is_one_map_over_the_pages(spark):
    """Each text goes through one Arrow map; no column expression reads it again and again."""
    pages = spark.createDataFrame([("p", "d", "١ ٢ ٣ ٤ ٥"), ("q", "d", "a\x1fb\x85c"), ("r", "d", "ةكتاب ىلعلم ةدرسة x " + "كلمات " * 60), ("s", "d", "éabC xabC abCDE 0012,3.4 1.2.3,4.5.6.7.8.9.0.1")], "path string, doc string, text string")
    df = audit.audit_pages(pages)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan and "RLIKE" not in plan
    got = {r.path: r for r in df.collect()}
    assert got["p"].spaced_letters and got["p"].arabic_letters == 0
    assert (got["q"].words, got["q"].nonempty_lines) == (3, 2)
    assert got["r"].partial_rtl_corruption and not got["r"].full_rtl_reversal and got["r"].long_ar_tokens == 63
    assert got["s"].reversed_latin_tokens == ["xabC"] and got["s"].leading_zero_numbers == ["0012,3.4"] and got["s"].long_numeric_runs == ["1.2.3,4.5.6.7.8.9.0.1"]
