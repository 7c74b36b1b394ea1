"""Command line and streams."""

from foliograph import __main__ as cli, streaming


def test_audit_command_and_stream(spark, tmp_path):
    d = tmp_path / "in" / "doc1"
    d.mkdir(parents=True)
    for i in range(3):
        (d / f"page_{i:03}.txt").write_text('"' * 60 + f"\nline {i}")
    assert cli.main(["audit", "--input-dir", str(tmp_path / "in"), "--out-md", str(tmp_path / "r.md")]) == 0
    text = (tmp_path / "r.md").read_text()
    assert "| doc1 | 3 |" in text and "line 2" in text
    q = streaming.summary_stream(streaming.page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("summary").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.doc, r.pages) for r in spark.table("summary").collect()] == [("doc1", 3)]
    q = streaming.clean_stream(streaming.page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("clean").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("clean").count() == 3
    q = streaming.audit_stream(streaming.page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("audit").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("audit").filter("many_double_quotes").count() == 3


def test_extract_command(spark, tmp_path):
    from test_layout import block, row

    from foliograph.sources import layout as S

    spark.createDataFrame([row([block("some words", 300, 60, rtl=False)])], S.PAGE).write.parquet(str(tmp_path / "pages"))
    assert cli.main(["extract", "-l", str(tmp_path / "pages"), "-o", str(tmp_path / "out")]) == 0
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "some words"
