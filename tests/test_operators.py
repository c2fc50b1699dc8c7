"""DataFrame operators, scalars, the data source and streaming."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire import engine
from quire.functions import scalars as S
from quire.plans import queries, synth
from quire.sources.pdf import PdfDataSource

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in queries.ORACLES if n not in ("decrypt_aes256",)])
def test_query_matches_sql(spark, con, name):
    mine = queries.QUERIES[name](spark, SF).toPandas()
    theirs = con.sql(queries.ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = [sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values)) for d in (mine, theirs)]
    assert rows[0] == rows[1]


def test_bad_documents_are_rows(spark):
    good = synth.text_pdf("a b")
    df = spark.createDataFrame([(1, good), (2, b"junk"), (3, None), (4, b"")], "id long, content binary")
    rows = {r.id: r for r in engine.text(df).collect()}
    assert rows[1].text == "a b" and rows[2].error.startswith("PdfFormatError") and 3 not in rows and rows[4].error
    assert engine.text(df, mode="DROPMALFORMED").count() == 1
    assert {r.id: r.error is None for r in engine.rewrite(df, [engine.remove_unused()]).collect()} == {1: True, 2: False, 4: False}
    with pytest.raises(Exception, match="no objects found"):
        engine.text(df, mode="FAILFAST").collect()


def test_scalars(spark):
    row = spark.range(1).select(
        S.pdf_date(F.lit("D:20240229123456+01'30'")).cast("string").alias("a"), S.pdf_date(F.lit("D:20240230")).cast("string").alias("b"), S.page_ranges(F.lit("1-3,5,7-"), F.lit(8)).alias("c"), S.page_ranges(F.lit("5-2"), F.lit(8)).alias("d"),
        S.page_ranges(F.lit("5-2"), F.lit(8), backwards=True).alias("e"), S.encode_text(F.lit("a(b")).alias("f"), S.encode_text(F.lit("é")).alias("g"), S.rotation(F.lit(-90)).alias("h"), S.clean_text(F.lit("ﬁ\tx​")).alias("i"),
        S.decode_text(F.lit(b"\xfe\xff\x00A").cast("binary")).alias("j"), S.cmyk_to_rgb(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.5)).alias("k"), S.page_box(F.array(*map(F.lit, (0, 0, 10, 10))), F.array(*map(F.lit, (20, 2, 5, 8)))).alias("l"),
    ).first()
    assert row.a == "2024-02-29 11:04:56" and row.b is None and row.c == [0, 1, 2, 4, 6, 7] and row.d is None and row.e == [4, 3, 2, 1]
    assert row.f == "(a\\(b)" and row.g == "<FEFF00E9>" and row.h == 270 and row.i == "fi x" and row.j == "A" and row.k == [128, 0, 128] and row.l == [5, 2, 10, 8]


def test_source_and_sink(spark, tmp_path):
    spark.dataSource.register(PdfDataSource)
    rows = [(f"{i}.pdf", synth.text_pdf(f"page {i}")) for i in range(5)]
    spark.createDataFrame(rows, "name string, content binary").repartition(2).write.format("pdf").mode("append").save(str(tmp_path))
    found = spark.read.format("pdf").option("table", "text").load(str(tmp_path))
    assert sorted(r.text for r in found.collect()) == [f"page {i}" for i in range(5)]
    assert engine.read_pdfs(spark, str(tmp_path)).count() == 5
    assert spark.read.format("pdf").option("table", "pages").option("partitionBytes", "1").load(str(tmp_path)).count() == 5


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(synth.text_pdf(f"page {i}"))
    q = engine.stream_table(spark, str(tmp_path / "in"), "text").writeStream.format("memory").queryName("quire_stream").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.sql("select text from quire_stream").collect()) == [f"page {i}" for i in range(3)]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(queries.QUERIES) > 40


def test_command_line(spark, tmp_path, capsys):
    from quire.__main__ import main, parse_ranges

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(synth.text_pdf("\n".join(f"line {i} {j}" for j in range(120))))
    path, out = str(tmp_path / "in"), tmp_path / "out"
    assert main(["text", path, "--json"], spark) == 0 and "line 1 119" in capsys.readouterr().out
    assert main(["select", path, "--out", str(out), "--pages", "3,1"], spark) == 0
    found = spark.read.format("pdf").option("table", "text").load(str(out)).collect()
    assert sorted((r.path[-5:], r.page_index, r.text.split("\n")[0]) for r in found) == [(f"{i}.pdf", p, f"line {i} {j}") for i in range(2) for p, j in ((0, 100), (1, 0))]
    assert main(["merge", path, "--out", str(tmp_path / "m")], spark) == 0
    assert spark.read.format("pdf").option("table", "pages").load(str(tmp_path / "m")).count() == 6
    assert parse_ranges("1-3,5,7-", 8) == [0, 1, 2, 4, 6, 7]
    with pytest.raises(ValueError):
        parse_ranges("5-2", 8)


@pytest.mark.parametrize("name", ["xml_entities", "pdfdoc_text", "parse_pdf_date", "xmp_property"])
def test_scalar_queries_match_sql(spark, name):
    import duckdb

    from quire.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("customer", "part", "orders"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    c = sorted(want.columns)
    assert sorted(map(str, got[c].values.tolist())) == sorted(map(str, want[c].values.tolist()))


@pytest.mark.parametrize("rows", [[("a.pdf", b"x"), ("a.pdf", b"y")], [("a.pdf", None)], [(None, b"x")], [("../a.pdf", b"x")]])
def test_sink_refuses_what_would_be_lost(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "name string, content binary").repartition(2)
    with pytest.raises(Exception):
        df.write.format("pdf").mode("append").save(str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_sink_keeps_folders_and_files_that_are_there(spark, tmp_path):
    write = lambda rows, mode: spark.createDataFrame(rows, "name string, content binary").write.format("pdf").mode(mode).save(str(tmp_path))
    write([("x/a.pdf", b"1"), ("y/a.pdf", b"2")], "append")
    with pytest.raises(Exception):
        write([("x/a.pdf", b"3")], "append")
    write([("y/a.pdf", b"4")], "overwrite")
    assert (tmp_path / "x/a.pdf").read_bytes() == b"1" and (tmp_path / "y/a.pdf").read_bytes() == b"4"
