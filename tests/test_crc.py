"""Whole-file checksums against zlib, behind the first 400 characters too."""

import zlib

import __spark_entry__ as e
from textloom.operators import measure
from textloom.sources.files import events_corpus


def test_file_crc_reads_all(spark, sf):
    files = {r.path: r.content for r in events_corpus(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    got = {r.path: r.file_crc for r in e.queries()["file_crc_src"](spark, sf).collect()}
    assert max(map(len, files.values())) > 400
    assert got == {p: zlib.adler32((t + "\n").encode(), 0) for p, t in files.items()}


def test_equal_heads(spark):
    head = "x = 1;\n" * 100
    rows = spark.createDataFrame([("/a.c", head + "y = 2;\n"), ("/b.c", head + "y = 3;\n")], "path string, content string")
    got = measure.full(rows, "Code").select("file_crc", "nbnc_crc").collect()
    assert got[0].file_crc != got[1].file_crc and got[0].nbnc_crc != got[1].nbnc_crc
