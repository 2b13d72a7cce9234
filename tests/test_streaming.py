from textloom.plans.profile import profile
from textloom.streaming.files import arriving, measured


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.c").write_text("int x; // y\n\n/* z */\n")
    out = []
    sink = lambda df, n: out.extend(df.select("path", "file_total", "file_nbnc", "file_comment").collect())
    go = lambda: measured(arriving(spark, str(tmp_path / "in")), profile("Code"), sink, str(tmp_path / "cp")).awaitTermination(120)
    go()
    (tmp_path / "in/b.c").write_text("int y;\n")
    go()
    assert [(r.path.rpartition("/")[2], r.file_total, r.file_nbnc, r.file_comment) for r in out] == [("a.c", 3, 1, 2), ("b.c", 1, 1, 0)]
