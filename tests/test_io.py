import os
from collections import Counter

from quarrylark.plans import registry
from quarrylark.sources import io


def test_text_files_of_any_size(spark, tmp_path):
    """A file above five million bytes keeps its lines; a limit leaves out only where it is given."""
    os.makedirs(tmp_path / "a")
    (tmp_path / "a" / "big.md").write_text(("x" * 99 + "\n") * 60_000)
    (tmp_path / "a" / "small.MD").write_text("one\r\ntwo\rthree\n")
    read = lambda **k: Counter((r.file.rpartition("/")[2], r.line) for r in io.read_text_lines(spark, str(tmp_path), ["md"], **k).collect())
    small = {("small.MD", w): 1 for w in ("one", "two", "three")}
    assert read() == {("big.md", "x" * 99): 60_000} | small
    assert read(limit=1 << 20) == small
    assert read(limit=1 << 20, line_sep="\n") == {("small.MD", "one\r"): 1, ("small.MD", "two\rthree"): 1}


def test_text_folder_scan_keeps_large_files(spark, tmp_path):
    """Titles that fill one file above five million bytes, and a carriage return in a title."""
    d = spark.range(0, 12_000, numPartitions=1).selectExpr("id AS doc_id", "CASE WHEN id = 4 THEN 'a\\rb' WHEN id = 6 THEN NULL ELSE repeat('y', 1000) || chr(10) || 'z' END AS text", "'en' AS lang", "'s' AS source", "10 AS n_chars")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.line: r.n for r in registry.QUERIES["text_folder_scan"](spark, str(tmp_path)).collect()}
    assert got == {"y" * 1000: 5_998, "a\rb": 1, "": 1}
