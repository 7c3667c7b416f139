"""Files are parsed once for each version."""

import os

from pyspark.sql import functions as F

from ledgerloom.sources.incremental import IncrementalFolder


def test_only_changed_files_are_opened(spark, tmp_path):
    source, state, opened = tmp_path / "in", str(tmp_path / "state"), []

    def parse(df):
        opened.append(sorted(os.path.basename(r.path) for r in df.select("path").collect()))
        return df.select("path", F.explode(F.split(F.decode("content", "utf-8"), ",")).alias("word"))

    folder = IncrementalFolder(spark, str(source), state, parse, "*.txt")
    assert folder.refresh() == 0 and folder.rows() is None
    (source / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "x,y"), ("sub/b [1] {2}.txt", "z"), ("sub/c.txt", "w"), ("empty.txt", ""), ("skip.csv", "no")):
        (source / name).write_text(text)
    assert folder.refresh() == 3 and opened == [["a.txt", "b [1] {2}.txt", "c.txt"]]
    words = lambda: sorted((os.path.basename(r.path)[0], r.word) for r in folder.rows().collect())
    assert words() == [("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")]
    assert folder.refresh() == 0 and len(opened) == 1 and len(words()) == 4
    (source / "a.txt").write_text("x,changed")
    (source / "d.txt").write_text("new")
    (source / "sub/c.txt").unlink()
    assert folder.refresh() == 2 and opened[1:] == [["a.txt", "d.txt"]]
    assert words() == [("a", "changed"), ("a", "x"), ("b", "z"), ("d", "new")]
    old = os.stat(source / "d.txt")
    (source / "d.txt").write_text("old")
    os.utime(source / "d.txt", (old.st_atime - 5000, old.st_mtime - 5000))  # an older time is another version, too
    assert folder.refresh() == 1 and ("d", "old") in words() and ("d", "new") not in words()
    # A run that broke off before its record parses again, and its rows don't count twice.
    again = IncrementalFolder(spark, str(source), state, parse, "*.txt")
    parse(again.reader().load(str(source / "a.txt"))).withColumn("run", F.lit("broken")).write.mode("append").parquet(f"{state}/rows")
    assert again.refresh() == 0 and len(words()) == 4
