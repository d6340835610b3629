import os

from pyspark.sql import functions as F

from lectern.operators import incremental
from lectern.sources import files

MANIFEST = "path string, type string, size_bytes long, modified timestamp, digest string"


def scan(rows):
    text = F.col("content").cast("string")
    return rows.filter(text.contains("click here")).select("path", F.lit("LINK.VAGUE").alias("rule"), F.length(text).cast("long").alias("n"))


def test_changed_files_alone_are_scanned_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.md").write_text("click here" if i % 2 else "fine")
    read = lambda: files.discover(spark, f"file://{folder}", ["md"])
    seen = []

    def noted(rows):
        seen.append(sorted(os.path.basename(r.path) for r in rows.select("path").collect()))
        return scan(rows)

    empty = spark.createDataFrame([], MANIFEST)
    first, kept = incremental.scan_changes(read(), empty, scan(read().limit(0)), noted)
    (folder / "1.md").write_text("fine now")
    (folder / "2.md").write_text("click here and here")
    (folder / "3.md").unlink()
    (folder / "7.md").write_text("click here too")
    os.utime(folder / "5.md", (1, 1))
    second, found = incremental.scan_changes(read(), first, kept, noted)
    assert seen == [[f"{i}.md" for i in range(6)], ["1.md", "2.md", "7.md"]]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan(read()).collect()))
    got = {os.path.basename(r.path): (r.status, r.touched) for r in incremental.delta(first, second).collect()}
    assert got == {"0.md": ("unchanged", False), "1.md": ("changed", False), "2.md": ("changed", False), "3.md": ("deleted", False), "4.md": ("unchanged", False), "5.md": ("unchanged", True), "7.md": ("new", False)}
    counts = incremental.delta_inventory(incremental.delta(first, second), "type").first()
    assert (counts.new, counts.changed, counts.unchanged, counts.deleted, counts.touched) == (1, 2, 3, 1, 1)


def test_odd_manifests(spark):
    row = lambda path, day, digest: (path, "md", 1, day, digest)
    import datetime

    day = [datetime.datetime(2026, 1, d) for d in (1, 2, 3)]
    before = spark.createDataFrame([row("a", day[0], "x"), row("a", day[1], "y"), row(None, day[0], "x"), row("b", None, None)], MANIFEST)
    now = spark.createDataFrame([row("a", day[2], "y"), row("a", day[2], "y"), row("b", None, None)], MANIFEST)
    got = {r.path: (r.status, r.touched) for r in incremental.delta(before, now).collect()}
    assert got == {"a": ("unchanged", True), "b": ("unchanged", False)}
    assert incremental.delta(before.limit(0), now.limit(0)).count() == 0
    assert [r.path for r in incremental.modified_since(now, day[1]).distinct().collect()] == ["a"]
