"""Single files, byte for byte."""

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import single_file

ODD = ["plain", "a,b", 'say "x"', "two\nlines", "cr\rhere", "", None, " lead", "ünïcode 😀", "x" * 5000, '"', "tab\t"]


def plain(columns, rows, bom=True):
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    return (b"\xef\xbb\xbf" if bom else b"") + out.getvalue().encode()


@pytest.mark.parametrize("bom", [True, False])
def test_a_spreadsheet_of_all_ranges(spark, tmp_path, bom):
    n = 3000
    df = spark.range(n, numPartitions=7).withColumn("k", F.expr(f"(id * 7919) % {n}")).withColumn("a,b", F.element_at(F.array(*(F.lit(x) for x in ODD)), (F.col("k") % len(ODD) + 1).cast("int"))).withColumn("half", F.when(F.col("k") % 3 == 0, "kept"))
    path = f"{tmp_path}/out 1.csv"
    size = single_file.write_csv(df, f"file://{path}".replace(" ", "%20"), ["k"], ["k", "a,b", "half"], bom)
    want = plain(["k", "a,b", "half"], [(k, ODD[k % len(ODD)], "kept" if k % 3 == 0 else None) for k in range(n)], bom)
    got = open(path, "rb").read()
    assert got == want and size == len(want)
    assert os.listdir(tmp_path) == ["out 1.csv"]


def test_ties_repeats_nulls_and_no_rows(spark, tmp_path):
    path = f"{tmp_path}/t.txt"
    rows = [(1, "b"), (1, "b"), (None, "z"), (1, "a"), (2, None), (1, "b")]
    df = spark.createDataFrame(rows, "key int, line string").repartition(3)
    assert single_file.write_lines(df, path, ["key"], header="top", end="\n") == len(b"top\nz\na\nb\nb\nb\n\n")
    assert open(path, "rb").read() == b"top\nz\na\nb\nb\nb\n\n"
    assert single_file.write_lines(df.limit(0), path, ["key"]) == 0 and open(path, "rb").read() == b""
    single_file.write_csv(df.limit(0), path, ["key"])
    assert open(path, "rb").read() == plain(["key", "line"], [])
    one = spark.createDataFrame([("",), ("x",)], "only string")
    single_file.write_csv(one, path, ["only"], bom=False)
    assert open(path, "rb").read() == plain(["only"], [("",), ("x",)], False)


def test_a_failed_job_leaves_the_old_file(spark, tmp_path):
    path = f"{tmp_path}/t.txt"
    open(path, "w").write("old")
    bad = spark.range(10).select("id", F.expr("if(id = 7, raise_error('stop'), 'x')").alias("line"))
    with pytest.raises(Exception, match="stop"):
        single_file.write_lines(bad, path, ["id"])
    assert open(path).read() == "old" and os.listdir(tmp_path) == ["t.txt"]
    with pytest.raises(ValueError, match="shared folder"):
        single_file.write_lines(bad, "hdfs://host/x", ["id"])


def test_fragments_in_order(spark, tmp_path):
    path = f"{tmp_path}/r.md"
    df = spark.createDataFrame([(2, 1, "- b"), (1, 0, "# Top"), (2, 0, "## Two\n"), (2, 2, "- c"), (10, 0, "## Ten")], "section int, place long, text string")
    single_file.write_markdown(df, path)
    assert open(path).read() == "# Top\n## Two\n\n- b\n- c\n## Ten\n"
