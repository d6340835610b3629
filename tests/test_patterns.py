"""Apportioned samples and patterns of folders on small tables."""

from pyspark.sql import functions as F

from lectern.operators import analytics


def test_quotas_sum_to_the_size(spark):
    rows = [("a", "x")] * 50 + [("a", None)] * 25 + [(None, None)] * 24 + [("b", "x")]
    docs = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], "doc long, folder string, type string, quota string")
    for size, want in ((10, {("a", "x"): 5, ("a", None): 3, (None, None): 2}), (1000, {("a", "x"): 50, ("a", None): 25, (None, None): 24, ("b", "x"): 1}), (0, {})):
        assert {(r.folder, r.type): r.quota for r in analytics.apportioned(docs, ["folder", "type"], size).collect()} == want
        plain = docs.drop("quota")
        got = analytics.apportioned_sample(plain, ["folder", "type"], [F.col("doc")], size)
        assert got.columns == plain.columns and got.count() == min(size, 100)
    assert analytics.apportioned(docs.limit(0), ["folder"], 5).count() == 0


def test_patterns_at_every_level(spark):
    docs = spark.createDataFrame([(1, "a/b/1.pdf"), (2, "a/b/2.docx"), (3, "a/3.pdf"), (4, "4.pdf"), (5, None)], "doc long, path string")
    found = spark.createDataFrame([(1, "pdf", "R", "1.1.1"), (1, "pdf", "R", "1.1.1"), (2, "docx", "R", "1.1.1"), (3, "pdf", "S", "2.4.2"), (5, "pdf", "S", None)], "doc long, type string, rule string, wcag string")
    got = {(r.folder, r.rule): (r.hit, r.files, r.pattern) for r in analytics.folder_patterns(found, docs).collect()}
    assert got == {("", "R"): (2, 4, "widespread"), ("a", "R"): (2, 3, "widespread"), ("a/b", "R"): (2, 2, "systemic"), ("", "S"): (1, 4, "isolated"), ("a", "S"): (1, 3, "isolated")}
    wide = {(r.folder, r.wcag, r.types, r.files) for r in analytics.criteria_across_types(found, docs).collect()}
    assert wide == {(f, "1.1.1", "docx, pdf", 2) for f in ("", "a", "a/b")}
    assert analytics.folder_patterns(found.limit(0), docs).count() == 0


def test_equal_places_are_settled_by_the_order_of_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from lectern.queries import queries

    flags = ["R", "A", "N"]
    rows = [(1, 12 * k, flags[(i + k) % 3], 1) for i in range(60) for k in range(12)] + [(1, 12 * k + 1, flags[k % 3], 2) for k in range(12)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_linenumber int").withColumn("l_shipdate", F.lit(None).cast("timestamp"))
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.rule: r.severity for r in queries()["consolidate_pages"](spark, str(tmp_path)).collect()}
    assert got == {"R0": "Error", "R1": "Error"}
