"""Fact tables lie by documents, and hold what their SQL says."""

from pyspark.sql import functions as F

from lectern import facts
from lectern.storage import by_documents


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_what_goes_by_documents_shuffles_no_facts(spark, sf_dir):
    got = facts.tables(spark, sf_dir, {"struct_node", "para", "sheet", "sheet_row", "shape", "html_el", "md_text"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("struct_node", "para", "sheet", "shape", "html_el", "md_text"):
            assert shuffles(got[name].groupBy("doc_id").count()) == 0, name
        n = got["struct_node"]
        child = n.select("doc_id", F.col("parent_id").alias("node_id"))
        with by_documents(spark):
            assert shuffles(n.join(child, ["doc_id", "node_id"], "left_anti")) == 0
        assert shuffles(got["sheet"].join(got["sheet_row"], "doc_id")) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_equal_their_sql(spark, sf_dir):
    made_from = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders", "lineitem")}
    got = facts.tables(spark, sf_dir, {"struct_node", "html_el", "epub_spine", "shape"})
    for name in ("struct_node", "html_el", "epub_spine", "shape"):
        sql = facts.FACTS[name]
        want = spark.sql(sql, **{n: d for n, d in made_from.items() if "{" + n + "}" in sql})
        columns = [c for c in want.columns if c in got[name].columns]
        rows = lambda df: df.groupBy([F.col(c).cast("string").alias(c) for c in columns]).count()
        assert rows(want).exceptAll(rows(got[name])).count() == 0 and got[name].count() == want.count(), name


def test_orders_without_line_items_and_line_items_without_orders(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, 1), (8, 1), (9, 2), (9, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 1, 5), (7, 1, 5), (9, 2, 6), (3, 1, 4), (None, 1, 4)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = facts.tables(spark, str(tmp_path), {"sheet", "para", "html_el", "struct_node"})
    assert {name: df.count() for name, df in got.items()} == {"sheet": 4, "para": 4, "html_el": 8, "struct_node": 2 + 4 + 8}


def test_parts_that_one_stored_table_reads_are_not_stored_too(spark, sf_dir):
    facts.tables(spark, sf_dir, {"md_text", "struct_node"})
    names = {name for app, sf, name in facts._written if app == spark.sparkContext.applicationId and sf == sf_dir}
    assert {"md_text", "struct_node"} <= names and not names & {"parts-md", "parts-pdf-owned"}
