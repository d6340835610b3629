"""Every engine query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lectern.oracle import oracle_sql
from lectern.queries import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return round(float(value), 9) if hasattr(value, "quantize") else value


def test_each_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, sf_dir, name):
    got = queries()[name](spark, sf_dir)
    want = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    assert rows == sorted(str(tuple(map(plain, r))) for r in want.fetchall())


def test_trees_of_more_rows_than_sparks_recursion_limit(spark):
    from lectern.operators import tree

    nodes = spark.createDataFrame([(1, i, None if i == 0 else 0, i) for i in range(40)], "doc_id long, node_id long, parent_id long, ord int")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        assert tree.labelled(nodes).count() == 40
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
