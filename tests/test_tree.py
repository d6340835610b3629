import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import tree

SCHEMA = "doc_id long, node_id int, parent_id int, ord int, tag string, page int"


def walk(rows):
    """Depth, preorder and last preorder below of each node by a plain walk."""
    below = {}
    for doc, node, parent, place, *_ in rows:
        below.setdefault((doc, parent), []).append((place, node))
    out = {}
    for doc in {r[0] for r in rows}:
        at = 0
        todo = [(n, 1) for _, n in sorted(below.get((doc, None), []), reverse=True)]
        order = []
        while todo:
            node, depth = todo.pop()
            at += 1
            out[doc, node] = [depth, at, at]
            order.append(node)
            todo += [(n, depth + 1) for _, n in sorted(below.get((doc, node), []), reverse=True)]
        parent = {n: p for d, n, p, *_ in rows if d == doc}
        for node in reversed(order):
            if parent[node] is not None:
                out[doc, parent[node]][2] = max(out[doc, parent[node]][2], out[doc, node][2])
    return out


def labels(spark, rows):
    got = tree.labelled(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.doc_id, r.node_id): [r.depth, r.preorder, r.post] for r in got}


def test_labels_of_random_trees(spark):
    rng, rows = random.Random(2), []
    for doc in range(8):
        for node in range(rng.choice([1, 5, 60])):
            parent = None if node == 0 or rng.random() < 0.05 else rng.randrange(max(0, node - 6), node)
            rows.append((doc, node, parent, rng.randrange(3), "P", None if rng.random() < 0.7 else node))
    assert labels(spark, rows) == walk(rows)
    up = {(d, n): (p, page) for d, n, p, _, _, page in rows}

    def page(d, n):
        while n is not None:
            parent, own = up[d, n]
            if own is not None:
                return own
            n = parent

    got = tree.inherited_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.node_id): r.on_page for r in got} == {(r[0], r[1]): page(r[0], r[1]) for r in rows}


def test_nodes_without_a_root_are_left_out(spark):
    rows = [(1, 1, None, 0, "A", None), (1, 2, 1, 0, "B", None), (1, 5, 9, 0, "orphan", None), (1, 6, 5, 0, "below", None), (1, 7, 8, 0, "circle", None), (1, 8, 7, 0, "circle", None), (1, 10, 8, 0, "on it", None)]
    assert labels(spark, rows) == {(1, 1): [1, 1, 2], (1, 2): [2, 2, 2]}
    assert labels(spark, []) == {}


def test_deep_chain_and_wide_node(spark):
    n = 100_000
    chain = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_id"), F.lit(0).alias("ord"), F.when(F.col("id") == 0, 3).alias("page"))
    got = tree.labelled(chain)
    assert got.count() == n and got.filter(f"depth = node_id + 1 and preorder = node_id + 1 and post = {n}").count() == n
    assert tree.inherited_pages(chain).filter("on_page = 3").count() == n
    wide = chain.withColumn("parent_id", F.when(F.col("node_id") > 0, 0)).withColumn("ord", -F.col("node_id"))
    got = tree.labelled(wide)
    assert got.filter(f"node_id = 0 and preorder = 1 and post = {n}").count() == 1
    assert got.filter(f"depth = 2 and preorder = {n} - node_id + 1 and post = preorder").count() == n - 1


@pytest.mark.parametrize("parent, child", [("TOC", "P"), ("TOC", None), ("L", "P"), ("Table", "P"), ("THead", "TD"), ("TBody", "TD"), ("TFoot", "P"), ("TR", "P"), ("Div", "LI"), ("L", "LBody"), ("P", "TOCI"), ("Div", "THead"), ("Div", "TBody"), ("Div", "TFoot")])
def test_misplaced(spark, parent, child):
    rows = [(1, 1, None, 0, parent, None), (1, 2, 1, 0, child or "TOCI", None)]
    got = [(r.tag, r.parent_tag) for r in tree.misplaced(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == ([(child, parent)] if child else [])


def test_nesting_of_intervals(spark):
    """A chain of 3000, siblings, one alone, and others that end together; no pair of intervals is made."""
    from lectern.operators import tree

    rows = [(1, i, 2999) for i in range(3000)] + [(2, 0, 9), (2, 1, 4), (2, 5, 9), (2, 6, 9), (2, 9, 9)] + [(3, 7, 7)]
    got = tree.nesting(spark.createDataFrame(rows, "doc_id long, preorder int, post int"))
    assert {r.doc_id: r.depth for r in got.collect()} == {1: 3000, 2: 4, 3: 1}
    assert "BETWEEN" not in got._jdf.queryExecution().toString().upper() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_elements_without_children_take_no_part_in_the_rounds(spark, monkeypatch):
    from lectern.operators import tree

    most, rounds = [], tree._rounds

    def counted(state, step, name):
        most.append(state.count())
        return rounds(state, step, name)

    monkeypatch.setattr(tree, "_rounds", counted)
    star = [(1, i, None if i == 0 else 0, -i) for i in range(41)] + [(2, 0, None, 0), (3, 5, 6, 0), (3, 6, 5, 0), (3, 7, 5, 0), (4, 1, 9, 0)]
    got = tree.labelled(spark.createDataFrame(star, "doc_id long, node_id long, parent_id long, ord int"))
    assert {(r.doc_id, r.node_id, r.depth, r.preorder, r.post) for r in got.collect()} == {(1, 0, 1, 1, 41), (2, 0, 1, 1, 1)} | {(1, i, 2, 42 - i, 42 - i) for i in range(1, 41)}
    assert most == [4, 2]


def test_places_are_counted_by_ranges_without_another_shuffle(spark):
    from lectern.operators import tree

    star = [(1, i, None if i == 0 else 0, -i, "P", [i], False) for i in range(401)] + [(2, 0, None, 0, "Form", [], True)]
    nodes = tree.labelled(spark.createDataFrame(star, "doc_id long, node_id long, parent_id long, ord int, tag string, mcids array<int>, has_objr boolean"))
    got = tree.leaves(nodes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")
    assert sorted((r.doc_id, r.node_id, r.kind, r.place) for r in got.collect()) == [(1, i, "text", 400 - i) for i in range(1, 401)] + [(2, 0, "form", 0)]
    unlabelled = tree.leaves(nodes.drop("post"))
    assert sorted(map(tuple, unlabelled.collect())) == sorted(map(tuple, got.collect()))
