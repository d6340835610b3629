"""Structure trees: labels, orders, inversions and linear reading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.storage import stored, table_by


def _before(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over earlier rows of equal keys.

    Rows are range-sorted by key and order, so that a key with very many rows lies in many ranges; each
    range lies in one file and is summed by itself, without another shuffle. Only the first key of a range has rows
    in ranges before it, so that what these carry is a row a range at most, handed to every task.
    """
    spark = rows.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(files, *keys, *order).withColumn("lectern_range", F.spark_partition_id())
    sorted_ = spark.table(table_by(ranged, "ranges", files, "lectern_range"))
    each = sorted_.groupBy(*keys, "lectern_range").agg(F.sum(value).alias("lectern_sum"))
    earlier = Window.partitionBy(*keys).orderBy("lectern_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(each.withColumn("lectern_base", F.sum("lectern_sum").over(earlier)).filter("lectern_base is not null").drop("lectern_sum"), "carried")
    inside = Window.partitionBy(*keys, "lectern_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = sorted_.withColumn("lectern_part", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [part[k].eqNullSafe(carried[k]) for k in (*keys, "lectern_range")]
    both = part.join(F.broadcast(carried), [*same], "left").select(*(part[c] for c in sorted_.columns), (F.col("lectern_part") + F.coalesce("lectern_base", F.lit(0))).alias("before"))  # a row a range
    return both.drop("lectern_range")


def _rounds(state: DataFrame, step, name: str) -> DataFrame:
    """Pointer doubling: ``step`` joins each row with the row that ``up`` names, until no row has an ``up`` left.

    ``up`` leaps 1, 2, 4, ... levels, so rounds grow with the logarithm of the depth. Each round is stored.
    Rows that still have one when the leap is longer than there are rows hang on a circle.
    """
    state, leap, most = stored(state, name), 1, None
    while state.filter("up is not null").limit(1).count():
        most = most or state.count()
        if leap > most:
            break
        state = stored(step(state), name)
        leap *= 2
    return state


def labelled(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, node_id, parent_id, ord, tag, ...) with depth, preorder and post.

    ``post`` is the last preorder number of the subtree, so that closure becomes an interval test.
    Rows are of fixed width and rounds are logarithmic in the depth: a first doubling over ancestors
    sums up subtree sizes and depths, a running sum over siblings (by ord, then node_id) gives each
    node's distance from its parent, and a second doubling adds these up along the way from the root.
    Roots have a null parent; nodes whose ancestors are missing or run in a circle are left out.
    """
    slim = nodes.select("doc_id", "node_id", "parent_id", "ord")
    held = slim.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    parted = stored(slim.join(held, ["doc_id", "node_id"], "left"), "parted")
    # most elements hold none: they hang on their parents' labels and take no part in the rounds
    lowest = "kids is null and parent_id is not null"
    inner = parted.filter(f"not ({lowest})")
    among = inner.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("inner_kids"))
    own = F.coalesce("kids", F.lit(0)) - F.coalesce("inner_kids", F.lit(0)) + 1
    start = inner.join(among, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("depth"), own.alias("size"), F.col("node_id").alias("top"))

    def sizes(state: DataFrame) -> DataFrame:
        # what has its ancestor one leap up here adds its own part of the subtree there
        below = state.filter("up is not null").groupBy("doc_id", F.col("up").alias("node_id")).agg(F.sum("size").alias("more"))
        above = state.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("higher"), F.col("top").alias("over"))
        got = state.join(below, ["doc_id", "node_id"], "left").join(above, ["doc_id", "up"], "left")
        return got.select(
            "doc_id", "node_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("higher", F.lit(0))).alias("depth"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.coalesce("over", F.when(F.col("up").isNull(), F.col("top"))).alias("top"),
        )

    sized = _rounds(start, sizes, "sizes").filter("up is null").drop("up")
    root = inner.filter("parent_id is null").select("doc_id", F.col("node_id").alias("top"))
    sized = inner.drop("kids").join(sized.join(root, ["doc_id", "top"], "left_semi").drop("top"), ["doc_id", "node_id"])
    low = parted.filter(lowest).drop("kids").withColumns({"depth": F.lit(None).cast("long"), "size": F.lit(1).cast("long")})
    steps = stored(_before(sized.unionByName(low), ["doc_id", "parent_id"], ["ord", "node_id"], "size"), "steps")

    def places(state: DataFrame) -> DataFrame:
        above = state.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("preorder").alias("higher"))
        return state.join(above, ["doc_id", "up"], "left").select("doc_id", "node_id", F.col("next").alias("up"), (F.col("preorder") + F.coalesce("higher", F.lit(0))).alias("preorder"), "depth", "size")

    begin = steps.filter("depth is not null").select("doc_id", "node_id", F.col("parent_id").alias("up"), (F.col("before") + 1).alias("preorder"), "depth", "size")
    placed = _rounds(begin, places, "places").drop("up")
    above = placed.select("doc_id", F.col("node_id").alias("parent_id"), F.col("preorder").alias("higher"), (F.col("depth") + 1).alias("depth"))
    hung = steps.filter("depth is null").drop("depth").join(above, ["doc_id", "parent_id"]).select("doc_id", "node_id", (F.col("higher") + F.col("before") + 1).alias("preorder"), "depth", "size")
    placed = placed.unionByName(hung)
    labels = placed.select("doc_id", "node_id", F.col("depth").cast("int").alias("depth"), F.col("preorder").cast("int").alias("preorder"), (F.col("preorder") + F.col("size") - 1).cast("int").alias("post"))
    return nodes.drop("depth", "preorder", "post").join(labels, ["doc_id", "node_id"])


def nesting(rows: DataFrame) -> DataFrame:
    """doc_id, depth: how many of these intervals (doc_id, preorder, post) lie in each other at most.

    A running sum over where they open (+1) and end (-1), by ranges, so that neither pairs nor a document's rows meet in one task.
    """
    step = lambda at, shut, by: F.struct(F.col(at).alias("at"), F.lit(shut).alias("shut"), F.lit(by).alias("step"))
    events = rows.select("doc_id", F.explode(F.array(step("preorder", 0, 1), step("post", 1, -1))).alias("e")).select("doc_id", "e.*")
    return _before(events, ["doc_id"], ["at", "shut"], "step").filter("shut = 0").groupBy("doc_id").agg((F.max("before") + 1).alias("depth"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Elements with content of their own and no child, with their place in reading order (from 0).

    Places are running counts by ranges, so that no document is sorted in one task. Where labels tell the last
    preorder number below an element (``post``), one without a child has its own.
    """
    own = nodes.filter("size(mcids) > 0 or has_objr")
    if "post" in nodes.columns:
        own = own.filter("post = preorder")
    else:
        own = own.join(nodes.filter("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct(), ["doc_id", "node_id"], "left_anti")
    kind = F.when(F.col("tag") == "Form", "form").otherwise("text").alias("kind")
    placed = _before(own.select("doc_id", "node_id", "tag", kind, "preorder", F.lit(1).alias("one")), ["doc_id"], ["preorder"], "one")
    return placed.select("doc_id", "node_id", "tag", "kind", F.col("before").cast("int").alias("place"))


#: Pages with more contents than this are counted by merging, smaller ones pair by pair inside the JVM.
LARGE_PAGE = 64


def inversion_rates(tree: DataFrame, paint: DataFrame) -> DataFrame:
    """Per page: contents on both sides and the share of pairs painted in another order than the tree has.

    A content that the tree names twice counts at its last place. Fewer than two give 0. The contents
    of a page are one array; a large page is counted by merge sort in numpy, n log n.
    """
    last = tree.groupBy("doc_id", "page", "mcid").agg(F.max("pos").alias("place"))
    sizes = tree.groupBy("doc_id", "page").agg(F.count("*").alias("tree_n")).join(paint.groupBy("doc_id", "page").agg(F.count("*").alias("paint_n")), ["doc_id", "page"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda x: x["place"])
    pages = paint.join(last, ["doc_id", "page", "mcid"]).groupBy("doc_id", "page").agg(ordered.alias("places")).withColumn("n", F.size("places").cast("long"))
    pairs = F.expr("aggregate(sequence(1, size(places)), 0L, (total, i) -> total + size(filter(slice(places, 1, i - 1), x -> x > places[i - 1])))")
    small = pages.filter(F.col("n") <= LARGE_PAGE).select("doc_id", "page", "n", pairs.alias("inverted"))
    large = pages.filter(F.col("n") > LARGE_PAGE).select("doc_id", "page", "n", F.pandas_udf(_merge_counts, "long")("places").alias("inverted"))
    rate = F.when(F.col("n") > 1, 2 * F.col("inverted") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return sizes.join(small.unionByName(large), ["doc_id", "page"], "left").select("doc_id", "page", "tree_n", "paint_n", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _inversions(values: np.ndarray) -> int:
    if len(values) < 2:
        return 0
    half = len(values) // 2
    left, right = values[:half], values[half:]
    return _inversions(left) + _inversions(right) + int((len(left) - np.searchsorted(np.sort(left), right, "right")).sum())


def _merge_counts(places: pd.Series) -> pd.Series:
    return places.map(lambda p: _inversions(np.asarray(p)))


def heading_skips(nodes: DataFrame, doc: str, level: str, order: str) -> DataFrame:
    """Headings more than one level below the one before; the first is never one."""
    before = F.lag(level).over(Window.partitionBy(doc).orderBy(order))
    return nodes.withColumn("before", before).filter(F.col(level) > F.col("before") + 1)


def heading_holes(nodes: DataFrame, doc: str, level: str) -> DataFrame:
    """Levels below the deepest that a document does not use."""
    used = nodes.groupBy(doc).agg(F.collect_set(level).alias("used"), F.max(level).alias("deepest"))
    return used.select(doc, F.explode(F.array_except(F.sequence(F.lit(1), F.col("deepest")), F.col("used"))).alias("hole"))


def unseen_levels(nodes: DataFrame, doc: str, level: str, order: str) -> DataFrame:
    """Per heading, the least higher level that no heading before it has."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("seen", F.collect_set(level).over(before)).filter(F.col(level) > 1)
    missing = F.array_except(F.sequence(F.lit(1), F.col(level) - 1), F.col("seen"))
    return rows.withColumn("missing", F.array_min(missing)).filter("missing is not null").drop("seen")


def runs(rows: DataFrame, key: str, order: str, flag: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive rows that have a flag: first and last place and length."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("place", F.row_number().over(w)).withColumn("flag", flag)
    island = F.col("place") - F.row_number().over(Window.partitionBy(key).orderBy(order))
    flagged = numbered.filter("flag").withColumn("island", island)
    return flagged.groupBy(key, "island").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("island")


#: Containers that a screen reader does not announce.
SILENT = ("Document", "Part", "Sect", "Div", "NonStruct", "TBody", "THead")


def linearised(nodes: DataFrame) -> DataFrame:
    """Lines that a screen reader would say, in order: (doc_id, preorder, line).

    A table tells its rows and the columns of its first row, a list its items, other elements their
    tag, text (alternative before actual text) and page.
    """
    child = nodes.select("doc_id", F.col("parent_id").alias("node_id"), F.col("tag").alias("child"), F.col("node_id").alias("child_id"), F.col("ord").alias("child_ord"))
    counts = child.groupBy("doc_id", "node_id").agg(F.count_if(F.col("child") == "LI").alias("items"))
    inner = nodes.alias("t").filter("tag = 'Table'").join(nodes.alias("x").filter("tag in ('TR', 'TH', 'TD')"), (F.col("t.doc_id") == F.col("x.doc_id")) & (F.col("x.preorder") > F.col("t.preorder")) & (F.col("x.preorder") <= F.col("t.post")))
    shape = inner.groupBy(F.col("t.doc_id").alias("doc_id"), F.col("t.node_id").alias("node_id")).agg(F.count_if(F.col("x.tag") == "TR").alias("rows"), F.min_by("x.post", F.when(F.col("x.tag") == "TR", F.col("x.preorder"))).alias("row_end"), F.min(F.when(F.col("x.tag") == "TR", F.col("x.preorder"))).alias("row_start"), F.collect_list(F.when(F.col("x.tag") != "TR", F.col("x.preorder"))).alias("cells"))
    shape = shape.select("doc_id", "node_id", "rows", F.size(F.filter("cells", lambda c: (c > F.col("row_start")) & (c <= F.col("row_end")))).alias("columns"))
    said = F.coalesce(F.nullif("alt", F.lit("")), "actual_text", F.lit(""))
    line = F.when(F.col("tag") == "Table", F.concat(F.lit("table with "), F.coalesce("rows", F.lit(0)), F.lit(" rows and "), F.coalesce("columns", F.lit(0)), F.lit(" columns"))).when(F.col("tag") == "L", F.concat(F.lit("list with "), F.coalesce("items", F.lit(0)), F.lit(" items"))).otherwise(F.concat_ws(" ", "tag", F.nullif(said, F.lit("")), F.when(F.col("page").isNotNull(), F.concat(F.lit("(p."), F.col("page"), F.lit(")")))))
    rows = nodes.filter(~F.col("tag").isin(*SILENT)).join(counts, ["doc_id", "node_id"], "left").join(shape, ["doc_id", "node_id"], "left")
    return rows.select("doc_id", "preorder", line.alias("line")).orderBy("doc_id", "preorder")


def parent_tree(nodes: DataFrame) -> DataFrame:
    """Which element holds each marked content; the later element wins."""
    each = nodes.select("doc_id", "page", "node_id", "preorder", F.explode("mcids").alias("mcid"))
    return each.groupBy("doc_id", "page", "mcid").agg(F.max_by("node_id", "preorder").alias("node_id"))


def top_level(nodes: DataFrame) -> DataFrame:
    """Tags at the top of each document, with how many there are."""
    return nodes.filter("parent_id is null").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


def find(nodes: DataFrame, tag: str | None = None, page: int | None = None) -> DataFrame:
    """Elements of a tag, of a page, or of both, in reading order within their document."""
    got = nodes if tag is None else nodes.filter(F.col("tag") == tag)
    return got if page is None else got.filter(F.col("page") == page)


def inherited_pages(nodes: DataFrame) -> DataFrame:
    """``nodes`` and ``on_page``: the own page, or that of the nearest ancestor that has one.

    Found by pointer doubling over rows of fixed width, in rounds logarithmic in the depth.
    """
    start = nodes.select("doc_id", "node_id", F.when(F.col("page").isNull(), F.col("parent_id")).alias("up"), F.col("page").alias("on_page"))

    def further(state: DataFrame) -> DataFrame:
        above = state.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("on_page").alias("theirs"))
        return state.join(above, ["doc_id", "up"], "left").select("doc_id", "node_id", F.col("next").alias("up"), F.coalesce("on_page", "theirs").alias("on_page"))

    found = _rounds(start, further, "pages").select("doc_id", "node_id", "on_page")
    return nodes.drop("on_page").join(found, ["doc_id", "node_id"])


def content_order(nodes: DataFrame) -> DataFrame:
    """Content ids of each page in the order of the tree: doc_id, page, pos (from 0), mcid. Contents without any page are left out."""
    rows = inherited_pages(nodes).filter("on_page is not null").select("doc_id", F.col("on_page").alias("page"), "preorder", F.posexplode("mcids").alias("i", "mcid"))
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("preorder", "i")) - 1
    return rows.select("doc_id", "page", place.alias("pos"), "mcid")


# What lists, contents and tables may hold.
CHILDREN = {
    "TOC": ("TOCI", "TOC", "Caption"),
    "L": ("LI", "Caption"),
    "Table": ("THead", "TBody", "TFoot", "TR", "Caption"),
    "THead": ("TR",),
    "TBody": ("TR",),
    "TFoot": ("TR",),
    "TR": ("TH", "TD"),
}
# What some elements must stand in.
PARENTS = {"LI": ("L",), "LBody": ("LI",), "TOCI": ("TOC",), "THead": ("Table",), "TBody": ("Table",), "TFoot": ("Table",)}


def misplaced(nodes: DataFrame) -> DataFrame:
    """Elements that their parent may not hold, or that may not stand in it: doc_id, node_id, tag, parent_tag."""
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_tag"))
    both = nodes.join(above, ["doc_id", "parent_id"])
    wrong = F.lit(False)
    for parent, tags in CHILDREN.items():
        wrong = wrong | ((F.col("parent_tag") == parent) & ~F.col("tag").isin(*tags))
    for tag, parents in PARENTS.items():
        wrong = wrong | ((F.col("tag") == tag) & ~F.col("parent_tag").isin(*parents))
    return both.filter(wrong).select("doc_id", "node_id", "tag", "parent_tag")


def form_placement(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """Where each document's forms stand: good, mixed, orphaned (at the top only), acroform_only, or no_struct_tree."""
    forms = nodes.groupBy("doc_id").agg(F.count_if((F.col("tag") == "Form") & (F.col("depth") == 1)).alias("top"), F.count_if((F.col("tag") == "Form") & (F.col("depth") > 1)).alias("inner_n"))
    held = fields.groupBy("doc_id").agg(F.count("*").alias("fields"))
    place = F.when(F.col("top").isNull(), "no_struct_tree").when((F.col("top") > 0) & (F.col("inner_n") > 0), "mixed").when(F.col("top") > 0, "orphaned").when(F.col("inner_n") > 0, "good").otherwise("acroform_only")
    return held.join(forms, "doc_id", "left").select("doc_id", "fields", place.alias("placement"))


def figure_texts(nodes: DataFrame) -> DataFrame:
    """Figures of each document: all, without text, and the pages of those without."""
    blank = F.trim(F.coalesce("alt", F.lit(""))) == ""
    pages = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(blank, F.col("page")))), lambda p: p.cast("string")), ", ")
    return nodes.filter("tag = 'Figure'").groupBy("doc_id").agg(F.count("*").alias("figures"), F.count_if(blank).alias("without"), pages.alias("pages"))
