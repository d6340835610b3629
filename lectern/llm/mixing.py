"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a queue, shuffled by a hash, all of them once and then all of
them again. A document's virtual finish time is the source's words up to and including it,
divided by the source's target; the mix takes the queues' documents in order of finish time
until the total budget is used.

Both running sums go in two steps: sums of hash (or time) ranges, and a running sum over those
few, and then within each range. So neither a hot source nor the whole order meets in one task.
The ranges' number follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm._shared import stored

#: Rows that a range of the shuffled order, or of finish times, should hold.
ROWS_PER_RANGE = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def _ranges(rows: int) -> int:
    return int(min(1 << 18, max(1, rows // ROWS_PER_RANGE)))


def _slot(finish: Column) -> Column:
    """Finish times as they are up to 2, then by doublings: in the same order, but few values however late they are."""
    return F.when(finish <= 2, finish).otherwise(1 + F.log2(finish))


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """``sources`` with ``rank`` (0-based, by code point, null last), counted by partition, not in one task."""
    ordered = stored(sources.repartitionByRange(F.asc_nulls_last(name)).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(F.asc_nulls_last(name))
    return ordered.join(base, "part").withColumn("rank", F.col("base") + F.row_number().over(within) - 1).drop("part", "base")


def targets(sources: DataFrame, weights: tuple[float, ...], budget_share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: the budget shared by weight, none above ``most`` sizes.

    Weights repeat in the order of the sources. The share of one unit of weight rises, as the
    excess of those above their limit goes to the others, until none is above.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stored(ranked(sources, "source").withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size")), "weights")
    budget = budget_share * float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    unit = 0.0
    while True:
        above = F.col("limit") < F.lit(unit) * F.col("weight")
        got = s.agg(F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        new = (budget - got[0]) / got[1] if got[1] else unit
        if new <= unit:
            break
        unit = new
    return s.withColumn("target", F.when(F.col("limit") < F.lit(unit) * F.col("weight"), F.col("limit")).otherwise(F.lit(unit) * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, weights: tuple[float, ...] = (5, 2, 1), budget_share: float = 1.5, copies: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (taken), taken, and the columns ``carry``.

    ``size`` defaults to the number of words of the text (null: 0). ``taken`` is size times the
    copies in the mix, 0 to ``copies``. A document without words is never taken. Ties in the shuffle
    (equal ids in one source) are ordered by size and text hash; rows that tie in all of these, and
    in ``carry``, are interchangeable. Null ids and sources are values like others. An empty table gives an empty mix;
    other columns are not carried.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.col(text_col), F.lit(WORD)) if size is None else size
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    d = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"), key.alias("key"), F.xxhash64(F.col(text_col)).alias("same"), *carry), "sizes")
    known = d.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = _ranges(known[0])
    t = stored(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_share, copies), "targets")
    # words of the source up to each document, by ranges of the hash
    d = d.withColumn("range", F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * n / (1 << 24)))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = d.groupBy("source", "range").agg(F.sum("size").alias("in_range")).withColumn("base", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    bases = bases.join(t, bases["source"].eqNullSafe(t["source"])).select(bases["source"].alias("s"), F.col("range").alias("r"), "base", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "size", "same", "doc_id", *carry)
    run = d.withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(within))
    # read twice below: for the queue and for the result
    run = stored(run.join(bases, run["source"].eqNullSafe(bases["s"]) & (run["range"] == bases["r"])).drop("s", "r"), "runs")
    queue = run.filter("size > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("finish", (F.col("source_size") * F.col("copy") + F.col("base") + F.col("run")) / F.col("target"))
    # the order of finish times, cut where the words taken reach the budget
    queue = queue.select("source", "range", "nth", "key", "size", "same", "doc_id", "copy", "finish", F.floor(_slot(F.col("finish")) * n).alias("slot"))
    slots = queue.groupBy("slot").agg(F.sum("size").alias("words"))
    cut = slots.withColumn("upto", F.sum("words").over(Window.orderBy("slot")))
    budget = budget_share * float(known[1])
    edge = cut.filter(F.col("upto") > budget).orderBy("slot").first()
    if edge is None:
        taken = queue
    else:
        order = Window.orderBy("finish", F.asc_nulls_last("source"), "key", "size", "same", "doc_id", "nth", "copy").rowsBetween(Window.unboundedPreceding, 0)
        left = budget - (edge["upto"] - edge["words"])
        last = queue.filter(F.col("slot") == edge["slot"]).withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") <= left).drop("upto")
        taken = queue.filter(F.col("slot") < edge["slot"]).unionByName(last)
    taken = taken.groupBy(F.col("source").alias("s"), F.col("range").alias("r"), F.col("nth").alias("i")).agg(F.count("*").alias("copies"))
    out = run.join(taken, run["source"].eqNullSafe(F.col("s")) & (run["range"] == F.col("r")) & (run["nth"] == F.col("i")), "left")
    copies_col = F.coalesce(F.col("copies"), F.lit(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies_col.alias("copies"), (F.col("size") * copies_col).alias("taken"), *carry)
