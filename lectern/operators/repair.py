"""Planned repairs as rows; input files are never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lectern.functions.text import strip


def numbered_titles(slides: DataFrame, deck: str = "doc_id", order: str = "slide_no", title: str = "title") -> DataFrame:
    """Repeated titles of a deck with (2), (3), ... appended; the first stays, and so does a title that is yet to be written."""
    nth = F.row_number().over(Window.partitionBy(deck, title).orderBy(order))
    again = (F.col("nth") > 1) & ~F.startswith(F.col(title), F.lit("TODO:"))
    return slides.withColumn("nth", nth).withColumn("new_title", F.when(again, F.concat(title, F.lit(" ("), "nth", F.lit(")"))).otherwise(F.col(title))).drop("nth")


def clean_spine(spine: DataFrame, items: DataFrame) -> DataFrame:
    """The first of each spine entry that the manifest knows."""
    first = F.row_number().over(Window.partitionBy("doc_id", "idref").orderBy("ord"))
    return spine.withColumn("nth", first).filter("nth = 1").drop("nth").join(items.select("doc_id", F.col("item_id").alias("idref")).distinct(), ["doc_id", "idref"], "left_semi")


def heading_repairs(headings: DataFrame, doc: str, order: str, level: str) -> DataFrame:
    """(doc, levels, repaired): each repaired level is at most one below the repaired one before it.

    r(i) = least(l(i), r(i - 1) + 1) is i plus the least l(j) - j up to i, so one window gives them all.
    """
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    least = F.min(F.col(level).cast("int") - F.col("nth")).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = headings.withColumn("nth", nth).withColumn("new", F.col("nth") + least)
    listed = F.array_sort(F.collect_list(F.struct("nth", F.col(level).cast("int").alias("own"), "new")))
    return rows.groupBy(doc).agg(listed.alias("x")).select(doc, F.transform("x", lambda r: r["own"]).alias("levels"), F.transform("x", lambda r: r["new"].cast("int")).alias("repaired"))


def planned_metadata(documents: DataFrame) -> DataFrame:
    """Titles from file names and a language, where they are missing: doc_id, rule, old, new."""
    stem = F.initcap(F.regexp_replace(F.regexp_replace("file", r"\.[^.]+$", ""), "[_-]+", " "))
    title = documents.filter(F.coalesce(strip(F.col("title")), F.lit("")) == "").select("doc_id", F.lit("title").alias("property"), F.col("title").alias("old"), stem.alias("new"))
    lang = documents.filter(F.coalesce(strip(F.col("lang")), F.lit("")) == "").select("doc_id", F.lit("lang"), "lang", F.lit("en-US"))
    return title.union(lang)


def outcomes(events: DataFrame) -> DataFrame:
    """Fix events (rule, status) counted by rule and status; events without a rule do not count."""
    return events.filter(F.coalesce(strip(F.col("rule")), F.lit("")) != "").groupBy("rule").pivot("status", ["fixed", "skipped", "failed", "needs-human"]).count().na.fill(0)
