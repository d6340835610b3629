"""Markdown texts as lines with their state, and the things that rules look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import split_lines, strip
from lectern.plans import dims

# Code points of emoji runs.
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{1FA70}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{FE00}-\\x{FE0F}\\x{200D}\\x{2934}-\\x{2935}]+"
LINK = r"\[([^\]]*)\]\(([^)]+)\)"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
HEADING = r"^(#{1,6})\s+(.+)"


def line_states(texts: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), raw, stripped, outside, opens, language, previous, follows_row.

    ``outside``: neither a fence nor between fences; ``opens``: a fence that begins a block, with its
    ``language``; ``previous``: the last line before that is not blank, stripped (null at the top);
    ``follows_row``: whether the last line before that is outside is a row of a table.
    """
    lines = texts.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("i", "raw")).select("doc_id", (F.col("i") + 1).alias("line_no"), "raw", strip(F.col("raw")).alias("stripped"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("stripped").startswith("```")
    inside = F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1
    state = lines.withColumn("fence", fence).withColumn("inside", inside)
    previous = F.last(F.when(F.col("stripped") != "", F.col("stripped")), ignorenulls=True).over(before)
    language = strip(F.substring("stripped", 4, 1 << 20))
    outside = ~F.col("fence") & ~F.col("inside")
    follows = F.coalesce(F.last(F.when(outside, F.col("stripped").startswith("|")), ignorenulls=True).over(before), F.lit(False))
    return state.select("doc_id", "line_no", "raw", "stripped", outside.alias("outside"), (F.col("fence") & ~F.col("inside")).alias("opens"), language.alias("language"), previous.alias("previous"), follows.alias("follows_row"))


def _pairs(pattern: str) -> Column:
    parts = [F.regexp_extract_all("raw", F.lit(pattern), F.lit(g)) for g in (1, 2)]
    return F.explode(F.zip_with(*parts, lambda a, b: F.struct(strip(a).alias("a"), strip(b).alias("b"))))


def links(state: DataFrame) -> DataFrame:
    """Links outside fences: text, url, kind (ambiguous, bare or null) and hides_type (a download without its type)."""
    rows = state.filter("outside and contains(raw, '](')").select("doc_id", "line_no", _pairs(LINK).alias("p")).select("doc_id", "line_no", F.col("p.a").alias("text"), F.col("p.b").alias("url")).filter(~F.col("text").startswith("!["))
    low = F.lower("text")
    weak = low.isin(*dims.VAGUE_LINKS["md"])
    for start in dims.VAGUE_STARTS:
        weak = weak | low.startswith(start)
    hides = F.lit(False)
    for ext in dims.DOWNLOADS:
        hides = hides | (F.lower("url").endswith(ext) & ~F.contains(low, F.lit(ext[1:])))
    return rows.withColumn("kind", F.when(weak, "ambiguous").when(low.rlike(r"^(https?://|www\.)"), "bare")).withColumn("hides_type", hides)


def images(state: DataFrame) -> DataFrame:
    return state.filter("outside and contains(raw, '](')").select("doc_id", "line_no", _pairs(IMAGE).alias("p")).select("doc_id", "line_no", F.col("p.a").alias("alt"), F.col("p.b").alias("url"))


def headings(state: DataFrame) -> DataFrame:
    found = state.filter("outside and startswith(raw, '#')").withColumn("marks", F.regexp_extract("raw", HEADING, 1)).filter("marks <> ''")
    return found.select("doc_id", "line_no", F.length("marks").alias("level"), strip(F.regexp_extract("raw", HEADING, 2)).alias("text"))


def tables(state: DataFrame) -> DataFrame:
    """First rows of tables: doc_id, line_no, previous and the stripped cells between the outer bars."""
    rows = state.filter("outside and startswith(stripped, '|') and not follows_row")
    cells = F.transform(F.split("stripped", r"\|", -1), strip)
    cells = F.when(F.get(cells, 0) == "", F.slice(cells, 2, 1 << 20)).otherwise(cells)
    rows = rows.withColumn("c", cells)
    return rows.select("doc_id", "line_no", "previous", F.when(F.try_element_at("c", F.lit(-1)) == "", F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0)))).otherwise(F.col("c")).alias("cells"))


def emoji(state: DataFrame) -> DataFrame:
    # all emoji take more than one byte
    rows = state.filter("outside and octet_length(raw) > length(raw)").select("doc_id", "line_no", F.col("raw").rlike(r"^#{1,6}\s+").alias("in_heading"), F.explode(F.regexp_extract_all("raw", F.lit(EMOJI), F.lit(0))).alias("run"))
    return rows


def slug(text: Column) -> Column:
    """Anchor of a heading: lower case, without punctuation, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def broken_anchors(state: DataFrame) -> DataFrame:
    """Links to ``#anchor`` for which the document has no heading; repeated headings get -1, -2, ..."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("line_no")) - 1
    anchors = headings(state).withColumn("base", slug(F.col("text"))).withColumn("nth", nth).select("doc_id", F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", "nth")).alias("anchor"))
    wanted = links(state).filter(F.col("url").startswith("#")).withColumn("anchor", F.lower(F.substring("url", 2, 1 << 20)))
    return wanted.join(anchors, ["doc_id", "anchor"], "left_anti").select("doc_id", "line_no", "anchor")


def repeated_link_texts(state: DataFrame) -> DataFrame:
    """Link texts of a document that lead to different places."""
    return links(state).filter("text <> ''").groupBy("doc_id", F.lower("text").alias("text")).agg(F.count_distinct("url").alias("urls")).filter("urls > 1")


def long_passages(state: DataFrame, sentence: int = 40, paragraph: int = 150) -> DataFrame:
    """Paragraphs outside fences with more words than ``paragraph``, and the longest sentence of each over ``sentence``."""
    gap = F.when((F.col("stripped") == "") | ~F.col("outside"), 1).otherwise(0)
    number = F.sum(gap).over(Window.partitionBy("doc_id").orderBy("line_no"))
    text = state.withColumn("number", number).filter("outside and stripped <> ''").groupBy("doc_id", "number").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "stripped"))), lambda x: x["stripped"]), " ").alias("text"))
    count = lambda c: F.size(F.split(strip(c), r"\s+"))
    longest = F.array_max(F.transform(F.split("text", r"[.!?]+(?=\s|$)"), lambda s: F.when(strip(s) == "", 0).otherwise(count(s))))
    return text.select("doc_id", "line_no", count(F.col("text")).alias("words"), longest.alias("longest_sentence")).filter((F.col("words") > paragraph) | (F.col("longest_sentence") > sentence))


def bold_headings(state: DataFrame) -> DataFrame:
    """Lines outside fences that are one bold text and nothing else."""
    text = F.regexp_extract("stripped", r"^\*\*([^*]+)\*\*$", 1)
    return state.filter("outside").withColumn("text", text).filter("text <> ''").select("doc_id", "line_no", "text")


def wide_tables(state: DataFrame, columns: int = 5) -> DataFrame:
    """Tables of so many columns or more."""
    return tables(state).select("doc_id", "line_no", F.size("cells").alias("columns")).filter(F.col("columns") >= columns)


def emoji_bullets(state: DataFrame) -> DataFrame:
    """List items outside fences that begin with an emoji, and the item without it."""
    item = rf"^([-*+]|\d+\.)\s+({EMOJI})\s*(.*)$"
    rows = state.filter("outside").withColumn("text", F.regexp_extract("stripped", item, 3)).filter(F.col("stripped").rlike(item))
    return rows.select("doc_id", "line_no", F.concat(F.lit("- "), "text").alias("new"))


def dashes(state: DataFrame, replacement: str = " - ") -> DataFrame:
    """Prose lines with em or en dashes, or two or three hyphens between blanks, and the line with ``replacement``.

    Fences, rules of hyphens alone and lines with inline code or comments are left out.
    """
    found = "\\s*[\u2013\u2014]\\s*|(?<=\\S)\\s+-{2,3}\\s+(?=\\S)"
    rows = state.filter("outside").filter(~F.col("stripped").rlike(r"^[-\s|:]*$") & ~F.contains("raw", F.lit("`")) & ~F.contains("raw", F.lit("<!--")))
    return rows.withColumn("new", F.regexp_replace("stripped", found, replacement)).filter("new <> stripped").select("doc_id", "line_no", "new")
