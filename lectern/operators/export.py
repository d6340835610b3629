"""Findings and audits as files and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import in_order

# Columns of the plain export.
CSV_COLUMNS = ["file", "rule", "severity", "confidence", "wcag", "page", "message"]


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV of texts, all quoted, quotes doubled, CRLF line ends; missing values are empty strings.

    ``columns`` defaults to ``CSV_COLUMNS``; the spreadsheets of ``audits`` are written with their own.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns or CSV_COLUMNS]
    rows.select(text).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


#: Who a report is for, and the column of ``with_remedies`` that tells them what to do.
AUDIENCES = {"tool": "remedy_tool", "manual": "remedy_manual"}


def with_remedies(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``findings`` with what to do about each, for those who have the repair tools and for those who work by hand.

    ``rules`` has rule and name. Without a tool for a rule both texts tell to repair by hand.
    """
    names = rules.select("rule", F.col("name").alias("rule_name")).dropDuplicates(["rule"])
    what = F.coalesce("rule_name", "message", "rule")
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit(" on page "), F.col("page").cast("string"))).otherwise("")
    by_hand = F.concat(F.lit("Open the source document, correct by hand"), where, F.lit(": "), what, F.lit("; then check it again."))
    by_tool = F.when(F.col("fix").isNotNull(), F.concat(F.lit("Run "), F.col("fix"), F.lit(" on the file"), F.lit(" for: "), what, F.lit("; then check it again."))).otherwise(by_hand)
    return findings.join(names, "rule", "left").withColumns({"remedy_tool": by_tool, "remedy_manual": by_hand}).drop("rule_name")


def write_audiences(findings: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """All findings twice, as ``path-tool`` and ``path-manual``; only what to do about them differs.

    ``findings`` comes from ``with_remedies``; the column ``remediation`` is put after ``columns``.
    """
    for audience, remedy in AUDIENCES.items():
        chosen = [c for c in columns or CSV_COLUMNS if c != "remediation"]
        write_csv(findings.withColumn("remediation", F.col(remedy)), f"{path}-{audience}", [*chosen, "remediation"])


def audit_json(findings: DataFrame, scored: DataFrame) -> DataFrame:
    """One JSON text per document: its score, grade and findings."""
    each = findings.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "rule", "severity", "message"))).alias("findings"))
    return scored.join(each, "doc", "left").select("doc", F.to_json(F.struct("doc", "score", "grade", F.transform(F.coalesce("findings", F.array().cast("array<struct<ord:bigint,rule:string,severity:string,message:string>>")), lambda x: x.dropFields("ord")).alias("findings"))).alias("json"))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def alt_formats(concise: Column, detailed: Column, kind: Column) -> Column:
    """An alternative text and its description in each form: html, markdown, json, plain, pdf_tag, docx and native.

    ``native`` (JSON) is what a file of type ``kind`` takes: alt and actual text in a PDF, alt in a book, descr elsewhere.
    """
    said = F.coalesce(detailed, F.lit(""))
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    safe = html_escape(concise)
    html = F.concat(F.lit('<img src="" alt="'), safe, F.lit('" />\n\n<figure>\n  <img src="" alt="'), safe, F.lit('" aria-describedby="img-desc" />\n  <figcaption id="img-desc">'), text(said), F.lit("</figcaption>\n</figure>"))
    shown = F.concat(F.lit("!["), concise, F.lit("]()"))
    both = F.struct(concise.alias("concise_alt"), said.alias("detailed_description"))
    native = F.when(kind == "pdf", F.to_json(F.struct(concise.alias("alt"), said.alias("actual_text")))).when(kind == "epub", F.to_json(F.struct(concise.alias("alt")))).otherwise(F.to_json(F.struct(concise.alias("descr"))))
    return F.struct(
        html.alias("html"),
        F.when(said == "", shown).otherwise(F.concat(shown, F.lit("\n\n> "), said)).alias("markdown"),
        F.to_json(both).alias("json"),
        F.concat(F.lit("Alt: "), concise, F.when(said == "", "").otherwise(F.concat(F.lit("\nDescription: "), said))).alias("plain"),
        F.to_json(F.struct(concise.alias("alt"), said.alias("actual_text"))).alias("pdf_tag"),
        F.to_json(F.struct(concise.alias("descr"))).alias("docx"),
        native.alias("native"),
    )


def report_lines(summary: DataFrame) -> DataFrame:
    """The rows of a Markdown summary table, in the order of ``summary``."""
    return summary.select(F.concat(F.lit("| "), F.concat_ws(" | ", "rule", F.col("files").cast("string"), F.col("findings").cast("string"), F.coalesce("criterion", F.lit("--"))), F.lit(" |")).alias("line"))


def text_summaries(scored: DataFrame) -> DataFrame:
    """One line per document: score, grade and counts."""
    line = F.concat_ws("", F.lit("score "), "score", F.lit("/100 ("), "grade", F.lit("), "), "errors", F.lit(" errors, "), "warnings", F.lit(" warnings, "), "infos", F.lit(" others"))
    return scored.select("doc", line.alias("summary"))


def document_reports(findings: DataFrame, scored: DataFrame) -> DataFrame:
    """One Markdown text per document: its score, then a table of its findings, gravest first."""
    rank = in_order(F.col("severity"), "rank")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "rule", F.coalesce(F.col("page").cast("string"), F.lit("-")), "message"), F.lit(" |"))
    rows = findings.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(rank, "ord", row.alias("row")))).alias("rows"))
    head = F.concat_ws("", F.lit("# Document "), "doc", F.lit("\n\nScore "), "score", F.lit(" ("), "grade", F.lit(")\n\n| severity | rule | page | message |\n|---|---|---|---|\n"))
    return scored.join(rows, "doc").select("doc", F.concat(head, F.array_join(F.transform("rows", lambda x: x["row"]), "\n")).alias("report"))
