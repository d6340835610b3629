"""Planned repairs of the five file types, as SQL over the silver tables; input files are never changed.

A repair is data like a rule: tool, the id its tool knows, and a query that gives ``doc_id``, the
``target`` in the document, ``status`` (``fixed`` where a tool can write ``new``, ``needs-human`` where it
can only point) and ``new``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.plans.rules import HEADING, blank, strip
from lectern.sources.schema import SCHEMAS
from lectern.storage import views

# Texts that stand in for what only an author can say.
TITLE, AUTHOR, TOOLTIP = "TODO: Add descriptive document title", "TODO: Add author name", "TODO: Add tooltip"
SUMMARY = "TODO: Describe accessibility features and conformance level"


def _meta(kind: str, tool: str, title: str, author: str, lang: str | None = None) -> list[tuple]:
    of = f"FROM doc WHERE type = '{kind}' AND access_ok"
    out = [(tool, title, f"SELECT doc_id, 'title' AS target, 'fixed' AS status, '{TITLE}' AS new {of} AND {blank('title')}"), (tool, author, f"SELECT doc_id, 'author' AS target, 'fixed' AS status, '{AUTHOR}' AS new {of} AND {blank('author')}")]
    return out + [(tool, lang, f"SELECT doc_id, 'language' AS target, 'fixed' AS status, 'en-US' AS new {of} AND {blank('lang')}")] * (lang is not None)


_PDF = "FROM doc WHERE type = 'pdf' AND access_ok"
_PDFS = f"(SELECT doc_id {_PDF})"
_NTH = "row_number() OVER (PARTITION BY doc_id, title ORDER BY slide_no)"
_HTML = "(SELECT *, int(substr(el, 2)) AS level, row_number() OVER (PARTITION BY doc_id, content_doc ORDER BY ord) AS k FROM html_el WHERE el rlike '^h[1-6]$')"
_OPEN_NAV = "coalesce(version, '3.0') NOT LIKE '2%' AND (NOT coalesce(nav_present, false) OR NOT array_contains(coalesce(nav_types, array()), 'toc'))"
# a part without headings is called by its file name: no suffix, spaces for - and _, each run of letters capitalised
_STEM = r"translate(regexp_replace(regexp_extract(i.href, '([^/]*)$', 1), '(?<=[^.])[.][^.]*$', ''), '-_', '  ')"
_LABEL = rf"array_join(transform(split({_STEM}, '(?<!\\p{{L}})(?=\\p{{L}})'), w -> concat(upper(left(w, 1)), lower(substr(w, 2)))), '')"


def _escaped(text: str) -> str:
    return f"replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


#: Each book's table of contents: the first heading of each content document in reading order.
_CONTENTS = f"""SELECT doc_id, concat('<ol>', array_join(transform(array_sort(collect_list(struct(ord, href, said))), e -> concat('<li><a href="', {_escaped('e.href')}, '">', {_escaped('e.said')}, '</a></li>')), ''), '</ol>') AS toc
  FROM (SELECT s.doc_id, s.ord, i.href, coalesce(h.said, {_LABEL}) AS said FROM epub_spine s JOIN epub_item i ON s.doc_id = i.doc_id AND s.idref = i.item_id AND i.href <> ''
    LEFT JOIN (SELECT doc_id, content_doc, min_by(coalesce(nullif({strip('inner_text')}, ''), concat('Heading ', substr(el, 2))), ord) AS said FROM html_el WHERE el rlike '^h[1-6]$' GROUP BY doc_id, content_doc) h ON h.doc_id = i.doc_id AND h.content_doc = i.part) GROUP BY doc_id"""
FIXES: list[tuple[str, str, str]] = [
    ("fix_pdf", "PDFUA.METADATA.TITLE", f"SELECT doc_id, 'title' AS target, 'fixed' AS status, '{TITLE}' AS new {_PDF} AND {blank('title')}"),
    ("fix_pdf", "PDFUA.METADATA.DISPLAY_TITLE", f"SELECT doc_id, 'display title' AS target, 'fixed' AS status, 'true' AS new {_PDF} AND NOT coalesce(display_doc_title, false)"),
    ("fix_pdf", "PDFUA.METADATA.LANG", f"SELECT doc_id, 'language' AS target, 'fixed' AS status, 'en-US' AS new {_PDF} AND {blank('lang')}"),
    ("fix_pdf", "PDFUA.NAV.TAB_ORDER", f"SELECT p.doc_id, concat('page ', page) AS target, 'fixed' AS status, 'S' AS new FROM pdf_page p LEFT SEMI JOIN {_PDFS} d ON p.doc_id = d.doc_id WHERE tabs IS NULL"),
    ("fix_pdf", "PDFUA.METADATA.PDFUA_ID", f"SELECT doc_id, 'identifier' AS target, 'fixed' AS status, 'pdfuaid:part=1' AS new {_PDF} AND NOT contains(lower(coalesce(xmp, '')), 'pdfuaid')"),
    ("fix_pdf", "PDFUA.STRUCTURE.MARKED", f"SELECT doc_id, 'marked' AS target, 'fixed' AS status, 'true' AS new {_PDF} AND NOT coalesce(tagged, false)"),
    ("fix_pdf", "PDFUA.FORM.TU", f"SELECT f.doc_id, concat('field ', ord) AS target, 'fixed' AS status, CASE WHEN coalesce(name, '') = '' THEN '{TOOLTIP}' ELSE translate({strip('name')}, '_.', '  ') END AS new FROM form_field f LEFT SEMI JOIN {_PDFS} d ON f.doc_id = d.doc_id WHERE {blank('tooltip')}"),
    ("fix_pdf", "PDFUA.TABLE.HEADERS", f"SELECT n.doc_id, 'tables' AS target, 'needs-human' AS status, CAST(NULL AS STRING) AS new FROM struct_node n LEFT SEMI JOIN {_PDFS} d ON n.doc_id = d.doc_id GROUP BY n.doc_id HAVING count_if(tag = 'Table') > 0 AND count_if(tag = 'TH') = 0"),
    ("fix_pdf", "PDFBP.HEADING.SKIP", f"SELECT DISTINCT h.doc_id, 'headings' AS target, 'needs-human' AS status, CAST(NULL AS STRING) AS new FROM (SELECT doc_id, int(substr(tag, 2)) AS level, lag(int(substr(tag, 2))) OVER (PARTITION BY doc_id ORDER BY preorder) AS before FROM struct_node WHERE {HEADING}) h LEFT SEMI JOIN {_PDFS} d ON h.doc_id = d.doc_id WHERE level > before + 1"),
    ("fix_pdf", "PDFUA.IMG.ALT", f"SELECT n.doc_id, concat('element ', node_id) AS target, 'needs-human' AS status, CAST(NULL AS STRING) AS new FROM struct_node n LEFT SEMI JOIN {_PDFS} d ON n.doc_id = d.doc_id WHERE tag = 'Figure' AND {blank('alt')}"),
    *_meta("docx", "fix_word", "DOCX-META.TITLE", "DOCX-META.AUTHOR", "DOCX-META.LANG"),
    ("fix_word", "DOCX-TABLE.HEADERS", "SELECT doc_id, concat('table ', table_no) AS target, 'fixed' AS status, 'header row' AS new FROM doc_table WHERE NOT has_header"),
    ("fix_word", "DOCX-IMG.ALT", f"SELECT doc_id, concat('drawing ', ord) AS target, 'needs-human' AS status, CAST(NULL AS STRING) AS new FROM drawing WHERE {blank('descr')} AND {blank('title')}"),
    *_meta("xlsx", "fix_excel", "XLSX-META.TITLE", "XLSX-META.AUTHOR"),
    ("fix_excel", "XLSX-SHEET.NAME", r"SELECT doc_id, concat('sheet ', ord) AS target, 'needs-human' AS status, CAST(NULL AS STRING) AS new FROM sheet WHERE name rlike '(?i)^sheet[0-9]*$'"),
    ("fix_excel", "XLSX-TABLE.PRINT_TITLES", "SELECT doc_id, concat('sheet ', ord) AS target, 'fixed' AS status, '1:1' AS new FROM sheet WHERE max_row > 1"),
    ("fix_excel", "XLSX-IMG.ALT", f"SELECT doc_id, concat('drawing ', ord) AS target, 'needs-human' AS status, CAST(NULL AS STRING) AS new FROM xl_drawing WHERE kind = 'pic' AND {blank('descr')}"),
    *_meta("pptx", "fix_pptx", "PPTX-META.TITLE", "PPTX-META.AUTHOR"),
    ("fix_pptx", "PPTX-SLIDE.TITLE", f"SELECT doc_id, concat('slide ', slide_no) AS target, CASE WHEN coalesce(has_title_shape, false) THEN 'fixed' ELSE 'needs-human' END AS status, CASE WHEN coalesce(has_title_shape, false) THEN concat('TODO: Title for Slide ', slide_no) END AS new FROM slide WHERE {blank('title')}"),
    ("fix_pptx", "PPTX-SLIDE.TITLE_UNIQUE", f"SELECT doc_id, concat('slide ', slide_no) AS target, 'fixed' AS status, concat(title, ' (', nth, ')') AS new FROM (SELECT doc_id, slide_no, title, {_NTH} AS nth FROM (SELECT doc_id, slide_no, {strip('title')} AS title FROM slide) WHERE title <> '' AND title NOT LIKE 'TODO:%') WHERE nth > 1"),
    ("fix_pptx", "PPTX-IMG.ALT", f"SELECT doc_id, concat('slide ', slide_no, ' shape ', ord) AS target, 'needs-human' AS status, CAST(NULL AS STRING) AS new FROM shape WHERE shape_type = 13 AND NOT coalesce(decorative, false) AND {blank('descr')}"),
    ("fix_epub", "EPUB-E001", f"SELECT doc_id, 'title' AS target, 'fixed' AS status, '{TITLE}' AS new FROM epub_pkg WHERE {blank('title')}"),
    ("fix_epub", "EPUB-E003", f"SELECT doc_id, 'language' AS target, 'fixed' AS status, 'en' AS new FROM epub_pkg WHERE {blank('language')}"),
    ("fix_epub", "EPUB-T002", f"SELECT doc_id, 'creator' AS target, 'fixed' AS status, '{AUTHOR}' AS new FROM epub_pkg WHERE {blank('creator')}"),
    ("fix_epub", "EPUB-E007", f"SELECT doc_id, p.property AS target, 'fixed' AS status, p.text AS new FROM epub_pkg LATERAL VIEW explode(array(struct('schema:accessMode' AS property, 'textual' AS text), struct('schema:accessibilityFeature' AS property, 'structuralNavigation' AS text), struct('schema:accessibilitySummary' AS property, '{SUMMARY}' AS text))) AS p WHERE coalesce(version, '3.0') NOT LIKE '2%' AND NOT exists(coalesce(metas, array()), m -> m.property = p.property)"),
    ("fix_epub", "EPUB-E004", f"SELECT p.doc_id, 'navigation' AS target, CASE WHEN toc IS NULL THEN 'needs-human' ELSE 'fixed' END AS status, toc AS new FROM (SELECT doc_id FROM epub_pkg WHERE {_OPEN_NAV}) p LEFT JOIN ({_CONTENTS}) t ON p.doc_id = t.doc_id"),
    ("fix_epub", "EPUB-E005", "SELECT doc_id, concat(content_doc, ' element ', ord) AS target, 'fixed' AS status, concat('TODO: Describe ', coalesce(attrs['src'], 'image')) AS new FROM html_el WHERE el = 'img' AND attrs['alt'] IS NULL"),
    ("fix_epub", "EPUB-E006", "SELECT s.doc_id, concat('spine ', ord) AS target, 'fixed' AS status, CASE WHEN i.item_id IS NULL THEN 'remove dangling' ELSE 'remove duplicate' END AS new FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idref ORDER BY ord) AS nth FROM epub_spine) s LEFT JOIN epub_item i ON s.doc_id = i.doc_id AND s.idref = i.item_id WHERE nth > 1 OR i.item_id IS NULL"),
    # each repaired level is the least of the heading's own and one more than the repaired one before
    ("fix_epub", "EPUB-W003", f"SELECT doc_id, concat(content_doc, ' heading ', k) AS target, 'fixed' AS status, concat('h', repaired) AS new FROM (SELECT *, k + min(level - k) OVER (PARTITION BY doc_id, content_doc ORDER BY k) AS repaired FROM {_HTML}) WHERE repaired < level"),
]


def needed(tools: tuple[str, ...] | None = None) -> set[str]:
    """The silver tables that the tools' plans read."""
    return {w for tool, _, sql in FIXES if tools is None or tool in tools for w in re.findall(r"\w+", sql)} & set(SCHEMAS)


def planned(spark: SparkSession, tables: dict[str, DataFrame], tools: tuple[str, ...] | None = None) -> DataFrame:
    """All planned repairs: doc, tool, rule, target, status, new. Missing tables count as empty."""
    out = spark.createDataFrame([], "doc bigint, tool string, rule string, target string, status string, new string")
    with views({name: tables[name] if name in tables else spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}):
        for tool, rule, sql in FIXES:
            if tools is None or tool in tools:
                out = out.unionByName(spark.sql(sql).select(F.col("doc_id").alias("doc"), F.lit(tool).alias("tool"), F.lit(rule).alias("rule"), "target", "status", "new"))
    return out
