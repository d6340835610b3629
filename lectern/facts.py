"""Fact tables made from the driver's tables, so that every rule meets documents that break it and documents that do not.

A customer is a folder with a document of each type and one without parts; its orders and line items are the
parts of each of its documents. What a part says follows from its keys by fixed lists. The SQL is plain enough for Spark and for other engines: nested values are left
flat here (``scope`` for the attribute, ``contents`` for the number of content ids, ...) and are built
in ``tables``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.sources.schema import SCHEMAS
from lectern.storage import by_documents, new_path, table_by


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def pick(key: str, values: list) -> str:
    """One of ``values`` by the remainder of an integer expression."""
    cases = " ".join(f"WHEN {i} THEN {_value(v)}" for i, v in enumerate(values) if v is not None)
    return f"(CASE ({key}) % {len(values)} {cases} END)"


_PICKED = re.compile(r"\(CASE \(([^()]*)\) % (\d+) ((?:WHEN \d+ THEN (?:'(?:[^']|'')*'|\w+) )+)END\)")


def looked_up(sql: str) -> str:
    """The same SQL for Spark: what ``pick`` says is looked up in a constant array by its place.

    A CASE tries its branches in turn, and its code grows with them until the JVM no longer compiles it.
    """

    def place(found: re.Match) -> str:
        said = dict(re.findall(r"WHEN (\d+) THEN ('(?:[^']|'')*'|\w+) ", found[3]))
        return f"get(array({', '.join(said.get(str(i), 'NULL') for i in range(int(found[2])))}), CAST(({found[1]}) % {found[2]} AS INT))"

    return _PICKED.sub(place, sql)


_NODE_TAGS = ["Sect", "Table", "L", "H1", "H3", "Figure", "P", "Div", "Sect", "Table", "L", "H2", "Art", "Caption", "Odd", "Unknown", "Form", "Sect", "H1"]
_PART_TAGS = ["P", "Figure", "Caption", "Link", "Span", "H2", "Form", "Other", "P", "H4", "Figure", "L", "Sect"]
_ALTS = [None, "", "A chart of sales", "IMG_0042", "click here", "https://example.org/a/very/long/path", " ", "()", "photo.png", "See  more", "figure 12", "Learn more", "A map of the town"]
_TEXTS = ["1. First point", "plain words of a paragraph", "", "- a dash item", "   ", "b) second point", "A longer sentence that says something.", "iv. roman", "* star item"]
_LONG = "'" + "words of some length " * 16 + "'"

# Types of a folder's documents by their places, and how far ids of equal places lie apart, prime to
# the lengths of all lists that are picked from by an id.
_TYPES = ["pdf", "docx", "xlsx", "pptx", "epub", "md"]
_APART = 11

#: Some documents have no parts: these are those of the folder before.
_OWNER = f"CAST(o_custkey - CASE WHEN o_custkey % 13 = 5 THEN {_APART} ELSE 0 END AS BIGINT)"
#: Documents: one of each type, and one without parts, of any type, that in some folders cannot be read.
_DOCS = f"""(SELECT CAST(c_custkey * {_APART} + i AS BIGINT) AS k, CASE WHEN i < {len(_TYPES)} THEN i ELSE c_custkey END AS kind, i = {len(_TYPES)} AND c_custkey % 7 < 3 AS locked
      FROM {{customer}} CROSS JOIN ({" UNION ALL ".join(f"SELECT {i} AS i" for i in range(len(_TYPES) + 1))}) places)"""

FACTS: dict[str, str] = {
    "doc": f"""SELECT k AS doc_id, {pick("kind", _TYPES)} AS type, NOT locked AS access_ok,
      CASE WHEN locked THEN {pick("k", ["encrypted", "empty", "too large", None])} END AS skip_reason,
      {pick("k", ["Annual report", "", " ", None, "Plan of the year"])} AS title, {pick("k + 2", ["A. Writer", None, " "])} AS author, {pick("k", ["en-GB", "EN-US", "en", "", None, "en419", "es-419", "zh-Hant-TW", "x", "de-", " fr ", "en_US", "de-AT"])} AS lang,
      {pick("k", ["en", None, "en-us"])} AS info_lang, CAST(k % 30 + 1 AS INT) AS pages, {pick("k", [True, False, True, None])} AS tagged, {pick("k + 1", [True, True, False, True, None])} AS mark_info_present,
      {pick("k + 1", [True, False, True, True, None, True])} AS display_doc_title, {pick("k", [True, True, False, True, None, True, True, True])} AS viewer_prefs_present,
      {pick("k + 2", [True, False, None])} AS outlines_present, {pick("k + 3", [True, True, False, None])} AS acroform_present, {pick("k", [True, True, True, False, True, True, True, True, None])} AS tree_present,
      {pick("k", ["<pdfuaid:part>1", "<x>", None, "<PDFUAID:part>"])} AS xmp, {pick("k", [True, False, None])} AS toc_present, {pick("k", [0, 2, None])} AS tracked_n,
      CAST(9000 + k % 7 * 100 AS BIGINT) AS slide_width_emu, CAST(6000 + k % 5 * 100 AS BIGINT) AS slide_height_emu FROM {_DOCS} c""",
    # four levels: the document, an order, a line item, and one element below each line item
    "struct_node": f"""SELECT doc_id, CAST(preorder AS INT) AS node_id, CAST(CASE WHEN o = 0 THEN NULL WHEN l = 0 THEN 0 WHEN m = 0 THEN above ELSE beside END AS INT) AS parent_id, CAST(preorder AS INT) AS ord, CAST(CASE WHEN o = 0 THEN 1 WHEN l = 0 THEN 2 WHEN m = 0 THEN 3 ELSE 4 END AS INT) AS depth,
      CAST(preorder AS INT) AS preorder, CAST(CASE WHEN o = 0 THEN in_doc - 1 WHEN l = 0 THEN preorder + in_order - 1 WHEN m = 0 THEN preorder + 1 ELSE preorder END AS INT) AS post,
      CASE WHEN doc_id % 6 = 1 AND t IN ('H1', 'H2', 'H3', 'H4') THEN 'P' WHEN doc_id % 7 = 6 AND t = 'Form' THEN 'P' WHEN doc_id % 8 = 5 AND l = 0 AND t IN ('Sect', 'Div', 'Art') THEN 'P' ELSE t END AS tag,
      CAST(o % 3 + 1 AS INT) AS page, CASE WHEN (o + l) % 29 = 0 THEN repeat('long words ', 30) ELSE {pick("o + l + m", _ALTS)} END AS alt, {pick("o + 2 * l + m", [None, "", "()", "Read more", "Terms of use"])} AS actual_text, {pick("o + l", [None, "Column", "Row"])} AS scope,
      CASE WHEN m = 1 AND (o + l) % 6 <> 0 THEN 1 ELSE 0 END AS contents, m = 1 AND (o + l) % 12 = 0 AS has_objr, (o + l + m) % 19 = 0 AS k_null
      FROM (SELECT *, min(preorder) OVER (PARTITION BY doc_id, o) AS above, min(preorder) OVER (PARTITION BY doc_id, o, l) AS beside, count(*) OVER (PARTITION BY doc_id) AS in_doc, count(*) OVER (PARTITION BY doc_id, o) AS in_order,
        CASE WHEN m = 1 AND doc_id % 9 = 4 THEN CASE WHEN o = last_o THEN 'Form' ELSE 'P' END
          WHEN o = 0 THEN {pick("doc_id", ["Document", "Document", "Form", "Sect", "Document"])}
          WHEN l = 0 THEN {pick("o", _NODE_TAGS)}
          WHEN m = 0 THEN CASE {pick("o", _NODE_TAGS)} WHEN 'Table' THEN 'TR' WHEN 'L' THEN {pick("o + l", ["LI", "LI", "Span", "LI", "Caption"])} WHEN 'Sect' THEN CASE WHEN l % 2 = 0 THEN 'Sect' ELSE {pick("o + 3 * l", _PART_TAGS)} END ELSE {pick("o + 3 * l", _PART_TAGS)} END
          ELSE CASE {pick("o", _NODE_TAGS)} WHEN 'Table' THEN CASE WHEN (doc_id + o + l) % 4 = 0 AND doc_id % 5 <> 2 THEN 'TH' ELSE 'TD' END WHEN 'L' THEN CASE WHEN (o + l) % 3 = 0 THEN 'P' ELSE 'LBody' END WHEN 'Sect' THEN {pick("o + l", ["Sect", "P", "H4", "Sect"])} ELSE {pick("o + 2 * l", ["P", "Link", "Span", "Figure", "Form"])} END END AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, l, m) - 1 AS preorder, max(o) OVER (PARTITION BY doc_id) AS last_o
          FROM (SELECT DISTINCT {_OWNER} AS doc_id, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS l, 0 AS m FROM {{orders}}
            UNION ALL SELECT {_OWNER}, CAST(o_orderkey + 1 AS BIGINT), CAST(0 AS BIGINT), 0 FROM {{orders}}
            UNION ALL SELECT {_OWNER}, CAST(o_orderkey + 1 AS BIGINT), CAST(l_linenumber + 1 AS BIGINT), 0 FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey
            UNION ALL SELECT {_OWNER}, CAST(o_orderkey + 1 AS BIGINT), CAST(l_linenumber + 1 AS BIGINT), 1 FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey) a) b) c""",
    "role_map": f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, {pick("c_custkey", ["Odd", "P", "Other"])} AS tag, 'P' AS maps_to FROM {{customer}}""",
    "form_field": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey", ["name", "consent", "r", "g.a", " ", None, "street", "h.a", "name "])} AS name, {pick("o_orderkey", ["Tx", "Btn", "Btn", "Ch"])} AS ft,
      CAST({pick("o_orderkey", [0, 2, 32768, 65536, 32770, None, 98304])} AS INT) AS ff, {pick("o_orderkey", [None, "", "Field", "Your full name", "City (required)", "Age *", " Text ", "Pick one", "Required field", "Pick one", "Your full name"])} AS tooltip, CAST(o_orderkey % 4 AS INT) AS kids_n FROM {{orders}}""",
    "widget": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey % 3 + 1 AS INT) AS page, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey", ["name", "lost", "r", "g.a", None])} AS t FROM {{orders}}""",
    "pdf_page": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page, {pick("o_orderkey", ["S", "R", None, "", "S"])} AS tabs,
      CASE WHEN o_custkey % 10 = 7 THEN 'ab' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'Name: ____________' || chr(10) || 'and more' WHEN 1 THEN ' ' || chr(10) || 'abc' || chr(10) WHEN 2 THEN 'Some words on a page' WHEN 3 THEN 'A long line of words before the gap ____________ and a long line of words after it' WHEN 4 THEN '_______________' || chr(10) || '  ____________ x ' END END AS text,
      {pick("o_orderkey", [True, True, False, None, True, True, True])} AS extract_ok FROM {{orders}}""",
    "mcid_tree": """SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY o) - 1 AS INT) AS pos, CAST(o % 100000 AS INT) AS mcid FROM (SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey % 2 + 1 AS INT) AS page, o_orderkey AS o FROM {orders}) x""",
    "mcid_paint": """SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE doc_id % 3 WHEN 0 THEN o WHEN 1 THEN -o ELSE o % 5 END, o) - 1 AS INT) AS pos, CAST(CASE WHEN o % 13 = 0 THEN -1 - o % 1000 ELSE o % 100000 END AS INT) AS mcid
      FROM (SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey % 2 + 1 AS INT) AS page, o_orderkey AS o FROM {orders}) x""",
    "para": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey * 8 + l_linenumber AS INT) AS ord, CASE WHEN o_custkey % 4 = 1 THEN 'Normal' ELSE {pick("o_orderkey + l_linenumber", ["Normal", "Heading 1", "Normal", "Heading 2", "List Bullet", "Normal", "Heading 4", None, "Heading 7", "Normal", "Body"])} END AS style,
      {pick("o_orderkey + 3 * l_linenumber", _TEXTS)} AS text, {pick("l_linenumber", [False, False, True, None])} AS has_numpr FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey""",
    "drawing": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey", ["inline", "anchor"])} AS kind, {pick("o_orderkey", [None, "", "abc", "A long text", " ab ", " "])} AS descr, {pick("o_orderkey", ["", None, "Map", " ", "T"])} AS title, o_orderkey % 7 <> 0 AS has_docpr FROM {{orders}}""",
    "doc_table": """SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS INT) AS table_no, o_orderkey % 2 = 0 AS has_header, o_orderkey % 3 = 0 AS has_merged, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS INT) AS nested_n FROM {orders}""",
    "hyperlink": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey * 8 + l_linenumber AS INT) AS ord, {pick("o_orderkey", ["Sheet1", "Budget", "Plan"])} AS container, {pick("o_orderkey + l_linenumber", ["Click here.", "Annual report", "HTTPS://x.org", " here ", "url", "", "See here", "Town plan", None, "info", "visit us", "more info"])} AS text FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey""",
    "note": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey * 8 + l_linenumber AS INT) AS ord, {pick("l_linenumber", ["footnote", "endnote"])} AS kind, {pick("o_orderkey + l_linenumber", [None, "separator", "normal", "continuationSeparator"])} AS note_type, CASE WHEN (o_orderkey + l_linenumber) % 17 = 0 THEN {_LONG} ELSE 'short note' END AS text FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey""",
    "hdrftr": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS INT) AS section, {pick("o_orderkey", ["header", "footer"])} AS kind, {pick("o_orderkey", [False, False, True])} AS linked, {pick("o_orderkey", ["Draft for the board of 2024", "Page 1 of 20", "page 1 / 20 page 2 / 20 - - -", " ", None])} AS text FROM {{orders}}""",
    "sheet": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey", ["Sheet1", "Budget", "sheet1 ", "Plan", "TAB2", "Costs", "budget"])} AS name, {pick("o_orderkey", ["visible", "visible", "hidden", "visible", "veryHidden"])} AS state, CAST(o_orderkey % 9 AS INT) AS max_row, CAST(o_orderkey % 4 AS INT) AS max_col,
      {pick("o_orderkey", [True, False, None])} AS frozen, CAST({pick("o_orderkey", [0, 2, 0, 0, 3])} AS INT) AS merged_n, {pick("o_orderkey", [False, True, None, False])} AS protected, CAST({pick("o_orderkey", [0, 1, 0])} AS INT) AS hidden_rows, CAST({pick("o_orderkey", [0, 0, 3, 1])} AS INT) AS hidden_cols, {pick("o_orderkey", [False, None, True, False, False])} AS colour_fill FROM {{orders}}""",
    "sheet_row": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, {pick("o_orderkey", ["Sheet1", "Budget", "sheet1 ", "Plan", "TAB2", "Costs", "budget"])} AS sheet, CAST(l_linenumber AS INT) AS row_no, (o_orderkey + l_linenumber) % 4 <> 0 AS empty_first19 FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey""",
    "xl_table": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, {pick("o_orderkey + 1", ["Sheet1", "Budget", "Other", "Plan"])} AS sheet, 't' || (o_orderkey % 5) AS name, CAST({pick("o_orderkey", [1, 0, 1])} AS INT) AS header_row_count FROM {{orders}}""",
    "validation": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, 'Budget' AS sheet, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey", ["", None, "Amount", " "])} AS prompt_title, {pick("o_orderkey", [None, " ", "A number"])} AS prompt FROM {{orders}}""",
    "xl_drawing": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, {pick("o_orderkey", ["chart", "pic", "pic", "chart", "other"])} AS kind, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey + o_custkey % 2", ["Sales", None, "Growth", ""])} AS descr FROM {{orders}}""",
    "slide": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS slide_no, {pick("o_orderkey", ["Aims", "Results", "aims ", "", None, "Next steps", "Costs"])} AS title, {pick("o_orderkey", [True, True, False, True, None])} AS has_title_shape, {pick("o_orderkey", ["said", "", None, " ", "told"])} AS notes,
      {pick("o_orderkey", [None, "2500", "x", "", "1250", "60049"])} AS adv_tm, {pick("o_orderkey + o_custkey", [True, False, True, None, True])} AS animated FROM {{orders}}""",
    "shape": f"""SELECT doc_id, CAST(slide_no AS INT) AS slide_no, CAST(l AS INT) AS ord, CAST({pick("o + l", [1, 13, 14, 16, 3, 6, 17, 19, 13])} AS INT) AS shape_type, (o + l) % 5 = 2 AS is_title, {pick("o + 2 * l", ["left", "", " ", None, "right side"])} AS text, {pick("o + l", [None, "", "Picture", "A map of the town", "abc", " chart ", "Image1", "Growth by year"])} AS descr, {pick("o + 2 * l", [False, None, True, False, False, False])} AS decorative,
      CAST(l * 1500 AS BIGINT) AS left_emu, CAST((o + l) % 6 * 900 AS BIGINT) AS top_emu, CAST(o % 5 * 400 AS BIGINT) AS width_emu, (o + l) % 9 = 7 AS has_table, {pick("o", [True, False, None])} AS first_row
      FROM (SELECT CAST(o_custkey AS BIGINT) AS doc_id, o_orderkey AS o, l_linenumber AS l, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slide_no FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey) x""",
    "run_link": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(1 AS INT) AS slide_no, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey", ["Here.", "Town plan", " ", None, "LEARN MORE", "see  here", "url", "Annual report"])} AS text FROM {{orders}}""",
    "deck_section": f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS INT) AS ord, {pick("o_orderkey", ["Default Section", "Aims", "Costs", " aims", "Section 3", "People", "Dates"])} AS name FROM {{orders}}""",
    "epub_item": f"""SELECT DISTINCT CAST(o_custkey AS BIGINT) AS doc_id, 'i' || (o_orderkey % 5) AS item_id, {pick("o_orderkey % 5", ["text/part_one-A1b.xhtml", "b.two.xhtml", "c&d.xhtml", "..", None])} AS href, 'c' || (o_orderkey % 5) AS part FROM {{orders}}""",
    # a fourth of the books list each item once
    "epub_spine": f"""SELECT {_OWNER} AS doc_id, CAST(o_orderkey AS INT) AS ord, 'i' || (o_orderkey % 7 % 6) AS idref FROM {{orders}} WHERE o_custkey % 4 <> 1
      UNION ALL SELECT DISTINCT CAST(o_custkey AS BIGINT), CAST(o_orderkey % 5 AS INT), 'i' || (o_orderkey % 5) FROM {{orders}} WHERE o_custkey % 4 = 1""",
    "epub_pkg": f"""SELECT k AS doc_id, {pick("k", ["3.0", "2.0", None, "3.2"])} AS version, {pick("k", ["id", "uid", None])} AS unique_identifier, {pick("k", ["Title", "", None, " ", "Book"])} AS title, {pick("k + 1", ["en", "", None, "de"])} AS language, {pick("k + 2", ["C", None, " "])} AS creator, {pick("k + 1", ["D", None, ""])} AS description,
      {pick("k", [None, "id", "other", "uid", "id"])} AS id1, {pick("k", [None, "x", " ", "y", ""])} AS text1, {pick("k + 1", [None, "uid", None, "id"])} AS id2, {pick("k + 1", [None, "z", None, " "])} AS text2, k % 2 = 0 AS has_mode, k % 3 <> 1 AS has_feature, k % 5 <> 2 AS has_hazard,
      CASE k % 4 WHEN 0 THEN 'short one' WHEN 1 THEN repeat('word ', 50) WHEN 2 THEN repeat('word  ', 49) END AS summary, k % 9 = 3 AS fixed_layout, {pick("k", [True, False, True, None])} AS nav_present, k % 3 <> 0 AS has_toc, k % 5 <> 0 AS has_pages, k % 6 <> 2 AS has_landmarks, CAST({pick("k", [0, 3, None, 1, 0, 0])} AS INT) AS ncx_points,
      {pick("k", [True, True, True, False, True, None, True, True, True])} AS spine_present, {pick("k", [True, True, False, True, True, True, True, True])} AS manifest_present FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM {{customer}}) c""",
    "html_el": f"""SELECT doc_id, content_doc, CAST(ord AS INT) AS ord, CAST(CASE WHEN l = 0 THEN ord + n - 1 ELSE ord END AS INT) AS post, CASE WHEN l = 0 THEN {pick("o", ["table", "svg", "div", "p", "h2"])} ELSE {pick("o + l", ["img", "title", "th", "a", "math", "h1", "h3", "h2", "td", "img", "a"])} END AS el,
      {pick("o + l", [None, "", "A map", " ", "x"])} AS alt, {pick("o + 2 * l", [None, "presentation", "img"])} AS role, {pick("o + l", [None, "", "a plus b"])} AS alttext, {pick("o + 2 * l", ["Read more", " here ", "Chapter one", "", None, "GO", "a < b & c"])} AS inner_text, {pick("o + l", ["a.png", None, "img/b & c.jpg", ""])} AS src
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, content_doc ORDER BY o, l) - 1 AS ord, count(*) OVER (PARTITION BY doc_id, o) AS n
        FROM (SELECT CAST(o_custkey AS BIGINT) AS doc_id, 'c' || (o_orderkey % 3) AS content_doc, o_orderkey AS o, CAST(0 AS BIGINT) AS l FROM {{orders}} UNION ALL SELECT CAST(o_custkey AS BIGINT), 'c' || (o_orderkey % 3), o_orderkey, CAST(l_linenumber AS BIGINT) FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey) a) b""",
}

_MARKDOWN = ["# @", "", "## @", "Plain words about @.", "See [here](a.pdf) and [@](b.zip).", "![](x.png)", "![photo](x.png) and ![cat.jpeg](y.png)", "### @ ☀", "| a | | c |", "|---|---|---|", "[www.x.org](u) and [read more about it](v)", "+----+----+----+", "```mermaid", "```", "text 😀😀 here", "#### @", "# @", "[Fine text](c.docx) ![A cat](z)", "  ", "[Get the zip](b.zip)"]
#: Lines of the Markdown documents: a customer's line items in order, the kind of line by their keys.
FACTS["md_line"] = f"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey) AS INT) AS line_no, replace({pick("o_orderkey + 7 * l_linenumber + l_partkey", _MARKDOWN)}, '@', 'part ' || (l_partkey % 9)) AS raw FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey"""

# The tables with the parts of each type's documents.
_PARTS_OF = {
    "pdf": ("struct_node", "role_map", "pdf_page", "form_field", "widget", "mcid_tree", "mcid_paint"),
    "docx": ("para", "hdrftr", "drawing", "doc_table", "note", "hyperlink"),
    "xlsx": ("sheet", "sheet_row", "xl_drawing", "xl_table", "validation", "hyperlink"),
    "pptx": ("slide", "shape", "run_link", "deck_section"),
    "epub": ("epub_pkg", "epub_item", "epub_spine", "html_el"),
    "md": ("md_line",),
}


def _of_types(name: str, sql: str) -> str:
    """The whole table for each type that has such parts, the customer's key replaced by that of its document of the type."""
    places = [i for i, kind in enumerate(_TYPES) if name in _PARTS_OF[kind]]
    return " UNION ALL ".join(re.sub(r"\b[oc]_custkey\b", rf"(\g<0> * {_APART} + {i})", sql) for i in places)


#: Each table for one type, by the key of its documents.
_OF_TYPE = FACTS
FACTS = {name: _of_types(name, sql) if name != "doc" else sql for name, sql in _OF_TYPE.items()}

_NESTED = {
    "struct_node": lambda df: df.withColumn("attrs", F.when(F.col("scope").isNull(), F.create_map()).otherwise(F.create_map(F.lit("Scope"), F.col("scope"))).cast("map<string,string>")).withColumn("mcids", F.when(F.col("contents") > 0, F.array("preorder")).otherwise(F.array()).cast("array<int>")),
    "epub_pkg": lambda df: df.withColumn("identifiers", F.expr("filter(array(named_struct('id', id1, 'text', text1), named_struct('id', id2, 'text', text2)), x -> x.id is not null)"))
    .withColumn("metas", F.expr("filter(array(if(has_mode, named_struct('property', 'schema:accessMode', 'text', 'a'), null), if(has_feature, named_struct('property', 'schema:accessibilityFeature', 'text', 'b'), null), if(has_hazard, named_struct('property', 'schema:accessibilityHazard', 'text', 'c'), null), if(summary is not null, named_struct('property', 'schema:accessibilitySummary', 'text', summary), null), if(fixed_layout, named_struct('property', 'rendition:layout', 'text', 'pre-paginated'), null)), x -> x is not null)"))
    .withColumn("nav_types", F.expr("filter(array(if(has_toc, 'toc', null), if(has_pages, 'page-list', null), if(has_landmarks, 'landmarks', null)), x -> x is not null)")),
    "html_el": lambda df: df.withColumn("attrs", F.expr("map_filter(map('alt', alt, 'role', role, 'alttext', alttext, 'src', src), (k, v) -> v is not null)")),
}


_written: dict[tuple[str, str, str], str] = {}

_LINES = "{orders} JOIN {lineitem} ON l_orderkey = o_orderkey"
# Tables whose places in a document are numbered, so that they are stored; the others are read off the parts.
_STORED = ("doc", "struct_node", "role_map", "pdf_page", "mcid_tree", "mcid_paint", "slide", "shape", "epub_pkg", "epub_item", "epub_spine", "html_el", "md_line")


def _buckets(lines: int) -> int:
    """Files of each stored table: of 100,000 line items each, and beyond 96 of 500,000."""
    return max(4, min(lines // 100_000, 96), lines // 500_000)


class _Facts:
    """The driver's tables by documents: all that is stored lies in files by a hash of the document, so that what
    goes by documents (numbers, rules, joins) needs no further shuffle."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made_from = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders", "lineitem")}

    def once(self, name: str, make) -> DataFrame:
        """A table written by documents once per application, and read from there."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            with by_documents(self.spark):
                _written[key] = table_by(make(), f"fact-{name}", self.buckets())
        return self.spark.table(_written[key])

    def buckets(self) -> int:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "")
        if key not in _written:
            _written[key] = str(_buckets(self.made_from["lineitem"].count()))
        return int(_written[key])

    def orders(self) -> DataFrame:
        """Orders with their line items, joined once: o_custkey, o_orderkey, lines."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "orders with lines")
        if key not in _written:
            line = F.struct("l_linenumber", "l_partkey")
            lines = self.made_from["lineitem"].filter("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
            path = new_path(self.spark, "fact-orders")
            self.made_from["orders"].select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left").write.parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])

    def parts(self, kind: str, owner: bool = False) -> DataFrame:
        """Orders of the documents of a type: doc_id, o_orderkey, lines; with ``owner`` by the document that has the
        parts of those without any, and one row more for each such document (o_orderkey null)."""

        def make() -> DataFrame:
            key = F.col("o_custkey") * _APART + _TYPES.index(kind)
            lines = F.col("lines") if kind == "md" else F.col("lines.l_linenumber").alias("lines")
            rows = self.orders().select(key.alias("o_custkey"), "o_orderkey", lines)
            if owner:
                rows = rows.selectExpr(f"{_OWNER} AS doc_id", "o_orderkey", "lines")
                rows = rows.unionByName(rows.select("doc_id").distinct(), allowMissingColumns=True)
            else:
                rows = rows.withColumnRenamed("o_custkey", "doc_id")
            return rows.repartition(self.buckets(), "doc_id")

        # these are read by one table alone, which is stored itself
        return make() if owner or kind == "md" else self.once(f"parts-{kind}", make)

    def of_type(self, source: str, kind: str) -> DataFrame:
        """A table's rows for one type, from the parts of its documents."""
        sql = looked_up(_OF_TYPE[source])
        if source in ("role_map", "epub_pkg"):
            key = F.col("c_custkey") * _APART + _TYPES.index(kind)
            return self.spark.sql(sql, customer=self.made_from["customer"].withColumn("c_custkey", key)).repartition(self.buckets(), "doc_id")
        if source == "epub_spine":
            orders = self.orders().withColumn("o_custkey", F.col("o_custkey") * _APART + _TYPES.index(kind))
            return self.spark.sql(sql, orders=orders).repartition(self.buckets(), "doc_id")
        if source == "struct_node":
            # the document itself, an order, and two elements for each of its line items
            o = F.when(F.col("o_orderkey").isNull(), 0).otherwise(F.col("o_orderkey") + 1).cast("long")
            places = "concat(array(0L), flatten(transform(coalesce(lines, array()), x -> array(2L * (x + 1), 2L * (x + 1) + 1))))"
            elements = self.parts(kind, owner=True).select("doc_id", o.alias("o"), F.explode(F.expr(places)).alias("place")).selectExpr("doc_id", "o", "shiftright(place, 1) AS l", "cast(place & 1 AS int) AS m")
            return self.spark.sql(re.sub(r"FROM \(SELECT DISTINCT.*\) a\)", "FROM {elements} a)", sql, flags=re.S), elements=elements)
        parts = self.parts(kind).withColumnRenamed("doc_id", "o_custkey")
        if source == "html_el":
            elements = parts.selectExpr("cast(o_custkey AS bigint) AS doc_id", "'c' || (o_orderkey % 3) AS content_doc", "o_orderkey AS o", "explode(concat(array(0L), cast(coalesce(lines, array()) AS array<bigint>))) AS l")
            return self.spark.sql(re.sub(r"FROM \(SELECT CAST.*\) a\)", "FROM {elements} a)", sql, flags=re.S), elements=elements)
        if _LINES in sql:
            line = parts.select("o_custkey", "o_orderkey", F.explode("lines").alias("l_linenumber"))
            line = line.select("o_custkey", "o_orderkey", "l_linenumber.*") if kind == "md" else line
            return self.spark.sql(sql.replace(_LINES, "{parts}"), parts=line)
        return self.spark.sql(sql, orders=parts)

    def table(self, source: str) -> DataFrame:
        name = "md_text" if source == "md_line" else source
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema

        def make() -> DataFrame:
            if source == "doc":
                df = self.spark.sql(looked_up(FACTS["doc"]), customer=self.made_from["customer"]).repartition(self.buckets(), "doc_id")
            else:
                df = reduce(DataFrame.unionAll, (self.of_type(source, kind) for kind in _TYPES if name in _PARTS_OF[kind] or source in _PARTS_OF[kind]))
            if source == "md_line":
                lines = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
                df = df.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["raw"]), "\n").alias("text"))
            df = _NESTED.get(name, lambda d: d)(df)
            return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

        return self.once(name, make) if source in _STORED else make()


def files(spark: SparkSession, sf_dir: str) -> int:
    """In how many files, by a hash of the document, each stored fact table lies."""
    return _Facts(spark, sf_dir).buckets()


def tables(spark: SparkSession, sf_dir: str, names: set[str] | None = None) -> dict[str, DataFrame]:
    """Fact tables (of these names, or all) with the schemas that rules read.

    Orders and line items are joined once and dealt out by documents once a type; a table whose rows are numbered in
    their documents is written once per application and read from there, the others are read off those parts.
    """
    facts = _Facts(spark, sf_dir)
    sources = {"md_text" if source == "md_line" else source: source for source in FACTS}
    return {name: facts.table(source) for name, source in sources.items() if names is None or name in names}
