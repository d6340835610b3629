"""The rules in DuckDB SQL over the same facts, written from what each rule says and not from the Spark plans."""

from __future__ import annotations

import re

from lectern.facts import FACTS
from lectern.plans import dims


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _t(c: str) -> str:
    return f"trim(coalesce({c}, ''), E' \\n')"


def _no(c: str) -> str:
    return f"{_t(c)} = ''"


PDF = "(SELECT * FROM doc WHERE type = 'pdf' AND access_ok)"
TREE = f"(SELECT * FROM {PDF} WHERE tree_present)"
HEADS = "(SELECT doc_id, page, preorder, tag, CAST(tag[2] AS INT) AS level FROM struct_node WHERE tag IN ('H1', 'H2', 'H3', 'H4', 'H5', 'H6'))"
INSIDE = "h.doc_id = t.doc_id AND h.preorder BETWEEN t.preorder + 1 AND t.post"
LEAF = "(SELECT doc_id, tag = 'Form' AS form, row_number() OVER (PARTITION BY doc_id ORDER BY preorder) - 1 AS i FROM struct_node n WHERE (contents > 0 OR has_objr) AND NOT EXISTS (SELECT 1 FROM struct_node c WHERE c.doc_id = n.doc_id AND c.parent_id = n.node_id))"
RADIO, PUSH, NEEDED = "(ft = 'Btn' AND (coalesce(ff, 0) & 32768) <> 0)", "(ft = 'Btn' AND (coalesce(ff, 0) & 65536) <> 0)", "(coalesce(ff, 0) & 2) <> 0"
# Weak alternative texts, language tags.
WEAK_ALT = r"regexp_matches({0}, '(?i)\.(png|jpe?g|gif|bmp|tif|tiff|svg|webp|ico)$') OR regexp_matches({0}, '(?i)^(image|picture|photo|figure|graphic|screenshot|untitled)\s*[0-9]*$') OR regexp_matches({0}, '(?i)^img[\s_-]?[0-9]+$') OR regexp_matches({0}, '(?i)^(dsc|img)[_-]?[0-9]+$')"
LANGUAGE = r"^[a-zA-Z]{2,3}(-[a-zA-Z]{4})?(-[a-zA-Z]{2}|[0-9]{3})?(-([a-zA-Z0-9]{5,8}|[0-9][a-zA-Z0-9]{3}))*$"
WEAK_LINK = ("click here", "here", "more", "read more", "learn more", "link", "see more", "details", "info", "this link", "go", "go here", "visit", "press here")
#: Blanks inside a phrase count as one.
_one = lambda c: f"regexp_replace(lower({c}), '\\s+', ' ', 'g')"
LINK = f"(SELECT doc_id, page, {_t('coalesce(alt, actual_text)')} AS t FROM struct_node WHERE tag = 'Link')"
LISTS = "(SELECT p.doc_id, p.depth, p.preorder, count(c.node_id) AS items FROM struct_node p LEFT JOIN struct_node c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id AND c.tag = 'LI' WHERE p.tag = 'L' GROUP BY ALL)"
FORM_N = "(SELECT doc_id, count(*) FILTER (depth = 1) AS top, count(*) FILTER (depth > 1) AS low, count(*) AS forms FROM struct_node WHERE tag = 'Form' GROUP BY doc_id)"

CORE = [
    ("PDFUA.TITLE", "error", "2.4.2", f"SELECT doc_id FROM {PDF} WHERE {_no('title')}"),
    ("PDFUA.LANG", "error", "3.1.1", f"SELECT doc_id FROM {PDF} WHERE {_no('lang')}"),
    ("PDFUA.TAGGED", "error", "1.3.1", f"SELECT doc_id, 'tree' AS element FROM {PDF} WHERE tree_present IS NOT TRUE UNION ALL SELECT doc_id, 'mark' FROM {TREE} WHERE mark_info_present IS NOT TRUE OR tagged IS NOT TRUE UNION ALL SELECT doc_id, 'empty' FROM {TREE} WHERE doc_id NOT IN (SELECT doc_id FROM struct_node)"),
    ("PDFUA.IMG.ALT", "error", "1.1.1", f"SELECT doc_id, page, '' || node_id AS element FROM struct_node WHERE tag = 'Figure' AND {_no('alt')}"),
    ("PDFUA.HEADINGS", "warning", "2.4.6", f"SELECT doc_id, page, tag AS element FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY preorder) AS p FROM {HEADS}) WHERE level - p > 1"),
    ("PDFBP.TABLE_SCOPE", "warning", "1.3.1", f"SELECT h.doc_id, h.page, '' || h.node_id AS element FROM struct_node h JOIN struct_node t ON {INSIDE} WHERE h.tag = 'TH' AND t.tag = 'Table' AND h.scope IS NULL"),
    ("PDFBP.TABLE_HEADERS", "warning", "1.3.1", f"SELECT doc_id, page, '' || node_id AS element FROM struct_node t WHERE tag = 'Table' AND NOT EXISTS (SELECT 1 FROM struct_node h WHERE h.tag = 'TH' AND {INSIDE})"),
    ("PDFUA.FORMS", "error", "4.1.2", f"SELECT doc_id, name AS element FROM form_field WHERE {_no('tooltip')} UNION ALL SELECT doc_id, '' || ord FROM form_field WHERE {_no('name')}"),
    ("PDFUA.BOOKMARKS", "warning", "2.4.1", f"SELECT doc_id FROM {PDF} WHERE pages > 20 AND outlines_present IS NOT TRUE"),
    ("PDFBP.DISPLAY_TITLE", "warning", "2.4.2", f"SELECT doc_id FROM {PDF} WHERE viewer_prefs_present IS NOT TRUE OR display_doc_title IS NOT TRUE"),
    ("PDFBP.NO_HEADINGS", "warning", "2.4.6", f"SELECT doc_id FROM {TREE} WHERE doc_id NOT IN (SELECT doc_id FROM {HEADS})"),
    ("PDFBP.NONSTD_NO_ALT", "warning", "1.1.1", "SELECT doc_id, page, tag AS element FROM struct_node WHERE (doc_id, tag) IN (SELECT (doc_id, tag) FROM role_map) AND (alt IS NULL OR alt = '' OR alt = '()') AND (actual_text IS NULL OR actual_text = '' OR actual_text = '()')"),
    ("PDFBP.FORMS_DETACHED", "error", "1.3.2", f"SELECT doc_id, f AS n FROM (SELECT doc_id, count(*) FILTER (form) AS f, count(*) FILTER (NOT form) AS t, min(i) FILTER (form) AS a, max(i) FILTER (form) + 1 AS b FROM {LEAF} GROUP BY doc_id) WHERE f > 1 AND t > 0 AND 2 * a > t AND (b - a - f) * 10 < b - a"),
    ("PDFBP.UNDERSCORE_FILL", "warning", "1.3.1", f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT page)), ', ') AS element, count(*) AS n FROM (SELECT doc_id, page, {_t('line')} AS l FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line FROM pdf_page)) WHERE l LIKE '%' || repeat('!_', 12) || '%' ESCAPE '!' AND 10 * len(regexp_extract_all(l, '_')) >= 3 * length(l) GROUP BY doc_id"),
    ("PDFBP.NAV.TABORDER", "warning", "2.4.3", "SELECT doc_id, page FROM pdf_page WHERE tabs IS DISTINCT FROM 'S'"),
    ("PDFBP.TEXT.EXTRACTABLE", "warning", "1.1.1", f"SELECT doc_id, CASE WHEN len(bad) = pages THEN 'error' ELSE 'warning' END AS severity, CAST(len(bad) AS BIGINT) AS n, array_to_string(list_sort(bad)[1:10], ', ') AS element FROM (SELECT doc_id, count(*) AS pages, list(page) FILTER (extract_ok = false OR length({_t('text')}) < 5) AS bad FROM pdf_page GROUP BY doc_id) WHERE len(bad) > 0"),
    ("PDFBP.ALT_LENGTH", "warning", "1.1.1", f"SELECT doc_id, page, '' || node_id AS element FROM struct_node WHERE tag = 'Figure' AND length({_t('alt')}) > 250"),
    ("PDFBP.ALT_QUALITY", "warning", "1.1.1", f"SELECT doc_id, page, alt AS element FROM struct_node WHERE tag = 'Figure' AND ({WEAK_ALT.format(_t('alt'))})"),
    ("PDFBP.LANG_VALID", "error", "3.1.1", f"SELECT doc_id, lang AS element FROM {PDF} WHERE NOT {_no('lang')} AND NOT regexp_matches({_t('lang')}, '{LANGUAGE}')"),
    ("PDFBP.LINK_TEXT", "warning", "2.4.4", f"SELECT doc_id, page, t AS element FROM {LINK} WHERE {_one('t')} IN {_list(WEAK_LINK)} OR regexp_matches(t, '(?i)^https?://[^\\s]{{20,}}$')"),
    ("PDFBP.EMPTY_TAGS", "warning", "1.3.1", f"SELECT doc_id, count(*) AS n FROM struct_node WHERE k_null AND tag IN {_list(dims.TEXT_TAGS)} GROUP BY doc_id"),
    ("PDFBP.FORMS.DUPLICATE_NAMES", "error", "4.1.2", f"SELECT doc_id, {_t('name')} AS element, count(*) AS n FROM form_field WHERE NOT {RADIO} AND NOT {_no('name')} GROUP BY ALL HAVING n > 1"),
    ("PDFBP.FORMS.RADIO_GROUP", "warning", "4.1.2", f"SELECT doc_id, name AS element, CAST(arg_max(kids_n, ord) AS BIGINT) AS n FROM form_field WHERE {RADIO} AND NOT {PUSH} GROUP BY doc_id, name HAVING n < 2"),
    ("PDFBP.LIST_STRUCT", "warning", "1.3.1", "SELECT l.doc_id, any_value(l.page) AS page, array_to_string(list_sort(list(c.tag))[1:5], ', ') AS element, count(*) AS n FROM struct_node l JOIN struct_node c ON c.doc_id = l.doc_id AND c.parent_id = l.node_id WHERE l.tag = 'L' AND c.tag <> 'LI' AND c.tag <> 'Caption' GROUP BY l.doc_id, l.node_id UNION ALL SELECT i.doc_id, i.page, '' || i.node_id, 1 FROM struct_node i WHERE i.tag = 'LI' AND EXISTS (SELECT 1 FROM struct_node l WHERE l.doc_id = i.doc_id AND l.node_id = i.parent_id AND l.tag = 'L') AND NOT EXISTS (SELECT 1 FROM struct_node b WHERE b.doc_id = i.doc_id AND b.parent_id = i.node_id AND b.tag = 'LBody')"),
    ("PDFBP.FIGURE_CAPTION", "tip", "1.1.1", "SELECT doc_id, page, '' || node_id AS element FROM struct_node c WHERE tag = 'Caption' AND NOT EXISTS (SELECT 1 FROM struct_node f WHERE f.doc_id = c.doc_id AND f.parent_id = c.parent_id AND f.tag = 'Figure')"),
    ("PDFBP.ART_TAGS", "tip", "1.3.1", "SELECT doc_id, count(*) AS n FROM struct_node WHERE tag = 'Art' GROUP BY doc_id"),
    ("PDFBP.SECT_NESTING", "tip", "1.3.1", "SELECT doc_id, max(d) AS n FROM (SELECT h.doc_id, h.node_id, count(*) + 1 AS d FROM struct_node h JOIN struct_node t ON " + INSIDE + " WHERE h.tag = 'Sect' AND t.tag = 'Sect' GROUP BY ALL) GROUP BY doc_id HAVING n > 3"),
    ("PDFBP.FORMS.TOOLTIP_QUALITY", "warning", "4.1.2", f"SELECT doc_id, name AS element FROM form_field WHERE lower({_t('tooltip')}) IN {_list(dims.GENERIC_TOOLTIPS)}"),
    ("PDFBP.FLAT_STRUCTURE", "tip", "1.3.1", "SELECT c.doc_id, count(*) AS n FROM struct_node r JOIN struct_node c ON c.doc_id = r.doc_id AND c.parent_id = r.node_id WHERE r.depth = 1 AND r.preorder = 0 AND r.tag = 'Document' GROUP BY c.doc_id HAVING count(*) > 10 AND NOT bool_or(c.tag IN ('Sect', 'Part', 'Art', 'Div'))"),
]
METADATA = [
    ("PDFUA.METADATA.TITLE", "Error", "2.4.2", f"SELECT doc_id FROM {PDF} WHERE {_no('title')}"),
    ("PDFUA.METADATA.LANG", "Error", "3.1.1", f"SELECT doc_id FROM {PDF} WHERE {_no('coalesce(lang, info_lang)')}"),
    ("PDFUA.METADATA.LANG.REVIEW", "Info", "3.1.1", f"SELECT doc_id, lang AS element FROM {PDF} WHERE lower(coalesce(lang, info_lang)) IN ('en', 'en-us', 'en-gb')"),
    ("PDFBP.DISPLAY.DOCTITLE", "Warning", "2.4.2", f"SELECT doc_id FROM {PDF} WHERE display_doc_title IS NOT TRUE"),
    ("PDFUA.STRUCT.TAGGED", "Error", "1.3.1", f"SELECT doc_id FROM {PDF} WHERE tagged IS NOT TRUE"),
    ("PDFQ.METADATA.PDFUA", "Info", None, f"SELECT doc_id FROM {PDF} WHERE xmp IS NULL OR xmp NOT ILIKE '%pdfuaid%'"),
]
INVERTED = """(SELECT s.doc_id, s.page, s.tn, p.pn, coalesce(x.n, 0) AS n, coalesce(x.bad, 0) AS bad FROM (SELECT doc_id, page, count(*) AS tn FROM mcid_tree GROUP BY ALL) s JOIN (SELECT doc_id, page, count(*) AS pn FROM mcid_paint GROUP BY ALL) p ON s.doc_id = p.doc_id AND s.page = p.page
  LEFT JOIN (SELECT doc_id, page, count(DISTINCT a) AS n, count(*) FILTER (before AND ta > tb) AS bad FROM (
    SELECT a.doc_id, a.page, a.pos AS a, a.pos < b.pos AS before, a.t AS ta, b.t AS tb FROM both_sides a JOIN both_sides b ON a.doc_id = b.doc_id AND a.page = b.page) GROUP BY ALL) x ON x.doc_id = s.doc_id AND x.page = s.page)"""
TAGS = [
    ("PDFUA.STRUCT.NOTREE", "Error", None, f"SELECT doc_id FROM {PDF} WHERE tree_present IS NOT TRUE"),
    ("PDFUA.FORM.STRUCT", "Error", "1.3.2", f"SELECT doc_id, CASE WHEN low > 0 THEN 'Warning' ELSE 'Error' END AS severity, top AS n FROM {FORM_N} WHERE top > 0"),
    ("PDFBP.FORM.STRUCT", "Warning", "1.3.1", f"SELECT doc_id FROM {TREE} WHERE doc_id NOT IN (SELECT doc_id FROM {FORM_N})"),
    ("PDFBP.LIST.CONTINUATION", "Warning", "1.3.1", f"SELECT doc_id, 1 AS page, count(*) AS n FROM (SELECT doc_id, depth, items, lag(depth) OVER w AS d, lag(items) OVER w AS i FROM {LISTS} WINDOW w AS (PARTITION BY doc_id ORDER BY preorder)) WHERE d = depth AND least(i, items) <= 5 GROUP BY doc_id"),
    ("PDFQ.NONSTD.ROLE", "Info", None, f"SELECT doc_id, tag AS element, count(*) AS n FROM struct_node WHERE tag NOT IN {_list((*dims.STANDARD_TAGS, 'Unknown'))} AND (doc_id, tag) NOT IN (SELECT (doc_id, tag) FROM role_map) GROUP BY ALL"),
    ("PDFBP.HEADING.SKIP", "Warning", "1.3.1", f"SELECT doc_id, string_agg('' || level, ', ' ORDER BY level) AS element FROM (SELECT doc_id, unnest(range(1, max(level))) AS level FROM {HEADS} GROUP BY doc_id) WHERE (doc_id, level) NOT IN (SELECT (doc_id, level) FROM {HEADS}) GROUP BY doc_id"),
    ("PDFUA.TABLE.HEADERS", "Error", "1.3.1", "SELECT doc_id, count(*) AS n FROM struct_node WHERE tag = 'Table' AND doc_id NOT IN (SELECT doc_id FROM struct_node WHERE tag = 'TH') GROUP BY doc_id"),
    ("PDFUA.IMG.ALT", "Error", "1.1.1", f"SELECT doc_id, sum(CASE WHEN {_no('alt')} THEN 1 ELSE 0 END)::BIGINT AS n, '' || count(*) AS element FROM struct_node WHERE tag = 'Figure' GROUP BY doc_id HAVING n > 0"),
    ("PDFBP.ORDER.FIGURE", "Warning", "1.3.2", "SELECT f.doc_id, count(*) AS n FROM (SELECT doc_id, parent_id, tag, ord, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY ord) AS k FROM struct_node) f JOIN (SELECT doc_id, parent_id, tag, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY ord) AS k FROM struct_node) g ON g.doc_id = f.doc_id AND g.parent_id = f.parent_id AND g.k = f.k + 1 WHERE f.tag = 'Figure' AND g.tag <> 'Caption' GROUP BY f.doc_id"),
    ("PDFBP.ORDER.MCID", "Warning", "1.3.2", f"SELECT doc_id, page, n FROM {INVERTED} WHERE tn > 2 AND pn > 2 AND n > 1 AND 8 * bad > n * (n - 1)"),
    ("PDFQ.ORDER.MANUAL", "Info", "1.3.2", f"SELECT doc_id FROM {TREE}"),
]
FORMS = [
    ("PDFBP.FORMS.NOACROFORM", "Info", None, f"SELECT doc_id FROM {PDF} WHERE acroform_present IS NOT TRUE"),
    ("PDFBP.NAV.TABORDER", "Warning", "2.4.3", "SELECT doc_id, string_agg('' || page, ', ' ORDER BY page) AS element, count(*) AS n FROM pdf_page WHERE tabs IS NULL AND doc_id IN (SELECT doc_id FROM doc WHERE acroform_present) GROUP BY doc_id"),
    ("PDFUA.FORM.TU", "Warning", "1.3.1", f"SELECT doc_id, CASE WHEN count(*) FILTER (name ILIKE '%consent%' OR name ILIKE '%agree%' OR name ILIKE '%auth%' OR name ILIKE '%check%') > 0 THEN 'Error' ELSE 'Warning' END AS severity, count(*) AS n FROM form_field WHERE {_no('tooltip')} AND NOT {PUSH} GROUP BY doc_id"),
    ("PDFBP.FORMS.REQUIRED_LABEL", "Warning", "3.3.2", f"SELECT doc_id, count(*) AS n FROM form_field WHERE {NEEDED} AND NOT {_no('tooltip')} AND NOT (tooltip ILIKE '%required%' OR tooltip LIKE '%*%') GROUP BY doc_id"),
    ("PDFBP.FORMS.BUTTON_TOOLTIP", "Warning", "4.1.2", f"SELECT doc_id, count(*) AS n FROM form_field WHERE {PUSH} AND NOT {_no('tooltip')} GROUP BY doc_id"),
    ("PDFBP.FORMS.RADIO_TOOLTIP", "Warning", "1.3.1", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, string_split(name, '.')[-1] AS g FROM form_field WHERE {RADIO} AND tooltip IS NOT NULL GROUP BY ALL HAVING min(tooltip) <> max(tooltip)) GROUP BY doc_id"),
    ("PDFBP.FORM.STRUCT", "Warning", "1.3.1", f"SELECT doc_id, count(*) AS n FROM form_field WHERE doc_id IN (SELECT doc_id FROM {TREE}) AND doc_id NOT IN (SELECT doc_id FROM {FORM_N}) GROUP BY doc_id"),
    ("PDFUA.FORM.STRUCT", "Error", "1.3.2", f"SELECT f.doc_id, count(*) - any_value(t.forms) AS n FROM form_field f JOIN {FORM_N} t ON t.doc_id = f.doc_id GROUP BY f.doc_id HAVING n > 0"),
    ("PDFBP.FORM.ORPHAN", "Warning", None, "SELECT doc_id, page, t AS element FROM widget w WHERE NOT EXISTS (SELECT 1 FROM form_field f WHERE f.doc_id = w.doc_id AND f.name = w.t)"),
]


def _meta(kind: str, sep: str, lang: bool = True) -> list[tuple]:
    out = [(f"{kind.upper()}{sep}META.{what.upper()}", "Error", wcag, f"SELECT doc_id FROM doc WHERE type = '{kind}' AND access_ok AND {_no(what)}") for what, wcag in (("title", "2.4.2"), ("lang", "3.1.1"))]
    return out if lang else out[:1]


PLEVEL = "(SELECT doc_id, ord, CAST(style[-1:] AS INT) AS level FROM para WHERE regexp_full_match(style, 'Heading [1-6]'))"
#: The least higher level that no heading before has; the levels are few, so each is asked by name.
_seen_before = ", ".join(f"bool_or(level = {i}) OVER w AS s{i}" for i in range(1, 6))
SEEN = f"(SELECT *, CASE {' '.join(f'WHEN level > {i} AND s{i} IS NOT TRUE THEN {i}' for i in range(1, 6))} END AS gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, {_seen_before} FROM {PLEVEL} WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"
BODY_NOTE = "(SELECT * FROM note WHERE note_type IS NULL OR note_type NOT IN ('separator', 'continuationSeparator'))"
MARKER = r"(regexp_matches(text, '^\s*[•●○■▪▸►–—*-]\s') OR regexp_matches(text, '^\s*([0-9]{1,3}|[a-zA-Z]|[ivxIVX]+)[.)]\s'))"
DOCX = [
    *_meta("docx", "-"),
    ("DOCX-STRUCT.HEADINGS", "Warning", "1.3.1", f"SELECT doc_id, count(*) AS n FROM para WHERE NOT {_no('text')} AND doc_id NOT IN (SELECT doc_id FROM {PLEVEL}) GROUP BY doc_id HAVING n > 10"),
    ("DOCX-STRUCT.HEADINGSKIP", "Warning", "1.3.1", f"SELECT doc_id, 'H' || level || ' first' AS element FROM {SEEN} WHERE k = 1 AND level > 1 UNION ALL SELECT doc_id, 'H' || level || ' before H' || gap FROM {SEEN} WHERE gap IS NOT NULL"),
    ("DOCX-IMG.ALT", "Error", "1.1.1", f"SELECT doc_id, count(*) AS n FROM drawing WHERE kind = 'inline' AND (has_docpr = false OR {_t('descr')} || {_t('title')} = '') GROUP BY doc_id"),
    ("DOCX-IMG.ALT_QUALITY", "Warning", "1.1.1", f"SELECT doc_id, kind AS element, count(*) AS n FROM drawing WHERE length({_t('descr')}) BETWEEN 1 AND 3 GROUP BY ALL"),
    ("DOCX-TABLE.HEADERS", "Warning", "1.3.1", "SELECT doc_id, '' || table_no AS element FROM doc_table WHERE NOT has_header"),
    ("DOCX-TABLE.MERGE", "Warning", "1.3.1", "SELECT doc_id, '' || table_no AS element FROM doc_table WHERE has_merged"),
    ("DOCX-LINK.DESCRIPTIVE", "Warning", "2.4.4", f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT t))[1:5], ', ') AS element, count(*) AS n FROM (SELECT doc_id, {_t('text')} AS t FROM hyperlink) WHERE doc_id IN (SELECT doc_id FROM doc WHERE type = 'docx') AND regexp_replace(lower(t), '[.]$', '') IN {_list(dims.VAGUE_LINKS['docx'])} GROUP BY doc_id"),
    ("DOCX-STRUCT.EMPTYPARA", "Info", None, f"SELECT doc_id, count(*) AS n FROM para WHERE style = 'Normal' AND {_no('text')} GROUP BY doc_id HAVING n >= 4"),
    ("DOCX-IMG.ALT_FLOAT", "Error", "1.1.1", f"SELECT doc_id, count(*) AS n FROM drawing WHERE kind = 'anchor' AND {_t('descr')} || {_t('title')} = '' GROUP BY doc_id"),
    ("DOCX-LIST.SEMANTIC", "Warning", "1.3.1", f"SELECT doc_id, count(*) AS n FROM para WHERE NOT {_no('text')} AND NOT regexp_matches(coalesce(style, ''), '(?i)list|bullet|number|toc') AND has_numpr IS NOT TRUE AND {MARKER} GROUP BY doc_id HAVING n > 2"),
    ("DOCX-TABLE.NESTED", "Error", "1.3.1", "SELECT doc_id, sum(nested_n)::BIGINT AS n FROM doc_table GROUP BY doc_id HAVING n > 0"),
    ("DOCX-STRUCT.TOC", "Warning", "2.4.5", "SELECT doc_id, count(*) AS n FROM para WHERE regexp_full_match(style, 'Heading [1-9]') AND doc_id IN (SELECT doc_id FROM doc WHERE toc_present IS NOT TRUE) GROUP BY doc_id HAVING n >= 5"),
    ("DOCX-REVIEW.TRACKED", "Warning", "1.3.1", "SELECT doc_id, tracked_n::BIGINT AS n FROM doc WHERE type = 'docx' AND access_ok AND tracked_n > 0"),
    ("DOCX-STRUCT.HDRFTR", "Info", "1.3.2", f"SELECT doc_id, count(*) AS n FROM hdrftr WHERE NOT linked AND length({_t('text')}) > 20 AND NOT regexp_full_match({_t('text')}, '(?i)[0-9\\s/–—pageof-]*') GROUP BY doc_id"),
    ("DOCX-STRUCT.FOOTNOTES", "Info", "2.4.1", f"SELECT doc_id, 'Info' AS severity, count(*) AS n FROM {BODY_NOTE} GROUP BY doc_id HAVING n > 20 UNION ALL SELECT doc_id, 'Warning', count(*) FROM {BODY_NOTE} WHERE length(text) > 300 GROUP BY doc_id"),
]
XLINK = f"(SELECT doc_id, container, lower({_t('text')}) AS t FROM hyperlink WHERE doc_id IN (SELECT doc_id FROM doc WHERE type = 'xlsx'))"
XLSX = [
    *_meta("xlsx", ".", False),
    ("XLSX.NAV.SHEET_NAMES", "Warning", "2.4.6", f"SELECT doc_id, string_agg(name, ', ' ORDER BY encode(name)) AS element, count(*) AS n FROM sheet WHERE lower({_t('name')}) IN {_list(dims.GENERIC_SHEETS)} GROUP BY doc_id"),
    ("XLSX.NAV.SHEET_DUP", "Warning", "2.4.6", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lower({_t('name')}) AS s FROM sheet GROUP BY ALL HAVING count(*) >= 2) GROUP BY doc_id"),
    ("XLSX.NAV.FREEZE_PANES", "Warning", "1.3.1", "SELECT doc_id, count(*) AS n FROM sheet WHERE max_row > 1 AND frozen IS NOT TRUE GROUP BY doc_id"),
    ("XLSX.TABLE.HEADER", "Error", "1.3.1", "SELECT doc_id, sheet || '!' || name AS element FROM xl_table WHERE header_row_count = 0"),
    ("XLSX.TABLE.NAMED", "Warning", "1.3.1", "SELECT doc_id, count(*) AS n FROM sheet WHERE max_row > 1 AND max_col > 0 AND (doc_id, name) NOT IN (SELECT (doc_id, sheet) FROM xl_table) GROUP BY doc_id"),
    ("XLSX.LAYOUT.MERGED", "Warning", "1.3.2", "SELECT doc_id, name AS element, merged_n::BIGINT AS n FROM sheet WHERE merged_n > 0"),
    ("XLSX.LAYOUT.SPACING", "Warning", "1.3.2", "SELECT doc_id, element, n FROM (SELECT s.doc_id, s.name AS element, s.ord, count(*) AS n, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.ord) AS k FROM sheet s JOIN sheet_row r ON r.doc_id = s.doc_id AND r.sheet = s.name WHERE r.empty_first19 AND r.row_no + 1 < s.max_row GROUP BY s.doc_id, s.name, s.ord HAVING count(*) >= 3) WHERE k = 1"),
    ("XLSX.LINKS.TEXT", "Warning", "2.4.4", f"SELECT doc_id, container AS element, count(*) AS n FROM {XLINK} WHERE t = '' OR t LIKE 'http://%' OR t LIKE 'https://%' OR t IN {_list(dims.VAGUE_LINKS['xlsx'])} GROUP BY ALL"),
    ("XLSX.COLOR.ONLY", "Info", "1.4.1", "SELECT doc_id, count(*) AS n FROM sheet WHERE colour_fill GROUP BY doc_id"),
    ("XLSX.CHART.ALT", "Error", "1.1.1", f"SELECT doc_id, CASE n WHEN 0 THEN 'Info' ELSE 'Error' END AS severity, n FROM (SELECT doc_id, count(*) FILTER ({_no('descr')}) AS n FROM xl_drawing WHERE kind = 'chart' GROUP BY doc_id)"),
    ("XLSX.IMG.ALT", "Error", "1.1.1", f"SELECT doc_id, count(*) AS n FROM xl_drawing WHERE kind = 'pic' AND {_no('descr')} GROUP BY doc_id"),
    ("XLSX.LAYOUT.HIDDEN", "Warning", "1.3.1", "SELECT doc_id, 'sheets' AS element, count(*) AS n FROM sheet WHERE state <> 'visible' GROUP BY doc_id UNION ALL SELECT doc_id, 'rows', sum(hidden_rows)::BIGINT AS n FROM sheet WHERE state = 'visible' GROUP BY doc_id HAVING n > 0 UNION ALL SELECT doc_id, 'columns', sum(hidden_cols)::BIGINT AS n FROM sheet WHERE state = 'visible' GROUP BY doc_id HAVING n > 0"),
    ("XLSX.PROTECT.SHEET", "Info", "2.1.1", "SELECT doc_id, count(*) AS n FROM sheet WHERE protected GROUP BY doc_id"),
    ("XLSX.DATA.VALIDATION", "Warning", "3.3.2", f"SELECT doc_id, count(*) AS n FROM validation WHERE {_t('prompt_title')} || {_t('prompt')} = '' GROUP BY doc_id"),
]
PICTURE = "(SELECT doc_id, slide_no, lower(" + _t("descr") + ") AS d FROM shape WHERE shape_type IN (3, 13, 16) AND decorative IS NOT TRUE)"
COLUMNS = f"(SELECT s.doc_id, s.slide_no, 2 * s.left_emu + s.width_emu < d.slide_width_emu AS is_left FROM shape s JOIN doc d ON d.doc_id = s.doc_id WHERE NOT s.is_title AND NOT {_no('s.text')} AND 4 * s.top_emu >= d.slide_height_emu)"
PPTX = [
    *_meta("pptx", "."),
    ("PPTX.SLIDE.TITLE", "Error", "2.4.6", f"SELECT doc_id, array_to_string(list_sort(list(slide_no))[1:10], ', ') AS element, count(*) AS n FROM slide WHERE has_title_shape IS NOT TRUE OR {_no('title')} GROUP BY doc_id"),
    ("PPTX.SLIDE.TITLE_DUP", "Warning", "2.4.6", f"SELECT doc_id, array_to_string(list_sort(list(t))[1:5], ', ') AS element, count(*) AS n FROM (SELECT doc_id, lower({_t('title')}) AS t FROM slide GROUP BY ALL HAVING count(*) >= 2) WHERE t <> '' GROUP BY doc_id"),
    ("PPTX.SLIDE.NOTES", "Warning", "1.1.1", f"SELECT doc_id, count(*) AS n FROM slide WHERE {_no('notes')} AND (doc_id, slide_no) IN (SELECT (doc_id, slide_no) FROM shape WHERE shape_type IN (3, 6, 13, 16)) GROUP BY doc_id"),
    ("PPTX.ORDER.TITLE_FIRST", "Warning", "1.3.2", f"SELECT s.doc_id, s.slide_no AS page, count(*) AS n FROM shape s JOIN (SELECT doc_id, slide_no, min(ord) AS o FROM shape WHERE is_title GROUP BY ALL) t ON t.doc_id = s.doc_id AND t.slide_no = s.slide_no WHERE s.ord < t.o AND NOT {_no('s.text')} GROUP BY ALL"),
    ("PPTX.ORDER.COLUMNS", "Info", "1.3.2", f"SELECT doc_id, slide_no AS page FROM {COLUMNS} GROUP BY ALL HAVING count(DISTINCT is_left) = 2"),
    ("PPTX.ORDER.VERIFY", "Info", "1.3.2", "SELECT doc_id FROM doc WHERE type = 'pptx' AND access_ok"),
    ("PPTX.IMG.ALT", "Error", "1.1.1", f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT slide_no))[1:8], ', ') AS element, count(*) AS n FROM {PICTURE} WHERE d = '' GROUP BY doc_id"),
    ("PPTX.IMG.ALT_QUALITY", "Warning", "1.1.1", f"SELECT doc_id, count(*) AS n FROM {PICTURE} WHERE length(d) BETWEEN 1 AND 4 OR d IN {_list(dims.GENERIC_ALT_PPTX)} GROUP BY doc_id"),
    ("PPTX.TABLE.HEADER", "Warning", "1.3.1", "SELECT doc_id, count(*) AS n FROM shape WHERE has_table AND first_row IS NOT TRUE GROUP BY doc_id"),
    ("PPTX.MEDIA.CAPTIONS", "Warning", "1.2.2", f"SELECT doc_id, count(*) AS n FROM slide WHERE {_no('notes')} AND (doc_id, slide_no) IN (SELECT (doc_id, slide_no) FROM shape WHERE shape_type IN (6, 16)) GROUP BY doc_id"),
    ("PPTX.SECTION.NAME", "Warning", "2.4.6", f"SELECT doc_id, count(*) AS n FROM deck_section WHERE lower({_t('name')}) IN {_list(dims.GENERIC_SECTIONS)} GROUP BY doc_id"),
    ("PPTX.SECTION.DUP", "Warning", "2.4.6", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lower({_t('name')}) AS s FROM deck_section GROUP BY ALL HAVING count(*) >= 2) GROUP BY doc_id"),
    ("PPTX.LINKS.TEXT", "Warning", "2.4.4", f"SELECT doc_id, count(*) AS n FROM run_link WHERE {_no('text')} OR regexp_replace(lower({_t('text')}), '[.]$', '') IN {_list(dims.VAGUE_LINKS['pptx'])} GROUP BY doc_id"),
    ("PPTX.GROUP.ALT", "Error", "1.1.1", f"SELECT doc_id, count(*) AS n FROM shape WHERE shape_type = 6 AND decorative IS NOT TRUE AND {_no('descr')} GROUP BY doc_id"),
    ("PPTX.TRANSITION.AUTO", "Warning", "2.2.1", "SELECT doc_id, slide_no AS page, CASE adv_tm WHEN '2500' THEN '2.5' WHEN '1250' THEN '1.2' WHEN '60049' THEN '60.0' END AS element FROM slide WHERE regexp_full_match(adv_tm, '[0-9]+')"),
    ("PPTX.ANIM.EXCESSIVE", "Info", "2.3.3", "SELECT doc_id, count(*) AS n FROM slide WHERE animated GROUP BY doc_id HAVING n > 5"),
]
OLD = "coalesce(version, '') LIKE '2%'"
ELEMENT_IN = "t.doc_id = s.doc_id AND t.content_doc = s.content_doc AND t.ord BETWEEN s.ord + 1 AND s.post"
EPUB = [
    ("EPUB-E001", "Error", "2.4.2", f"SELECT doc_id FROM epub_pkg WHERE {_no('title')}"),
    # the named identifier, or else the first one, must have a text
    ("EPUB-E002", "Error", None, f"SELECT doc_id FROM epub_pkg WHERE id1 IS DISTINCT FROM coalesce(unique_identifier, chr(1)) AND id2 IS DISTINCT FROM coalesce(unique_identifier, chr(1)) AND {_no('CASE WHEN id1 IS NOT NULL THEN text1 WHEN id2 IS NOT NULL THEN text2 END')}"),
    ("EPUB-E003", "Error", "3.1.1", f"SELECT doc_id FROM epub_pkg WHERE {_no('language')}"),
    ("EPUB-E007", "Error", None, f"SELECT doc_id, concat_ws(', ', CASE WHEN NOT has_mode THEN 'schema:accessMode' END, CASE WHEN NOT has_feature THEN 'schema:accessibilityFeature' END, CASE WHEN NOT has_hazard THEN 'schema:accessibilityHazard' END) AS element FROM epub_pkg WHERE NOT {OLD} AND NOT (has_mode AND has_feature AND has_hazard)"),
    ("EPUB-T001", "Info", None, "SELECT doc_id FROM epub_pkg WHERE len(regexp_extract_all(summary, '[^ ]+')) < 50"),
    ("EPUB-T002", "Info", None, f"SELECT doc_id FROM epub_pkg WHERE {_no('creator')}"),
    ("EPUB-T003", "Info", None, f"SELECT doc_id FROM epub_pkg WHERE {_no('description')}"),
    ("EPUB-E004", "Error", "2.4.5", f"SELECT doc_id FROM epub_pkg WHERE CASE WHEN {OLD} THEN coalesce(ncx_points, 0) = 0 ELSE nav_present IS NOT TRUE OR NOT has_toc END"),
    ("EPUB-W001", "Warning", None, f"SELECT doc_id FROM epub_pkg WHERE NOT {OLD} AND nav_present AND NOT has_pages"),
    ("EPUB-W002", "Warning", "2.4.1", f"SELECT doc_id FROM epub_pkg WHERE NOT {OLD} AND nav_present AND NOT has_landmarks"),
    ("EPUB-E006", "Error", "1.3.2", "SELECT doc_id, 'absent' AS element FROM epub_pkg WHERE spine_present IS NOT TRUE OR manifest_present IS NOT TRUE UNION ALL SELECT doc_id, 'empty' FROM epub_pkg WHERE spine_present AND manifest_present AND doc_id NOT IN (SELECT doc_id FROM epub_spine) UNION ALL SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM epub_spine e WHERE e.doc_id = s.doc_id AND e.idref = s.idref AND e.ord < s.ord) THEN 'repeated' ELSE 'dangling' END FROM epub_spine s WHERE EXISTS (SELECT 1 FROM epub_spine e WHERE e.doc_id = s.doc_id AND e.idref = s.idref AND e.ord < s.ord) OR NOT EXISTS (SELECT 1 FROM epub_item i WHERE i.doc_id = s.doc_id AND i.item_id = s.idref)"),
    ("EPUB-E005", "Error", "1.1.1", f"SELECT doc_id, content_doc AS element FROM html_el WHERE el = 'img' AND (alt IS NULL OR {_no('alt')} AND role IS DISTINCT FROM 'presentation') UNION ALL SELECT doc_id, content_doc FROM html_el s WHERE el = 'svg' AND NOT EXISTS (SELECT 1 FROM html_el t WHERE t.el = 'title' AND {ELEMENT_IN}) UNION ALL SELECT doc_id, content_doc FROM html_el WHERE el = 'math' AND {_no('alttext')}"),
    ("EPUB-W003", "Warning", "2.4.6", "SELECT doc_id, content_doc AS element FROM (SELECT *, lag(v) OVER (PARTITION BY doc_id, content_doc ORDER BY ord) AS p FROM (SELECT *, CAST(el[2] AS INT) AS v FROM html_el WHERE regexp_full_match(el, 'h[1-6]'))) WHERE v - p > 1"),
    ("EPUB-W004", "Warning", "1.3.1", f"SELECT doc_id, content_doc AS element FROM html_el s WHERE el = 'table' AND NOT EXISTS (SELECT 1 FROM html_el t WHERE t.el = 'th' AND {ELEMENT_IN})"),
    ("EPUB-W005", "Warning", "2.4.4", f"SELECT doc_id, content_doc AS element FROM html_el WHERE el = 'a' AND lower({_t('inner_text')}) IN {_list(dims.VAGUE_LINKS['epub'])}"),
    ("EPUB-W006", "Warning", "1.4.1", "SELECT doc_id FROM epub_pkg WHERE fixed_layout"),
]
# Markdown lines with their state, and what they hold outside fences
MD = r"""ml AS (SELECT doc_id, line_no, raw, trim(raw) AS s, trim(raw) LIKE '```%' AS fence FROM md_line),
mf AS (SELECT *, count(*) FILTER (fence) OVER b % 2 = 1 AS shut, last_value(nullif(s, '') IGNORE NULLS) OVER b AS above FROM ml WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mo AS (SELECT * FROM mf WHERE NOT fence AND NOT shut),
mk AS (SELECT doc_id, line_no, lower(trim(regexp_extract(x, '\[([^\]]*)\]', 1))) AS low, trim(regexp_extract(x, '\[([^\]]*)\]', 1)) AS t, trim(regexp_extract(x, '\(([^)]+)\)$', 1)) AS u FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(raw, '\[[^\]]*\]\([^)]+\)')) AS x FROM mo)),
mi AS (SELECT doc_id, line_no, trim(regexp_extract(x, '\[([^\]]*)\]', 1)) AS alt FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(raw, '!\[[^\]]*\]\([^)]+\)')) AS x FROM mo)),
mh AS (SELECT doc_id, line_no, length(regexp_extract(raw, '^(#{1,6})\s+.', 1)) AS level FROM mo WHERE regexp_matches(raw, '^#{1,6}\s+.')),
mt AS (SELECT * FROM (SELECT *, s LIKE '|%' AS bar, lag(s LIKE '|%', 1, false) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM mo) WHERE bar AND NOT was),
me AS (SELECT doc_id, line_no, regexp_matches(raw, '^#{1,6}\s') AS head, unnest(regexp_extract_all(raw, '[\x{1F600}-\x{1F64F}\x{2600}-\x{26FF}]+')) AS run FROM mo)"""
BARE = "(above IS NULL OR above LIKE '#%')"
_weak = f"(low IN {_list(dims.VAGUE_LINKS['md'])} OR " + " OR ".join(f"starts_with(low, '{x}')" for x in dims.VAGUE_STARTS) + ")"
_hides = "(" + " OR ".join(f"lower(u) LIKE '%{x}' AND low NOT LIKE '%{x[1:]}%'" for x in dims.DOWNLOADS) + ")"
MARKDOWN = [
    ("MD-A11Y.LINK.AMBIGUOUS", "Error", "2.4.4", f"SELECT doc_id, line_no AS line, t AS element FROM mk WHERE {_weak}"),
    ("MD-A11Y.LINK.BARE_URL", "Warning", "2.4.4", f"SELECT doc_id, line_no AS line, t AS element FROM mk WHERE NOT {_weak} AND regexp_matches(low, '^(https?://|www[.])')"),
    ("MD-A11Y.LINK.FILETYPE", "Warning", "2.4.4", f"SELECT doc_id, line_no AS line, u AS element FROM mk WHERE {_hides}"),
    ("MD-A11Y.IMG.ALT_MISSING", "Error", "1.1.1", "SELECT doc_id, line_no AS line FROM mi WHERE alt = ''"),
    ("MD-A11Y.IMG.ALT_QUALITY", "Warning", "1.1.1", f"SELECT doc_id, line_no AS line, alt AS element FROM mi WHERE lower(alt) IN {_list(dims.GENERIC_ALT)} OR regexp_full_match(alt, '[\\w-]+[.]\\w{{2,4}}')"),
    ("MD-A11Y.HEADING.MULTIPLE_H1", "Warning", "1.3.1", "SELECT doc_id, line_no AS line FROM mh WHERE level = 1 AND line_no > (SELECT min(line_no) FROM mh b WHERE b.doc_id = mh.doc_id AND b.level = 1)"),
    ("MD-A11Y.HEADING.NO_H1", "Warning", "1.3.1", "SELECT doc_id, min(line_no) AS line FROM mh GROUP BY doc_id HAVING min(level) > 1"),
    ("MD-A11Y.HEADING.SKIP", "Error", "1.3.1", "SELECT doc_id, line_no AS line FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM mh) WHERE level - p > 1"),
    ("MD-A11Y.TABLE.NO_DESC", "Warning", "1.3.1", f"SELECT doc_id, line_no AS line FROM mt WHERE {BARE}"),
    ("MD-A11Y.TABLE.EMPTY_HEADER", "Warning", "1.3.1", "SELECT doc_id, line_no AS line, '' || i AS element FROM (SELECT doc_id, line_no, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x FROM (SELECT doc_id, line_no, string_split(trim(s, '|'), '|') AS c FROM mt)) WHERE trim(x) = ''"),
    ("MD-A11Y.EMOJI.HEADING", "Warning", "1.3.3", "SELECT doc_id, line_no AS line, run AS element FROM me WHERE head"),
    ("MD-A11Y.EMOJI.CONSECUTIVE", "Info", "1.3.3", "SELECT doc_id, line_no AS line, run AS element FROM me WHERE length(run) > 1"),
    ("MD-A11Y.DIAGRAM.MERMAID", "Error", "1.1.1", f"SELECT doc_id, line_no AS line FROM mf WHERE fence AND NOT shut AND lower(trim(s[4:])) = 'mermaid' AND ({BARE} OR above LIKE '```%')"),
    ("MD-A11Y.DIAGRAM.ASCII", "Warning", "1.1.1", f"SELECT doc_id, line_no AS line FROM mo WHERE length(s) > 10 AND regexp_full_match(s, '[\\s+|><^v*=-]{{10,}}') AND {BARE}"),
]
SCAN = [("SCAN.FILE.INACCESSIBLE", "Error", None, "SELECT doc_id, skip_reason AS element, type FROM doc WHERE NOT access_ok")]

SCANNERS: dict[str, list[tuple]] = {"core": CORE, "metadata": METADATA, "tags": TAGS, "forms": FORMS, "docx": DOCX, "xlsx": XLSX, "pptx": PPTX, "epub": EPUB, "markdown": MARKDOWN, "scan": SCAN}
TYPE = {"core": "pdf", "metadata": "pdf", "tags": "pdf", "forms": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "epub": "epub", "markdown": "md"}
_TOOLS = {r[0]: r[2] for r in (x.split("|") for x in dims.TIERS.strip().split("\n")) if r[2] != "-"}
_POINTS = {r[0]: r[4] for r in (x.split("|") for x in dims.RULES.strip().split("\n")) if r[4] != "--"}
_EMPTY = "SELECT NULL::VARCHAR AS family, NULL::VARCHAR AS scanner, NULL::BIGINT AS doc, NULL::VARCHAR AS type, NULL::VARCHAR AS rule, NULL::VARCHAR AS severity, NULL::VARCHAR AS confidence, NULL::VARCHAR AS wcag, NULL::VARCHAR AS checkpoint, NULL::INT AS page, NULL::INT AS line, NULL::VARCHAR AS element, NULL::BIGINT AS n, NULL::VARCHAR AS message, NULL::VARCHAR AS fix, NULL::BIGINT AS ord WHERE false"


def _row(scanner: str, number: int, rule: str, severity: str, wcag: str | None, sql: str) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    label = re.sub(r"[._-]+", " ", re.split(r"[.-]", rule, maxsplit=1)[1]).lower()
    shape = "SELECT NULL::BIGINT AS doc_id, NULL::VARCHAR AS severity, NULL::VARCHAR AS type, NULL::INT AS page, NULL::INT AS line, NULL::VARCHAR AS element, NULL::BIGINT AS n WHERE false"
    return (
        f"SELECT {text('core' if scanner == 'core' else 'tools')} AS family, {text(scanner)} AS scanner, doc_id AS doc, coalesce(type, {text(TYPE.get(scanner))}) AS type, {text(rule)} AS rule, coalesce(severity, {text(severity)}) AS severity, 'High' AS confidence, {text(wcag)} AS wcag, {text(_POINTS.get(rule))} AS checkpoint, "
        f"CAST(page AS INT) AS page, CAST(line AS INT) AS line, element, CAST(n AS BIGINT) AS n, concat_ws(': ', '{label}', element) AS message, {text(_TOOLS.get(rule))} AS fix, CAST({number} AS BIGINT) * 1048576 + coalesce(page, line, 0) AS ord "
        f"FROM ({shape} UNION ALL BY NAME SELECT * FROM ({sql}))"
    )


#: Facts after the planned repairs, from the facts before them; what each column would say, straight from the repair's description.
_TODO_TITLE = "'TODO: Add descriptive document title'"
_OFFICE = "access_ok AND type IN ('docx', 'xlsx', 'pptx')"
_PDF_OK = "type = 'pdf' AND access_ok"
_READ = "doc_id IN (SELECT doc_id FROM doc_was WHERE type = 'pdf' AND access_ok)"
_LISTED = "(SELECT s.doc_id FROM epub_spine_was s JOIN epub_item i ON i.doc_id = s.doc_id AND i.item_id = s.idref WHERE i.href <> '')"
REPAIRED: dict[str, str] = {
    "doc": f"""SELECT * REPLACE (CASE WHEN {_no('title')} AND ({_PDF_OK} OR {_OFFICE}) THEN {_TODO_TITLE} ELSE title END AS title, CASE WHEN {_no('author')} AND {_OFFICE} THEN 'TODO: Add author name' ELSE author END AS author,
      CASE WHEN {_no('lang')} AND access_ok AND type IN ('pdf', 'docx') THEN 'en-US' ELSE lang END AS lang, CASE WHEN {_PDF_OK} AND display_doc_title IS NOT TRUE THEN true ELSE viewer_prefs_present END AS viewer_prefs_present,
      CASE WHEN {_PDF_OK} THEN true ELSE display_doc_title END AS display_doc_title, CASE WHEN {_PDF_OK} AND tagged IS NOT TRUE THEN true ELSE mark_info_present END AS mark_info_present, CASE WHEN {_PDF_OK} THEN true ELSE tagged END AS tagged,
      CASE WHEN {_PDF_OK} AND coalesce(xmp, '') NOT ILIKE '%pdfuaid%' THEN '<pdfuaid:part>1' ELSE xmp END AS xmp) FROM doc_was""",
    "pdf_page": f"SELECT * REPLACE (CASE WHEN tabs IS NULL AND {_READ} THEN 'S' ELSE tabs END AS tabs) FROM pdf_page_was",
    "form_field": f"SELECT * REPLACE (CASE WHEN {_no('tooltip')} AND {_READ} THEN CASE WHEN coalesce(name, '') = '' THEN 'TODO: Add tooltip' ELSE replace(replace({_t('name')}, '_', ' '), '.', ' ') END ELSE tooltip END AS tooltip) FROM form_field_was",
    "doc_table": "SELECT * REPLACE (true AS has_header) FROM doc_table_was",
    "slide": f"""SELECT * EXCLUDE (k) REPLACE (CASE WHEN {_no('title')} THEN CASE WHEN has_title_shape THEN 'TODO: Title for Slide ' || slide_no ELSE title END WHEN k > 1 AND {_t('title')} NOT LIKE 'TODO:%' THEN {_t('title')} || ' (' || k || ')' ELSE title END AS title)
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {_t('title')} ORDER BY slide_no) AS k FROM slide_was)""",
    "epub_pkg": f"""SELECT * REPLACE (CASE WHEN {_no('title')} THEN {_TODO_TITLE} ELSE title END AS title, CASE WHEN {_no('language')} THEN 'en' ELSE language END AS language, CASE WHEN {_no('creator')} THEN 'TODO: Add author name' ELSE creator END AS creator,
      has_mode OR coalesce(version, '') NOT LIKE '2%' AS has_mode, has_feature OR coalesce(version, '') NOT LIKE '2%' AS has_feature, CASE WHEN summary IS NULL AND coalesce(version, '') NOT LIKE '2%' THEN 'TODO: Describe accessibility features and conformance level' ELSE summary END AS summary,
      CASE WHEN coalesce(version, '') NOT LIKE '2%' AND (nav_present IS NOT TRUE OR NOT has_toc) AND doc_id IN {_LISTED} THEN true ELSE nav_present END AS nav_present, has_toc OR coalesce(version, '') NOT LIKE '2%' AND doc_id IN {_LISTED} AS has_toc) FROM epub_pkg_was""",
    "epub_spine": "SELECT doc_id, min(ord) AS ord, idref FROM epub_spine_was WHERE (doc_id, idref) IN (SELECT (doc_id, item_id) FROM epub_item) GROUP BY doc_id, idref",
    "html_el": """SELECT * EXCLUDE (r) REPLACE (coalesce('h' || r, el) AS el, CASE WHEN el = 'img' AND alt IS NULL THEN 'TODO: Describe ' || coalesce(src, 'image') ELSE alt END AS alt) FROM (SELECT h.*, r FROM html_el_was h LEFT JOIN (SELECT doc_id, content_doc, ord, k + min(level - k) OVER (PARTITION BY doc_id, content_doc ORDER BY k) AS r
      FROM (SELECT doc_id, content_doc, ord, CAST(el[2] AS INT) AS level, row_number() OVER (PARTITION BY doc_id, content_doc ORDER BY ord) AS k FROM html_el_was WHERE regexp_full_match(el, 'h[1-6]'))) USING (doc_id, content_doc, ord))""",
}


def _findings(scanners, repaired: bool = False) -> str:
    """The WITH clause that ends in a table ``found`` of the scanners' findings, before or after the planned repairs."""
    numbers = {}
    for s, rules in SCANNERS.items():
        for r in rules:
            numbers[s, r[0]] = len(numbers)
    rows = [_row(s, numbers[s, r[0]], *r) for s in scanners for r in SCANNERS[s]]
    body = " UNION ALL ".join([_EMPTY, *rows])
    made = [f"{name} AS ({sql.replace('{orders}', 'orders').replace('{customer}', 'customer').replace('{lineitem}', 'lineitem')})" for name, sql in FACTS.items() if re.search(rf"\b{name}\b", body) or name == "md_line" and "markdown" in scanners or name.startswith("mcid") and "tags" in scanners]
    if repaired:
        made = [f"{m.replace(n + ' AS', n + '_was AS', 1)}, {n} AS ({REPAIRED[n]})" if (n := m.split(" ", 1)[0]) in REPAIRED else m for m in made]
    if "tags" in scanners:
        made.append("both_sides AS (SELECT p.doc_id, p.page, p.pos, max(t.pos) AS t FROM mcid_paint p JOIN mcid_tree t ON t.doc_id = p.doc_id AND t.page = p.page AND t.mcid = p.mcid GROUP BY ALL)")
    if "markdown" in scanners:
        made.append(MD)
    return f"WITH {', '.join(made)}, found AS ({body})"


ALL = _findings(tuple(SCANNERS))
_BAD, _WARN = "lower(severity) = 'error'", "lower(severity) = 'warning'"


def oracle_sql() -> dict[str, str]:
    out = {f"findings_{s}": f"{_findings((s,))} SELECT * FROM found" for s in SCANNERS}
    out["findings_scores"] = f"""{ALL}, c AS (SELECT family, doc, count(*) FILTER ({_BAD}) AS errors, count(*) FILTER ({_WARN}) AS warnings, count(*) FILTER (lower(severity) IN ('info', 'tip')) AS infos FROM found GROUP BY family, doc),
      d AS (SELECT 'core' AS family, doc_id AS doc, access_ok FROM doc WHERE type = 'pdf' UNION ALL SELECT 'tools', doc_id, access_ok FROM doc),
      n AS (SELECT d.family, d.doc, access_ok, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos FROM d LEFT JOIN c ON c.family = d.family AND c.doc = d.doc),
      s AS (SELECT * EXCLUDE (access_ok), CAST(CASE WHEN NOT access_ok THEN 0 WHEN family = 'core' THEN greatest(0, floor(100 - (5 * errors + 2 * warnings + 0.5 * infos))) ELSE 100 - least(10 * errors, 50) - least(3 * warnings, 21) END AS INT) AS score FROM n)
      SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= CASE family WHEN 'core' THEN 50 ELSE 60 END THEN 'D' ELSE 'F' END AS grade FROM s"""
    out["findings_deduplicated"] = f"{ALL} SELECT doc, rule, message, min(ord) AS ord FROM found GROUP BY ALL"
    out["findings_summary"] = f"""{ALL} SELECT rule, CAST(min(CASE lower(severity) WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS INT) AS level, count(DISTINCT doc) AS files, count(*) AS findings FROM found GROUP BY rule"""
    out["findings_by_page"] = f"{ALL} SELECT doc, page, count(*) FILTER ({_BAD}) AS errors, count(*) FILTER ({_WARN}) AS warnings, count(*) AS n FROM found WHERE page IS NOT NULL GROUP BY doc, page"
    files = """WITH f AS (SELECT doc_id AS k, 'in/' || coalesce(source, 'none') || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS path, 'in/' || coalesce(source, 'none') AS folder, CASE WHEN doc_id % 3 = 0 THEN 'md' ELSE 'txt' END AS type, text FROM documents)"""
    out["inventory_file"] = "SELECT doc_id, nullif(source, '') AS source, nullif(lang, '') AS lang, length(text) AS characters FROM documents"
    out["inventory_delta"] = f"""{files}, x AS (SELECT folder, type, k, k % 17 <> 3 AS was, k % 19 <> 5 AS lives, k % 7 = 0 AS other FROM f)
      SELECT folder, type, count(*) FILTER (NOT was AND lives) AS new, count(*) FILTER (was AND lives AND other) AS changed, count(*) FILTER (was AND lives AND NOT other) AS unchanged, count(*) FILTER (was AND NOT lives) AS deleted, count(*) FILTER (was AND lives AND k % 7 = 1) AS touched
      FROM x WHERE was OR lives GROUP BY folder, type"""
    out["incremental_findings"] = f"""{files}, n AS (SELECT path, CASE WHEN k % 7 = 0 THEN coalesce(text, '') || chr(10) || 'Same line' || chr(10) || 'Same line' ELSE text END AS text FROM f WHERE k % 19 <> 5),
      l AS (SELECT path, unnest(string_split(text, chr(10))) AS element FROM n)
      SELECT path, 'LINE.REPEATED' AS rule, element, count(*) AS n FROM l WHERE element <> '' GROUP BY path, element HAVING count(*) > 1 UNION ALL SELECT path, 'TEXT.MISSING', NULL, 1 FROM n WHERE coalesce(text, '') = ''"""
    out |= _audits() | _fix_loop() | _history() | _folders()
    return out


def _folders() -> dict[str, str]:
    up = f"""p AS (SELECT doc_id AS doc, 'in' AS a, 'in/dept' || doc_id % 4 AS b, CASE WHEN doc_id % 3 > 0 THEN 'in/dept' || doc_id % 4 || '/y' || doc_id % 5 END AS c FROM doc),
      u AS (SELECT doc, '' AS folder FROM p UNION ALL SELECT doc, a FROM p UNION ALL SELECT doc, b FROM p UNION ALL SELECT doc, c FROM p WHERE c IS NOT NULL)"""
    dealt = """WITH n AS (SELECT source, lang, count(*) AS files FROM documents GROUP BY ALL), t AS (SELECT sum(files)::BIGINT AS total, least(20, sum(files))::BIGINT AS size FROM n), f AS (SELECT source, lang, files, size, (size * files) // total AS q, (size * files) % total AS r FROM n, t),
      q AS (SELECT source, lang, files, q + CASE WHEN row_number() OVER (ORDER BY r DESC, source NULLS FIRST, lang NULLS FIRST) <= size - (SELECT sum(q) FROM f) THEN 1 ELSE 0 END AS quota FROM f)"""
    return {
        "folder_patterns": f"""{ALL}, {up}, s AS (SELECT folder, count(*) AS files FROM u GROUP BY folder), h AS (SELECT folder, rule, count(DISTINCT doc) AS hit FROM found JOIN u USING (doc) GROUP BY folder, rule)
          SELECT folder, rule, hit, files, CASE WHEN files > 1 AND hit = files THEN 'systemic' WHEN files > 1 AND hit >= files / 2 THEN 'widespread' WHEN hit > 2 THEN 'repeated' ELSE 'isolated' END AS pattern FROM h JOIN s USING (folder)""",
        "criteria_across_types": f"{ALL}, {up} SELECT folder, wcag, string_agg(DISTINCT type, ', ' ORDER BY type) AS types, count(DISTINCT (doc, type)) AS files FROM found JOIN u USING (doc) WHERE wcag IS NOT NULL GROUP BY folder, wcag HAVING count(DISTINCT type) > 1",
        "apportioned_quotas": f"{dealt} SELECT source, lang, files, CAST(quota AS BIGINT) AS quota FROM q WHERE quota > 0",
        "apportioned_sample": f"{dealt}, d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('' || doc_id), doc_id) AS k FROM documents) SELECT d.doc_id, d.source, d.lang FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source AND q.lang IS NOT DISTINCT FROM d.lang WHERE k <= quota",
    }


_MENDED = ("metadata", "tags", "forms", "docx", "xlsx", "pptx", "epub")


def _fix_loop() -> dict[str, str]:
    both = f"was AS ({_findings(_MENDED)} SELECT * FROM found), now AS ({_findings(_MENDED, True)} SELECT * FROM found)"
    grades = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"
    side = lambda t: f"(SELECT d.doc_id AS doc, access_ok, count(f.doc) FILTER ({_BAD}) AS e, count(f.doc) FILTER ({_WARN}) AS w, CAST(CASE WHEN access_ok THEN 100 - least(50, 10 * count(f.doc) FILTER ({_BAD})) - least(21, 3 * count(f.doc) FILTER ({_WARN})) ELSE 0 END AS INT) AS s FROM doc d LEFT JOIN {t} f ON f.doc = d.doc_id GROUP BY d.doc_id, access_ok)"
    plan = f"plan AS (WITH RECURSIVE {_facts(*_PLANNED)}{_repairs()})"
    return {
        "fix_loop_rules": f"WITH {both}, c AS (SELECT rule, count(*) FILTER (side = 0) AS b, count(*) FILTER (side = 1) AS a FROM (SELECT rule, 0 AS side FROM was UNION ALL SELECT rule, 1 FROM now) GROUP BY rule) SELECT rule, b AS before, a AS after, greatest(b - a, 0) AS resolved, CASE WHEN b > 0 THEN a ELSE 0 END AS remaining, greatest(a - b, 0) AS added FROM c",
        "fix_loop_scores": f"""WITH {_facts('doc')}, {both}, {plan}, p AS (SELECT doc, count(*) FILTER (status = 'fixed') AS fixed, count(*) FILTER (status <> 'fixed') AS human FROM plan GROUP BY doc)
          SELECT b.doc, b.s AS score_before, {grades.format('b.s')} AS grade_before, b.e AS errors_before, b.w AS warnings_before, a.s AS score_after, {grades.format('a.s')} AS grade_after, a.e AS errors_after, a.w AS warnings_after, coalesce(fixed, 0) AS fixed, coalesce(human, 0) AS needs_human, a.s - b.s AS delta
          FROM {side('was')} b JOIN {side('now')} a ON a.doc = b.doc LEFT JOIN p ON p.doc = b.doc""",
    }


def _history() -> dict[str, str]:
    # a row per finding, time and whether it was there, over the times that looked at its document
    looked = lambda last: f"""{_findings(_MENDED)}, g AS (SELECT doc, rule, count(*) AS n FROM found JOIN doc ON doc_id = doc GROUP BY doc, rule), x AS (SELECT *, (doc + length(rule)) * (t + 1) + doc % 7 AS h FROM g, (SELECT unnest(range(1, {last} + 1)) AS t)),
      y AS (SELECT doc, rule, n, t, h % 3 <> t % 3 AS there, row_number() OVER (PARTITION BY doc, rule ORDER BY t DESC) AS place FROM x WHERE (doc * 3 + t * t) % 5 <> 0),
      z AS (SELECT doc, rule, n, coalesce(bool_or(there) FILTER (place = 1), false) AS a, coalesce(bool_or(there) FILTER (place = 2), false) AS b, coalesce(bool_or(there) FILTER (place > 2), false) AS c, min(t) FILTER (there) AS f, max(t) FILTER (there) AS l, count(*) FILTER (there) AS k FROM y GROUP BY doc, rule, n)"""  # noqa: E731
    status = "CASE WHEN NOT a THEN 'Fixed' WHEN b THEN 'Persistent' WHEN c THEN 'Regressed' ELSE 'New' END AS status"
    return {
        "history_statuses": f"{looked(5)} SELECT doc, rule, {status}, CAST(f AS INT) AS first_seen, CAST(l AS INT) AS last_seen, k AS scans FROM z WHERE a OR b",
        "history_as_of": f"{looked(3)} SELECT doc, rule, n, CAST(l AS INT) AS taken, {status} FROM z WHERE a",
    }


def _facts(*names: str) -> str:
    return ", ".join(f"{n} AS ({FACTS[n].replace('{orders}', 'orders').replace('{customer}', 'customer').replace('{lineitem}', 'lineitem')})" for n in names)


_RANK = "CASE lower(severity) WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'tip' THEN 2 ELSE 9 END"
_TOTAL = "(SELECT count(*) FROM doc)"
_FILES = "(SELECT doc_id AS doc, 'in/' || doc_id || '.' || type AS path, type, doc_id * 700 AS size_bytes, title, lang FROM doc)"
# Names of the success criteria as their pages spell them, and those not of level A.
_PAGES = {c: re.sub(r"[^a-z -]", "", name.lower()).replace(" ", "-") for c, name in (x.split("|") for x in dims.CRITERIA.strip().split("\n"))}
_URL = "CASE wcag " + " ".join(f"WHEN '{c}' THEN 'https://www.w3.org/WAI/WCAG22/Understanding/{p}'" for c, p in _PAGES.items()) + " ELSE '' END"
_LEVEL = "CASE WHEN wcag IS NULL OR wcag = '' THEN '' WHEN wcag IN ('1.4.3', '2.4.5', '2.4.6') THEN 'AA' WHEN wcag = '2.3.3' THEN 'AAA' ELSE 'A' END"
_SPREAD = f"s AS (SELECT rule, CASE WHEN count(DISTINCT doc) = {_TOTAL} THEN 'Systemic' WHEN count(DISTINCT doc) > 2 THEN 'Template' ELSE 'File-specific' END AS pattern_type FROM found GROUP BY rule)"
_MDROWS = "m AS (SELECT found.*, CASE lower(severity) WHEN 'error' THEN 'Serious' WHEN 'warning' THEN 'Moderate' ELSE 'Minor' END AS scale, CASE WHEN count(DISTINCT doc) OVER (PARTITION BY rule) > 2 THEN 'Systemic' ELSE 'File-specific' END AS spread, count(DISTINCT doc) OVER (PARTITION BY rule) AS files, upper(string_split(rule, '.')[2][1]) || lower(string_split(rule, '.')[2][2:]) AS area FROM found)"
_FIXES = {
    "tagging": ("PDFUA.STRUCT.TAGGED", "PDFUA.STRUCT.NOTREE"), "title": ("PDFUA.METADATA.TITLE", "DOCX-META.TITLE", "PPTX.META.TITLE", "XLSX.META.TITLE", "EPUB-E001"), "language": ("PDFUA.METADATA.LANG", "DOCX-META.LANG", "PPTX.META.LANG", "EPUB-E003"),
    "form structure": ("PDFUA.FORM.STRUCT", "PDFBP.FORM.STRUCT"), "tooltips": ("PDFUA.FORM.TU",), "slide titles": ("PPTX.SLIDE.TITLE",), "alternative text": ("DOCX-IMG.ALT", "PPTX.IMG.ALT", "XLSX.IMG.ALT", "PDFUA.IMG.ALT"),
    "table headers": ("PDFUA.TABLE.HEADERS", "DOCX-TABLE.HEADERS", "XLSX.TABLE.HEADER", "PPTX.TABLE.HEADER"), "display title and tab order": ("PDFBP.DISPLAY.DOCTITLE", "PDFBP.NAV.TABORDER"),
}


_PLANNED = ('doc', 'pdf_page', 'form_field', 'struct_node', 'doc_table', 'drawing', 'sheet', 'xl_drawing', 'slide', 'shape', 'epub_pkg', 'epub_spine', 'epub_item', 'html_el')


def _repairs() -> str:
    """Planned repairs, one SELECT each."""
    todo, author = "'TODO: Add descriptive document title'", "'TODO: Add author name'"
    ok = f"doc_id IN (SELECT doc_id FROM {PDF})"
    rows = [("fix_pdf", "PDFUA.METADATA.TITLE", "'title'", todo, f"{PDF} WHERE {_no('title')}"), ("fix_pdf", "PDFUA.METADATA.DISPLAY_TITLE", "'display title'", "'true'", f"{PDF} WHERE display_doc_title IS NOT TRUE"), ("fix_pdf", "PDFUA.METADATA.LANG", "'language'", "'en-US'", f"{PDF} WHERE {_no('lang')}"), ("fix_pdf", "PDFUA.NAV.TAB_ORDER", "'page ' || page", "'S'", f"pdf_page WHERE tabs IS NULL AND {ok}"), ("fix_pdf", "PDFUA.METADATA.PDFUA_ID", "'identifier'", "'pdfuaid:part=1'", f"{PDF} WHERE xmp IS NULL OR xmp NOT ILIKE '%pdfuaid%'"), ("fix_pdf", "PDFUA.STRUCTURE.MARKED", "'marked'", "'true'", f"{PDF} WHERE tagged IS NOT TRUE"), ("fix_pdf", "PDFUA.FORM.TU", "'field ' || ord", "CASE WHEN name IS NULL THEN 'TODO: Add tooltip' ELSE replace(replace(trim(name), '_', ' '), '.', ' ') END", f"form_field WHERE {_no('tooltip')} AND {ok}")]
    rows += [("fix_pdf", "PDFUA.TABLE.HEADERS", "'tables'", None, f"(SELECT DISTINCT doc_id FROM struct_node WHERE tag = 'Table' AND {ok} AND doc_id NOT IN (SELECT doc_id FROM struct_node WHERE tag = 'TH'))"), ("fix_pdf", "PDFBP.HEADING.SKIP", "'headings'", None, f"(SELECT DISTINCT doc_id FROM (SELECT doc_id, level - lag(level) OVER (PARTITION BY doc_id ORDER BY preorder) AS d FROM {HEADS}) WHERE d > 1 AND {ok})"), ("fix_pdf", "PDFUA.IMG.ALT", "'element ' || node_id", None, f"struct_node WHERE tag = 'Figure' AND {_no('alt')} AND {ok}")]
    for kind, tool, pre in (("docx", "fix_word", "DOCX"), ("xlsx", "fix_excel", "XLSX"), ("pptx", "fix_pptx", "PPTX")):
        for what, new in (("title", todo), ("author", author)):
            rows.append((tool, f"{pre}-META.{what.upper()}", f"'{what}'", new, f"doc WHERE type = '{kind}' AND access_ok AND {_no(what)}"))
    rows += [("fix_word", "DOCX-META.LANG", "'language'", "'en-US'", f"doc WHERE type = 'docx' AND access_ok AND {_no('lang')}"), ("fix_word", "DOCX-TABLE.HEADERS", "'table ' || table_no", "'header row'", "doc_table WHERE NOT has_header"), ("fix_word", "DOCX-IMG.ALT", "'drawing ' || ord", None, f"drawing WHERE {_t('descr')} || {_t('title')} = ''"), ("fix_excel", "XLSX-SHEET.NAME", "'sheet ' || ord", None, "sheet WHERE lower(name) IN ('sheet', 'sheet1')"), ("fix_excel", "XLSX-TABLE.PRINT_TITLES", "'sheet ' || ord", "'1:1'", "sheet WHERE max_row >= 2"), ("fix_excel", "XLSX-IMG.ALT", "'drawing ' || ord", None, f"xl_drawing WHERE kind = 'pic' AND {_no('descr')}")]
    rows += [("fix_pptx", "PPTX-SLIDE.TITLE", "'slide ' || slide_no", "'TODO: Title for Slide ' || slide_no", f"slide WHERE {_no('title')} AND has_title_shape"), ("fix_pptx", "PPTX-SLIDE.TITLE", "'slide ' || slide_no", None, f"slide WHERE {_no('title')} AND has_title_shape IS NOT TRUE"), ("fix_pptx", "PPTX-SLIDE.TITLE_UNIQUE", "'slide ' || slide_no", "t || ' (' || k || ')'", f"(SELECT doc_id, slide_no, {_t('title')} AS t, row_number() OVER (PARTITION BY doc_id, {_t('title')} ORDER BY slide_no) AS k FROM slide) WHERE k >= 2 AND t <> ''"), ("fix_pptx", "PPTX-IMG.ALT", "'slide ' || slide_no || ' shape ' || ord", None, f"shape WHERE shape_type = 13 AND decorative IS NOT TRUE AND {_no('descr')}")]
    rows += [("fix_epub", "EPUB-E001", "'title'", todo, f"epub_pkg WHERE {_no('title')}"), ("fix_epub", "EPUB-E003", "'language'", "'en'", f"epub_pkg WHERE {_no('language')}"), ("fix_epub", "EPUB-T002", "'creator'", author, f"epub_pkg WHERE {_no('creator')}"), ("fix_epub", "EPUB-E007", "'schema:accessMode'", "'textual'", f"epub_pkg WHERE NOT {OLD} AND NOT has_mode"), ("fix_epub", "EPUB-E007", "'schema:accessibilityFeature'", "'structuralNavigation'", f"epub_pkg WHERE NOT {OLD} AND NOT has_feature"), ("fix_epub", "EPUB-E007", "'schema:accessibilitySummary'", "'TODO: Describe accessibility features and conformance level'", f"epub_pkg WHERE NOT {OLD} AND summary IS NULL"), ("fix_epub", "EPUB-E004", "'navigation'", "toc", f"epub_pkg JOIN nav USING (doc_id) WHERE NOT {OLD} AND NOT (nav_present IS TRUE AND has_toc)"), ("fix_epub", "EPUB-E004", "'navigation'", None, f"epub_pkg ANTI JOIN nav USING (doc_id) WHERE NOT {OLD} AND NOT (nav_present IS TRUE AND has_toc)"), ("fix_epub", "EPUB-E005", "content_doc || ' element ' || ord", "'TODO: Describe ' || coalesce(src, 'image')", "html_el WHERE el = 'img' AND alt IS NULL")]
    known = "EXISTS (SELECT 1 FROM epub_item i WHERE i.doc_id = s.doc_id AND i.item_id = s.idref)"
    rows += [("fix_epub", "EPUB-E006", "'spine ' || ord", f"CASE WHEN {known} THEN 'remove duplicate' ELSE 'remove dangling' END", f"epub_spine s WHERE NOT {known} OR EXISTS (SELECT 1 FROM epub_spine e WHERE e.doc_id = s.doc_id AND e.idref = s.idref AND e.ord < s.ord)")]
    out = [f"SELECT doc_id AS doc, '{tool}' AS tool, '{rule}' AS rule, {target} AS target, '{'needs-human' if new is None else 'fixed'}' AS status, {new or 'NULL'} AS new FROM {of}" for tool, rule, target, new, of in rows]
    # the repair of levels as the recursion that it is
    fold = "SELECT doc_id, content_doc, k, level, CASE WHEN k = 1 THEN level END AS r FROM hk WHERE k = 1 UNION ALL SELECT h.doc_id, h.content_doc, h.k, h.level, least(h.level, f.r + 1) FROM hf f JOIN hk h ON h.doc_id = f.doc_id AND h.content_doc = f.content_doc AND h.k = f.k + 1"
    out.append("SELECT doc_id, 'fix_epub', 'EPUB-W003', content_doc || ' heading ' || k, 'fixed', 'h' || r FROM hf WHERE r < level")
    # tables of contents: the heading of least place in each listed part, else its file name in capitals
    safe = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    stem = "regexp_replace(regexp_replace(split_part(href, '/', -1), '([^.])[.][^.]*$', '\\1'), '[-_]', ' ', 'g')"
    nav = f""", first AS (SELECT doc_id, content_doc, coalesce(nullif({_t('inner_text')}, ''), 'Heading ' || el[2]) AS said FROM html_el WHERE regexp_full_match(el, 'h[1-6]') QUALIFY row_number() OVER (PARTITION BY doc_id, content_doc ORDER BY ord) = 1),
      nav AS (SELECT s.doc_id, '<ol>' || string_agg('<li><a href="' || {safe('href')} || '">' || {safe(f"coalesce(said, list_aggregate(list_transform(regexp_extract_all({stem}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ''))")} || '</a></li>', '' ORDER BY s.ord, href) || '</ol>' AS toc
        FROM epub_spine s JOIN epub_item i ON i.doc_id = s.doc_id AND i.item_id = s.idref LEFT JOIN first f ON f.doc_id = s.doc_id AND f.content_doc = i.part WHERE href <> '' GROUP BY s.doc_id)"""
    return f"{nav}, hk AS (SELECT doc_id, content_doc, CAST(el[2] AS INT) AS level, row_number() OVER (PARTITION BY doc_id, content_doc ORDER BY ord) AS k FROM html_el WHERE regexp_full_match(el, 'h[1-6]')), hf AS ({fold}) {' UNION ALL '.join(out)}"


def _audits() -> dict[str, str]:
    fixes = " UNION ALL ".join(f"SELECT {i} AS place, '{title}' AS title, count(DISTINCT doc) AS files FROM found WHERE rule IN {_list(rules)}" for i, (title, rules) in enumerate(_FIXES.items()))
    catalogue = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (r[0], r[1], r[2], r[3])) + ")" for r in (x.split("|") for x in dims.RULES.strip().split("\n")))
    tiers = ", ".join(f"('{r[0]}', {r[1]})" for r in (x.split("|") for x in dims.TIERS.strip().split("\n")))
    grades = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
    some, md = _findings(("core", "xlsx")), _findings(("markdown",))
    with_doc = lambda q: q if " doc AS (" in q or "WITH doc AS (" in q else q.replace("WITH ", f"WITH {_facts('doc')}, ", 1)
    lines = r"""WITH ml AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, ['**Terms**', '**a** and **b**', '| a | b | c | d | e |', 'text', '| a | b |', '- 😀 good news', '* plain item', 'one — two', 'left -- right', '---', 'code `a -- b`', '3. ☀ sun', 'x–y --- z', '```', '**Late**'][o_orderkey % 15 + 1] AS s FROM orders),
      mf AS (SELECT *, s = '```' AS fence, count(*) FILTER (s = '```') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1 AS shut FROM ml), mo AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, s, lag(s LIKE '|%', 1, false) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM mf WHERE NOT fence AND NOT shut)"""
    safe = "replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    level = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
    counted = f"c AS (SELECT doc, count(*) FILTER ({_BAD}) AS e, count(*) FILTER ({_WARN}) AS w, count(*) FILTER (lower(severity) IN ('info', 'tip')) AS i FROM found GROUP BY doc), s AS (SELECT *, CAST(100 - least(10 * e, 50) - least(3 * w, 21) AS INT) AS score FROM c)"
    tools_counted = counted.replace("FROM found", "FROM found WHERE family = 'tools'").replace("CAST(100", "CAST(CASE WHEN doc IN (SELECT doc_id FROM doc WHERE NOT access_ok) THEN 0 ELSE 100").replace("21) AS INT", "21) END AS INT")
    return {
        "md_bold_headings": f"{lines} SELECT doc_id, line_no, trim(s, '*') AS text FROM mo WHERE s IN ('**Terms**', '**Late**')",
        "md_wide_tables": f"{lines} SELECT doc_id, line_no, CAST(5 AS INT) AS columns FROM mo WHERE s = '| a | b | c | d | e |' AND NOT was",
        "md_emoji_bullets": f"{lines} SELECT doc_id, line_no, CASE s WHEN '3. ☀ sun' THEN '- sun' ELSE '- good news' END AS new FROM mo WHERE s IN ('- 😀 good news', '3. ☀ sun')",
        "md_dashes": f"{lines} SELECT doc_id, line_no, CASE s WHEN 'one — two' THEN 'one - two' WHEN 'left -- right' THEN 'left - right' ELSE 'x - y - z' END AS new FROM mo WHERE s IN ('one — two', 'left -- right', 'x–y --- z')",
        "alt_formats": f"""WITH x AS (SELECT p_partkey, p_name || ' <&">' AS c, CASE WHEN p_partkey % 4 > 0 THEN p_type || ' & more' ELSE '' END AS d, ['pdf', 'epub', 'docx'][p_partkey % 3 + 1] AS k, replace(p_name || ' <&">', '"', '\\"') AS j FROM part), y AS (SELECT *, {safe} AS a, '{{"alt":"' || j || '","actual_text":"' || d || '"}}' AS tag, '{{"descr":"' || j || '"}}' AS descr FROM x)
          SELECT p_partkey, '<img src="" alt="' || a || '" />' || chr(10) || chr(10) || '<figure>' || chr(10) || '  <img src="" alt="' || a || '" aria-describedby="img-desc" />' || chr(10) || '  <figcaption id="img-desc">' || replace(d, '&', '&amp;') || '</figcaption>' || chr(10) || '</figure>' AS html, '![' || c || ']()' || CASE WHEN d = '' THEN '' ELSE chr(10) || chr(10) || '> ' || d END AS markdown, '{{"concise_alt":"' || j || '","detailed_description":"' || d || '"}}' AS json,
          'Alt: ' || c || CASE WHEN d = '' THEN '' ELSE chr(10) || 'Description: ' || d END AS plain, tag AS pdf_tag, descr AS docx, CASE k WHEN 'pdf' THEN tag WHEN 'epub' THEN '{{"alt":"' || j || '"}}' ELSE descr END AS native FROM y""",
        "audit_text_summaries": f"{with_doc(ALL)}, {tools_counted} SELECT doc, 'score ' || score || '/100 (' || {level} || '), ' || e || ' errors, ' || w || ' warnings, ' || i || ' others' AS summary FROM s",
        "audit_document_reports": f"{some}, {counted}, t AS (SELECT doc, string_agg('| ' || severity || ' | ' || rule || ' | ' || coalesce('' || page, '-') || ' | ' || message || ' |', chr(10) ORDER BY {_RANK}, ord, encode('| ' || severity || ' | ' || rule || ' | ' || coalesce('' || page, '-') || ' | ' || message || ' |')) AS rows FROM found GROUP BY doc) SELECT t.doc, '# Document ' || t.doc || chr(10) || chr(10) || 'Score ' || score || ' (' || {level} || ')' || chr(10) || chr(10) || '| severity | rule | page | message |' || chr(10) || '|---|---|---|---|' || chr(10) || rows AS report FROM t JOIN s ON s.doc = t.doc",
        "planned_fixes": f"WITH RECURSIVE {_facts(*_PLANNED)}{_repairs()}",
        "audit_severity_counts": f"{ALL} SELECT type, severity, count(*) AS n FROM found GROUP BY ALL",
        "audit_by_severity": f"{ALL} SELECT doc, count(*) FILTER ({_BAD}) AS errors, count(*) FILTER ({_WARN}) AS warnings, count(*) FILTER (lower(severity) NOT IN ('error', 'warning')) AS others FROM found GROUP BY doc",
        "audit_summary": f"{_findings(('core', 'docx', 'xlsx', 'pptx', 'epub'))}, f AS (SELECT CASE WHEN doc % 7 = 0 THEN 'unknown' ELSE type END AS type, doc, severity FROM found), t AS (SELECT DISTINCT type FROM f UNION SELECT unnest(['pdf', 'docx', 'xlsx', 'pptx', 'epub', 'md'])) SELECT t.type, count(DISTINCT f.doc) AS files, count(f.doc) AS findings, count(*) FILTER ({_BAD}) AS errors, count(*) FILTER ({_WARN}) AS warnings FROM t LEFT JOIN f ON f.type = t.type GROUP BY t.type",
        "audit_quick_fixes": f"{ALL}, g AS ({fixes}) SELECT CAST(row_number() OVER (ORDER BY place) AS INT) AS number, title, files, CAST({_TOTAL} AS INT) AS total FROM g WHERE files > 0",
        "audit_file_inventory": f"{ALL} SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY {_RANK}, rule, ord, message) AS INT) AS place, severity, rule, message FROM found",
        "audit_rule_reference": f"{ALL}, c(rule, standard, criterion, level) AS (VALUES {catalogue}) SELECT f.rule, standard, criterion, level AS catalog_severity, CAST(row_number() OVER (ORDER BY CASE level WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Info' THEN 2 WHEN 'Tip' THEN 2 ELSE 9 END, f.rule) AS INT) AS place FROM (SELECT DISTINCT rule FROM found) f LEFT JOIN c ON c.rule = f.rule",
        "audit_manual_review": f"{ALL} SELECT rule, severity, count(DISTINCT doc) AS files FROM found WHERE rule IN ('PDFBP.ORDER.FIGURE', 'PDFBP.ORDER.MCID', 'PDFBP.FORMS_DETACHED', 'PPTX.ORDER.TITLE_FIRST', 'PPTX.ORDER.COLUMNS') GROUP BY ALL",
        "audit_remediation_results": "WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 60 END AS b, o_orderkey % 60 + o_orderkey % 7 - 2 AS a FROM orders) SELECT k AS doc, b AS before, a AS after, CASE WHEN b IS NULL THEN 'N/A' WHEN a > b THEN '+' || (a - b) ELSE '' || (a - b) END AS change, k % 4 AS fixed, k % 3 AS remaining, k % 2 AS needs_human FROM f UNION ALL SELECT NULL, NULL, NULL, NULL, CAST(sum(k % 4) AS BIGINT), CAST(sum(k % 3) AS BIGINT), CAST(sum(k % 2) AS BIGINT) FROM f",
        "audit_baseline_match": "WITH a AS (SELECT 'p' || (p_partkey * 2) AS path FROM part), b AS (SELECT 'p' || (p_partkey * 3) AS path FROM part) SELECT path, CASE count(DISTINCT side) WHEN 2 THEN 'both' ELSE 'only ' || min(side) END AS found FROM (SELECT path, 'before' AS side FROM a UNION ALL SELECT path, 'after' FROM b) GROUP BY path",
        "audit_csv_findings": f"""{with_doc(some)}, {_SPREAD}, r AS (SELECT found.*, row_number() OVER (PARTITION BY doc ORDER BY ord, message) AS k FROM found)
          SELECT 'DOC-' || r.doc || '-' || lpad('' || k, greatest(3, 3), '0') AS finding_id, path AS file_path, upper(r.type) AS file_type, severity, confidence, CASE WHEN {_BAD} THEN '-10' WHEN {_WARN} THEN '-3' ELSE '0' END AS score_impact, r.rule AS rule_id, coalesce(wcag, '') AS wcag_criteria, {_LEVEL} AS wcag_level, message AS issue_summary,
          concat_ws(', ', 'Page ' || page, 'Line ' || line, element) AS location, pattern_type, 'New' AS remediation_status, coalesce(fix, 'manual') AS fix_suggestion, {_URL} AS help_url, {_URL} AS wcag_url FROM r JOIN s ON s.rule = r.rule LEFT JOIN {_FILES} f ON f.doc = r.doc""",
        "audit_csv_scorecard": f"""{with_doc(ALL)}, c AS (SELECT doc, count(*) FILTER ({_BAD}) AS e, count(*) FILTER ({_WARN}) AS w, count(*) FILTER (lower(severity) IN ('info', 'tip')) AS i FROM found WHERE family = 'tools' GROUP BY doc), s AS (SELECT f.*, coalesce(e, 0) AS e, coalesce(w, 0) AS w, coalesce(i, 0) AS i, CASE WHEN f.doc IN (SELECT doc_id FROM doc WHERE NOT access_ok) THEN 0 ELSE 100 - least(10 * coalesce(e, 0), 50) - least(3 * coalesce(w, 0), 21) END AS score FROM {_FILES} f LEFT JOIN c ON c.doc = f.doc)
          SELECT path AS file_path, upper(type) AS file_type, '' || CAST(ceil(size_bytes / 1024) AS BIGINT) AS file_size_kb, '' || CAST(score AS BIGINT) AS score, {grades} AS grade, '' || e AS error_count, '' || w AS warning_count, '' || i AS tip_count, '' || (e + w + i) AS total_issues, '' AS template_name, CASE WHEN trim(coalesce(title, '')) = '' THEN 'No' ELSE 'Yes' END AS has_title, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'No' ELSE 'Yes' END AS has_language, '2026-01-01T00:00:00Z' AS audit_date, 'WCAG 2.2 AA' AS compliance_standard FROM s""",
        "audit_csv_remediation": f"""{ALL}, {_SPREAD}, t(rule, tier) AS (VALUES {tiers}), g AS (SELECT rule, severity, array_to_string(list_sort(list(DISTINCT upper(type))), ', ') AS types, count(DISTINCT doc) AS files, count(*) AS n, min(wcag) AS wcag, min(fix) AS fix FROM found GROUP BY rule, severity)
          SELECT CASE WHEN {_BAD} AND pattern_type <> 'File-specific' THEN 'Immediate' WHEN {_BAD} OR {_WARN} AND pattern_type = 'Systemic' THEN 'Soon' ELSE 'When Possible' END AS priority, g.rule AS rule_id, g.rule AS issue_summary, types AS file_type, '' || files AS affected_files, '' || n AS total_instances, pattern_type, coalesce(wcag, '') AS wcag_criteria, severity,
          CASE tier WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS estimated_effort, coalesce(fix, 'manual') AS fix_steps, {_URL} AS help_url, {_URL} AS wcag_url, '' || (n * CASE WHEN {_BAD} THEN 10 WHEN {_WARN} THEN 5 ELSE 1 END) AS roi_score FROM g JOIN s ON s.rule = g.rule LEFT JOIN t ON t.rule = g.rule""",
        "audit_md_csv_findings": f"""{with_doc(md)}, {_MDROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord, message) AS k FROM m)
          SELECT 'MD-' || r.doc || '-' || lpad('' || k, 3, '0') AS finding_id, path AS file_path, '' || line AS line_number, scale AS severity, confidence, CASE scale WHEN 'Serious' THEN '-7' WHEN 'Moderate' THEN '-3' ELSE '-1' END AS score_impact, coalesce(wcag, '') AS wcag_criteria, {_LEVEL} AS wcag_level, area AS domain, rule AS rule_id, message AS issue_summary, coalesce(element, '') AS content, spread AS pattern_type, 'New' AS remediation_status, 'No' AS auto_fixable, 'manual' AS fix_suggestion, {_URL} AS wcag_url FROM r LEFT JOIN {_FILES} f ON f.doc = r.doc""",
        "audit_md_csv_scorecard": f"""{with_doc(md)}, {_MDROWS}, c AS (SELECT doc, count(*) FILTER (scale = 'Serious') AS b, count(*) FILTER (scale = 'Moderate') AS c, count(*) FILTER (scale = 'Minor') AS d, count(*) AS n, count(*) FILTER (spread = 'Systemic') AS sys FROM m GROUP BY doc), s AS (SELECT path, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(n, 0) AS n, coalesce(sys, 0) AS sys, greatest(0, 100 - 7 * coalesce(b, 0) - 3 * coalesce(c, 0) - coalesce(d, 0)) AS score FROM {_FILES} f LEFT JOIN c ON c.doc = f.doc)
          SELECT path AS file_path, '' || score AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 25 THEN 'D' ELSE 'F' END AS grade, '0' AS critical_count, '' || b AS serious_count, '' || c AS moderate_count, '' || d AS minor_count, '' || n AS total_issues, '' || sys AS systemic_issues, '' || (n - sys) AS file_specific_issues, '0' AS auto_fixable, '' || n AS manual_review, '2026-01-01T00:00:00Z' AS audit_date FROM s""",
        "audit_md_csv_remediation": f"""{md}, {_MDROWS}, g AS (SELECT rule, area, scale, spread, files, wcag, count(*) AS n, count(*) * CASE scale WHEN 'Serious' THEN 7 WHEN 'Moderate' THEN 3 ELSE 1 END AS worth FROM m GROUP BY rule, area, scale, spread, files, wcag)
          SELECT '' || row_number() OVER (ORDER BY worth DESC, rule, scale) AS priority, area AS domain, rule AS rule_id, rule AS issue_summary, '' || files AS affected_files, '' || n AS total_instances, spread AS pattern_type, coalesce(wcag, '') AS wcag_criteria, scale AS severity, 'High' AS estimated_effort, 'No' AS auto_fixable, 'manual' AS fix_guidance, {_URL} AS wcag_url, '' || worth AS roi_score FROM g""",
        "audit_tier_badges": f"{ALL}, t(rule, tier) AS (VALUES {tiers}) SELECT CAST(tier AS INT) AS tier, ['Automated', 'Assisted', 'Manual'][tier] || ': ' || count(DISTINCT doc) || ' of ' || {_TOTAL} || ' files: ' || array_to_string(list_sort(list(DISTINCT found.rule)), ', ') AS badge FROM found JOIN t ON t.rule = found.rule GROUP BY tier",
        "audit_chosen_models": "WITH a AS (SELECT p_partkey, ['a','b','c','d','e','f','x','a','b','c','d','e','f','x'][p_partkey % 7 + 1 : p_partkey % 7 + p_size % 8] AS x FROM part), d AS (SELECT p_partkey, CASE WHEN len(x) > 7 THEN x[1:7] ELSE x END AS u FROM a) SELECT p_partkey, CASE WHEN len(u) <= 5 AND NOT list_contains(u, 'x') THEN CASE WHEN len(u) = 0 THEN 'a' ELSE array_to_string(u, ',') END END AS models, CASE WHEN len(u) > 5 THEN 'too many models: ' || len(u) WHEN list_contains(u, 'x') THEN 'unknown models: x' END AS error FROM d",
        "audit_error_types": "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'api' WHEN 3 THEN 'parse' END AS error_type FROM part",
        "audit_pixels": "SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) * CASE WHEN p_partkey % 10 < 1 THEN 0.5 WHEN p_partkey % 10 > 8 THEN 4.0 ELSE p_partkey % 10 / 2 END AS px, CAST(CASE p_partkey % 4 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 1.0 END AS DOUBLE) AS weight FROM part",
        "audit_tool_errors": f"WITH {_facts('doc')} SELECT doc_id AS doc, type, 'TOOL.FILE' AS rule, 'error' AS severity, 'high' AS confidence, CASE WHEN skip_reason IS NULL THEN 'not readable' ELSE skip_reason END AS message FROM doc WHERE access_ok = false",
        "audit_saved_findings": f"{_findings(('core', 'markdown'))} SELECT doc, type, ord, rule, severity, message, page, line FROM found",
        "validator_clauses": """WITH x AS (SELECT l_orderkey, l_linenumber, ['7.1','7.2','7.3','7.18.3','7.21','7.5','99.9'][l_orderkey % 7 + 1] AS c, '' || (l_linenumber % 3 + 1) AS t, l_linenumber % 2 = 0 AS d FROM lineitem),
          y AS (SELECT *, CASE c || '/' || t WHEN '7.1/1' THEN 'PDFUA.TAGGED,error,1.3.1' WHEN '7.1/2' THEN 'PDFUA.TAGGED,error,1.3.1' WHEN '7.2/1' THEN 'PDFUA.LANG,error,3.1.1' WHEN '7.2/2' THEN 'PDFBP.READING_ORDER,warning,1.3.2' WHEN '7.3/1' THEN 'PDFUA.TAGGED,error,1.3.1' WHEN '7.3/2' THEN 'PDFUA.IMG.ALT,error,1.1.1' WHEN '7.18.3/1' THEN 'PDFUA.FORMS,error,4.1.2' WHEN '7.18.3/2' THEN 'PDFUA.FORMS,error,4.1.2' WHEN '7.21/1' THEN 'PDFUA.TITLE,error,2.4.2' WHEN '7.21/2' THEN 'PDFBP.DISPLAY_TITLE,warning,2.4.2' WHEN '7.5/1' THEN 'PDFBP.TABLE_HEADERS,warning,1.3.1' WHEN '7.5/2' THEN 'PDFBP.TABLE_SCOPE,warning,1.3.1' END AS k FROM x)
          SELECT l_orderkey, l_linenumber, coalesce(string_split(k, ',')[1], 'VERAPDF.' || c || '.' || t) AS rule, coalesce(string_split(k, ',')[2], 'warning') AS severity, coalesce(string_split(k, ',')[3], '') AS wcag, CASE WHEN k IS NULL THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN k IS NOT NULL THEN string_split(k, ',')[1] WHEN d THEN 'said' ELSE 'rule ' || c || '/' || t || ' failed' END AS message FROM y""",
        "tree_top_level": f"WITH {_facts('struct_node')} SELECT doc_id, tag, count(*) AS n FROM struct_node WHERE depth = 1 GROUP BY ALL",
        "tree_find": f"WITH {_facts('struct_node')} SELECT doc_id, node_id FROM struct_node WHERE tag = 'Figure' AND page = 2",
        "tree_content_order": f"WITH {_facts('struct_node')}, a AS (SELECT doc_id, preorder, post, page FROM struct_node WHERE depth = 2 AND preorder % 5 > 0), c AS (SELECT n.doc_id, a.page, n.preorder FROM struct_node n JOIN a ON a.doc_id = n.doc_id AND n.preorder BETWEEN a.preorder AND a.post WHERE n.contents > 0) SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY preorder) - 1 AS INT) AS pos, preorder AS mcid FROM c",
        "tree_misplaced": f"WITH {_facts('struct_node')}, b AS (SELECT n.doc_id, n.node_id, n.tag, p.tag AS parent_tag FROM struct_node n JOIN struct_node p ON p.doc_id = n.doc_id AND p.node_id = n.parent_id) SELECT * FROM b WHERE parent_tag = 'L' AND tag NOT IN ('LI', 'Caption') OR parent_tag = 'Table' AND tag NOT IN ('THead', 'TBody', 'TFoot', 'TR', 'Caption') OR parent_tag = 'TR' AND tag NOT IN ('TH', 'TD') OR parent_tag = 'TOC' AND tag NOT IN ('TOCI', 'TOC', 'Caption') OR parent_tag IN ('THead', 'TBody', 'TFoot') AND tag <> 'TR' OR tag = 'LI' AND parent_tag <> 'L' OR tag = 'LBody' AND parent_tag <> 'LI' OR tag = 'TOCI' AND parent_tag <> 'TOC' OR tag IN ('THead', 'TBody', 'TFoot') AND parent_tag <> 'Table'",
        "tree_form_placement": f"WITH {_facts('struct_node', 'form_field')}, n AS (SELECT doc_id, bool_or(tag = 'Form' AND depth = 1) AS top, bool_or(tag = 'Form' AND depth > 1) AS low FROM struct_node GROUP BY doc_id) SELECT f.doc_id, count(*) AS fields, CASE WHEN any_value(n.doc_id) IS NULL THEN 'no_struct_tree' WHEN any_value(top) THEN CASE WHEN any_value(low) THEN 'mixed' ELSE 'orphaned' END WHEN any_value(low) THEN 'good' ELSE 'acroform_only' END AS placement FROM form_field f LEFT JOIN n ON n.doc_id = f.doc_id GROUP BY f.doc_id",
        "tree_figure_texts": f"WITH {_facts('struct_node')} SELECT doc_id, count(*) AS figures, count(*) FILTER ({_no('alt')}) AS without, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER ({_no('alt')})), ', '), '') AS pages FROM struct_node WHERE tag = 'Figure' GROUP BY doc_id",
    }
