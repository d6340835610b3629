"""The same results in DuckDB SQL, written on their own and not derived from the Spark plans."""

from __future__ import annotations

from lectern import oracle_rules

F = """f AS (SELECT l_orderkey AS doc, ['pdf','docx','xlsx','pptx','epub','md'][CAST(l_orderkey % 6 + 1 AS INT)] AS type, 'R' || (l_partkey % 12) AS rule,
  CASE l_returnflag WHEN 'R' THEN 'Error' WHEN 'A' THEN 'Warning' ELSE 'Info' END AS severity, ['High','Medium','Low'][CAST(l_linenumber % 3 + 1 AS INT)] AS confidence,
  CAST(l_linenumber AS VARCHAR) AS message, CAST(l_linenumber AS INT) AS page, l_orderkey * 10 + l_linenumber AS ord, l_shipdate FROM lineitem)"""
C = F + """, c AS (SELECT doc, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos FROM f GROUP BY doc)"""


def _grade(s: str, a: int = 90, b: int = 80, c: int = 70, d: int = 60) -> str:
    return f"CASE WHEN {s} >= {a} THEN 'A' WHEN {s} >= {b} THEN 'B' WHEN {s} >= {c} THEN 'C' WHEN {s} >= {d} THEN 'D' ELSE 'F' END"


TOOLS = "greatest(0, 100 - least(10 * errors, 50) - least(3 * warnings, 21))"
S = C + f", s AS (SELECT *, CAST({TOOLS} AS INT) AS score FROM c)"
RULES = "r AS (SELECT 'R' || i AS rule, '1.' || (i % 5) AS criterion FROM range(14) t(i))"
TIERS = "t AS (SELECT 'R' || i AS rule, CAST(i % 3 + 1 AS INT) AS tier, ['fix_pdf','fix_word','fix_excel','fix_pptx','fix_epub'][CAST(i % 5 + 1 AS INT)] AS tool, CASE WHEN i = 3 THEN 'X3' ELSE 'R' || i END AS fixer FROM range(9) x(i))"
HALVES = F + ", a AS (SELECT * FROM f WHERE l_shipdate < TIMESTAMP '1995-06-01'), b AS (SELECT * FROM f WHERE l_shipdate >= TIMESTAMP '1995-06-01')"
H = "h AS (SELECT p_brand AS doc, CAST(p_size % 6 + 1 AS INT) AS level, p_partkey AS ord FROM part)"
MD = r"""m AS (SELECT p_partkey AS doc_id, (CASE WHEN p_partkey % 3 = 0 THEN '# ' ELSE '## ' END) || p_name || E'\n\n' || (CASE WHEN p_partkey % 2 = 0 THEN E'Some words.\n' ELSE '' END)
  || 'See [' || ['here','read more about us','https://x.org/a','Annual report','click here','the zip file',''][CAST(p_partkey % 7 + 1 AS INT)] || '](files/a' || (CASE WHEN p_size % 2 = 0 THEN '.pdf' ELSE '.zip' END) || ') and !['
  || ['','image','photo.jpg','A chart of sales'][CAST(p_size % 4 + 1 AS INT)] || E'](a.png)\n```\n[here](b.pdf)\n# no\n```\n' || (CASE WHEN p_size % 3 = 0 THEN E'#### Deep\n' ELSE '' END) || E'| a | | c |\n|---|---|---|\n| 1 | 2 | 3 |\n'
  || (CASE WHEN p_size % 5 = 0 THEN E'# More 😀😀\ntext ☀ here\n' ELSE '' END) || (CASE WHEN p_size % 7 = 0 THEN E'+----+----+----+\n' ELSE '' END) || (CASE WHEN p_size % 11 = 0 THEN E'## D\n\n```mermaid\ngraph\n```\n' ELSE '' END) AS text FROM part),
l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS raw FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), E'\n') AS x FROM m)),
q AS (SELECT *, trim(raw) AS stripped, starts_with(trim(raw), '```') AS fence FROM l),
v AS (SELECT *, coalesce(sum(CAST(fence AS INT)) OVER w, 0) % 2 = 1 AS inside, last_value(nullif(stripped, '') IGNORE NULLS) OVER w AS previous FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, NOT fence AND NOT inside AS outside, fence AND NOT inside AS opens FROM v)"""
ALTS = """a AS (SELECT p_partkey, p_brand, p_type, trim([p_name, 'image of ' || p_name, p_name || '.png', 'photo', '', 'A bar chart showing the percent increase of ' || p_name, '[' || p_type || ']', repeat(p_name || ' ', 9)][CAST(p_partkey % 8 + 1 AS INT)]) AS t FROM part),
w AS (SELECT *, length(t) AS n, len(regexp_extract_all(t, '(?i)\\b(chart|graph|table|map|form|button|link|menu|bar|pie|line|scatter|histogram|person|people|student|teacher|staff|building|campus|room|office|showing|displaying|containing|red|blue|green|yellow|orange|purple|black|white|left|right|top|bottom|center|labeled|titled|heading|section|percent|percentage|increase|decrease|trend|comparison)\\b')) AS k FROM a)""".replace("\\\\", "\\")


def _alt(context: str) -> str:
    checks = [
        ("PLACEHOLDER", 60, r"regexp_matches(t, '(?i)^(alt\s*text|description|image|photo|picture|graphic|untitled|placeholder|todo|tbd|fixme|replace\s+me|insert\s+(alt|description)|img_?\d+|image_?\d+|dsc_?\d+|screenshot_?\d+)\.?$')"),
        ("FILENAME", 50, r"regexp_matches(t, '(?i)^[\w\-./\\]+\.(png|jpg|jpeg|gif|bmp|svg|tiff?|webp|avif|ico)$')"),
        ("REDUNDANT_PREFIX", 10, r"regexp_matches(t, '(?i)^(image|picture|photo|graphic|icon|logo|illustration|diagram|screenshot|figure|img|pic)\s+(of|showing|depicting|displaying)\s+')"),
        ("TOO_SHORT", 15, "n < 10"), ("SHORT", 5, "n >= 10 AND n < 30"), ("TOO_LONG", 10, "n > 250"), ("LONG", 3, "n > 125 AND n <= 250"),
        ("JUNK_CHARS", 10, r"regexp_matches(t, '[{}\[\]<>|\\]')"), ("LOW_SPECIFICITY", 5, "k = 0 AND n >= 30"), ("HIGH_SPECIFICITY", 0, "k >= 3"),
        ("REDUNDANT_CONTEXT", 15, f"contains(lower({context}), lower(t))" if context else "false"), ("NO_CAPITAL", 2, "n >= 20 AND regexp_matches(t, '^[a-z]')"),
    ]
    score = " + ".join(f"(CASE WHEN {c} THEN {d} ELSE 0 END)" for _, d, c in checks)
    codes = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, _, c in checks)
    return f"CASE WHEN t = '' THEN 0 ELSE CAST(greatest(0, least(100, 100 - ({score}))) AS INT) END AS score, CASE WHEN t = '' THEN 'MISSING' ELSE array_to_string(list_filter([{codes}], lambda x: x IS NOT NULL), ',') END AS codes"


TREE = """n0 AS (
  SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 0 AS node_id, NULL::INT AS parent_id, 0 AS ord, 'Document' AS tag, NULL::INT AS mcid FROM region
  UNION ALL SELECT n_regionkey, n_nationkey + 1, 0, n_nationkey, 'Sect', NULL FROM nation
  UNION ALL SELECT n_regionkey, c_custkey + 1000, n_nationkey + 1, c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Caption' ELSE 'Sect' END, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, o_orderkey + 1000000, c_custkey + 1000, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Form' ELSE 'P' END, o_orderkey % 1000 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT *, CAST(node_id % 7 AS INT) AS page FROM n0),
walk AS (SELECT doc_id, node_id, 1 AS depth, [ord] AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.doc_id, n.node_id, w.depth + 1, list_append(w.path, n.ord) FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.parent_id = w.node_id),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS preorder FROM walk)"""
LEAF = TREE + """, leaf AS (SELECT n.doc_id, n.node_id, CASE WHEN tag = 'Form' THEN 'form' ELSE 'text' END AS kind, row_number() OVER (PARTITION BY n.doc_id ORDER BY preorder) - 1 AS place
  FROM n JOIN o USING (doc_id, node_id) WHERE mcid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = n.doc_id AND c.parent_id = n.node_id))"""
FIELDS = """d AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderpriority AS name, o_orderstatus = 'F' AS radio, o_orderkey % 2 = 0 AS required,
  CASE o_orderkey % 3 WHEN 0 THEN 'Required ' || o_orderstatus WHEN 1 THEN o_orderpriority END AS tooltip FROM orders)"""


def _light(r: str, g: str, b: str) -> str:
    part = lambda c: f"(CASE WHEN ({c}) / 255.0 <= 0.03928 THEN ({c}) / 255.0 / 12.92 ELSE pow((({c}) / 255.0 + 0.055) / 1.055, 2.4) END)"
    return f"(0.2126::DOUBLE * {part(r)} + 0.7152::DOUBLE * {part(g)} + 0.0722::DOUBLE * {part(b)})"


ORACLE: dict[str, str] = {
    "score_tools": f"WITH {S} SELECT doc, errors, warnings, infos, score, {_grade('score')} AS grade FROM s",
    "score_core": f"WITH {C}, s AS (SELECT *, CAST(greatest(0, floor(100 - (5 * errors + 2 * warnings + 0.5 * infos))) AS INT) AS score FROM c) SELECT *, {_grade('score', d=50)} AS grade FROM s",
    "score_confidence": f"WITH {F}, s AS (SELECT doc, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos, CAST(greatest(0, 100 - sum(CASE severity WHEN 'Error' THEN CASE confidence WHEN 'High' THEN 10 WHEN 'Medium' THEN 7 ELSE 3 END WHEN 'Warning' THEN CASE confidence WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END ELSE 0 END)) AS INT) AS score FROM f GROUP BY doc) SELECT *, {_grade('score', b=75, c=50, d=25)} AS grade FROM s",
    "score_markdown": f"WITH {F}, s AS (SELECT doc, CAST(greatest(0, 100 - sum([15, 7, 3, 1][page % 4 + 1])) AS INT) AS score FROM f GROUP BY doc) SELECT *, {_grade('score', b=75, c=50, d=25)} AS grade FROM s",
    "score_all_documents": f"WITH {C}, x AS (SELECT o_orderkey AS doc, o_orderkey % 50 <> 0 AS access_ok, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM orders LEFT JOIN c ON o_orderkey = doc), s AS (SELECT *, CAST(CASE WHEN access_ok THEN {TOOLS} ELSE 0 END AS INT) AS score FROM x) SELECT *, {_grade('score')} AS grade FROM s",
    "corpus_score": f"WITH {S}, g AS (SELECT count(*) AS files, CAST(round_even(avg(score), 0) AS INT) AS score FROM s) SELECT *, {_grade('score')} AS grade FROM g",
    "merge_reaggregate": f"WITH {S}, g AS (SELECT count(*) AS files, CAST(round_even(avg(score), 0) AS INT) AS score FROM s) SELECT *, {_grade('score')} AS grade FROM g",
    "projected_score": f"WITH {S} SELECT doc, CAST(least(100, score + floor(5 * errors + 2 * warnings + 0.5 * infos)) AS INT) AS projected FROM s",
    "grade_histogram": f"WITH {S} SELECT {_grade('score')} AS grade, count(*) AS files FROM s GROUP BY 1",
    "severity_pivot": f"""WITH {F} SELECT doc, count(*) FILTER (page NOT IN (4, 5) AND severity = 'Error') AS "Error", count(*) FILTER (page NOT IN (4, 5) AND severity = 'Warning') AS "Warning", count(*) FILTER (page = 5 OR page <> 4 AND severity = 'Info') AS "Info", count(*) FILTER (page = 4) AS "Other" FROM f GROUP BY doc""",
    "severity_by_type": f"""WITH {F} SELECT type, count(*) FILTER (page NOT IN (4, 5) AND severity = 'Error') AS "Error", count(*) FILTER (page NOT IN (4, 5) AND severity = 'Warning') AS "Warning", count(*) FILTER (page = 5 OR page <> 4 AND severity = 'Info') AS "Info", count(*) FILTER (page = 4) AS "Other" FROM f GROUP BY type""",
    "audit_grouping_sets": f"WITH {F} SELECT type, rule, severity, count(*) AS n, CAST(grouping(type, rule, severity) AS INT) AS level FROM f GROUP BY GROUPING SETS ((type), (rule), (severity), ())",
    "audit_rollup": f"WITH {F} SELECT type, severity, count(*) AS n, count(DISTINCT doc) AS files FROM f GROUP BY ROLLUP (type, severity)",
    "dedup_rule_message": f"WITH {F} SELECT doc, rule, CAST(page % 2 AS VARCHAR) AS message, min(ord) AS ord FROM f GROUP BY 1, 2, 3",
    "findings_by_rule": f"WITH {F} SELECT rule, count(*) AS findings, count(DISTINCT doc) AS files FROM f GROUP BY rule",
    "affected_files": f"WITH {F} SELECT type, count(DISTINCT doc) AS files FROM f GROUP BY type",
    "summary_table": f"WITH {F}, {RULES} SELECT f.rule, min(CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END) AS level, count(DISTINCT doc) AS files, count(*) AS findings, arg_min(message, ord) AS first_message, any_value(criterion) AS criterion FROM f LEFT JOIN r ON f.rule = r.rule GROUP BY f.rule",
    "priority_plan": f"WITH {F}, g AS (SELECT severity, rule, count(DISTINCT doc) AS files, count(*) AS findings FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY severity ORDER BY files DESC, rule) AS position FROM g",
    "executive_top6": f"WITH {F}, g AS (SELECT rule, count(DISTINCT doc) AS files, CASE WHEN bool_or(severity = 'Error') THEN 'errors' WHEN bool_or(severity = 'Warning') THEN 'warnings' END AS part FROM f GROUP BY rule), p AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY files DESC, rule) AS position FROM g WHERE part IS NOT NULL) SELECT part, position, rule, files FROM p WHERE position <= 6",
    "consolidate_pages": f"WITH {F} SELECT rule, arg_min(severity, ord) AS severity, count(*) AS n, array_to_string(list_sort(list_distinct(list(page))), ', ') AS pages FROM f GROUP BY rule",
    "filter_search_panel": f"{oracle_rules.ALL} SELECT doc, rule, ord, message, CAST(1000000 + coalesce(page, 0) AS INT) AS sort_key FROM found WHERE severity = 'Warning' AND (lower(message) LIKE '%1.3.1%' OR lower(rule) LIKE '%1.3.1%' OR wcag LIKE '%1.3.1%' OR lower(element) LIKE '%1.3.1%')",
    "verify_fix_delta": f"WITH {HALVES}, x AS (SELECT rule, count(*) AS o FROM a GROUP BY rule), y AS (SELECT rule, count(*) AS n FROM b GROUP BY rule), z AS (SELECT coalesce(x.rule, y.rule) AS rule, coalesce(o, 0) AS before, coalesce(n, 0) AS after FROM x FULL JOIN y ON x.rule = y.rule) SELECT *, greatest(before - after, 0) AS resolved, CASE WHEN before > 0 THEN after ELSE 0 END AS remaining, greatest(after - before, 0) AS added FROM z",
    "baseline_status": f"WITH {HALVES}, x AS (SELECT DISTINCT doc, CASE WHEN page <= 3 THEN rule ELSE 'X' || rule END AS rule FROM a), y AS (SELECT DISTINCT doc, rule FROM b), e AS (SELECT DISTINCT doc, rule FROM a) SELECT doc, rule, 'Fixed' AS status FROM x ANTI JOIN y USING (doc, rule) UNION ALL SELECT doc, rule, 'Persistent' FROM x SEMI JOIN y USING (doc, rule) UNION ALL SELECT y.doc, y.rule, CASE WHEN e.doc IS NULL THEN 'New' ELSE 'Regressed' END FROM y LEFT JOIN x ON x.doc = y.doc AND x.rule = y.rule LEFT JOIN e ON e.doc = y.doc AND e.rule = y.rule WHERE x.doc IS NULL",
    "score_delta": f"WITH {HALVES}, x AS (SELECT doc, 100 - least(10 * count(*) FILTER (severity = 'Error'), 50) - least(3 * count(*) FILTER (severity = 'Warning'), 21) AS s FROM a GROUP BY doc), y AS (SELECT doc, 100 - least(10 * count(*) FILTER (severity = 'Error'), 50) - least(3 * count(*) FILTER (severity = 'Warning'), 21) AS s FROM b GROUP BY doc), m AS (SELECT CAST(round_even(avg(x.s), 0) AS INT) AS before, CAST(round_even(avg(y.s), 0) AS INT) AS after FROM x JOIN y ON x.doc = y.doc) SELECT before, after, after - before AS delta FROM m",
    "fixable_rules": f"WITH {F}, {TIERS}, k(type, tool) AS (VALUES ('pdf','fix_pdf'),('docx','fix_word'),('xlsx','fix_excel'),('pptx','fix_pptx'),('epub','fix_epub')), x AS (SELECT doc, fixer, min(ord) AS o FROM f JOIN t ON f.rule = t.rule JOIN k ON k.type = f.type AND k.tool = t.tool WHERE tier <= 2 GROUP BY doc, fixer) SELECT doc, string_agg(fixer, ',' ORDER BY o, fixer) AS rules FROM x GROUP BY doc",
    "best_tier": f"WITH {F}, {TIERS} SELECT doc, coalesce(min(tier), 0) AS tier FROM f LEFT JOIN t ON f.rule = t.rule GROUP BY doc",
    "rules_by_tier": f"WITH {F}, {TIERS} SELECT tier, count(DISTINCT f.rule) AS rules, count(*) AS findings FROM f JOIN t ON f.rule = t.rule GROUP BY tier",
    "roi_priority": f"WITH {F} SELECT rule, severity, count(*) AS n, count(*) * CASE severity WHEN 'Error' THEN 10 WHEN 'Warning' THEN 5 ELSE 1 END AS roi FROM f GROUP BY rule, severity",
    "pattern_classification": f"WITH {F}, t AS (SELECT count(DISTINCT doc) AS n FROM f), g AS (SELECT rule, count(DISTINCT doc) AS files, count(DISTINCT type) AS types FROM f GROUP BY rule) SELECT rule, files, types, CASE WHEN files = n THEN 'systemic' WHEN files / n >= 0.3 THEN 'widespread' WHEN files >= 3 THEN 'repeated' ELSE 'isolated' END AS pattern FROM g, t",
    "template_fingerprint": f"WITH {F}, x AS (SELECT doc, md5(array_to_string(list_sort(list_distinct(list(rule))), ';')) AS fingerprint FROM f GROUP BY doc) SELECT fingerprint, count(*) AS files, min(doc) AS first_doc FROM x GROUP BY fingerprint HAVING count(*) >= 3",
    "vpat_conformance": f"WITH {F}, {RULES}, t AS (SELECT count(DISTINCT doc) AS n FROM f), g AS (SELECT criterion, count(DISTINCT doc) AS files FROM f JOIN r ON f.rule = r.rule WHERE f.rule <> 'R4' AND severity <> 'Info' GROUP BY criterion) SELECT q.criterion, coalesce(files, 0) AS files, CASE WHEN coalesce(files, 0) = 0 THEN 'Supports' WHEN 2 * files > n THEN 'Does Not Support' ELSE 'Partially Supports' END AS conformance FROM (SELECT DISTINCT criterion FROM r) q LEFT JOIN g ON g.criterion = q.criterion, t",
    "metadata_dashboard": "SELECT p_brand, count(*) AS files, count(DISTINCT p_type) AS authors, count(*) FILTER (p_size > 25) AS titled, arg_min(p_partkey, (p_retailprice, p_partkey)) AS smallest, max(p_retailprice) AS largest FROM part GROUP BY p_brand",
    "quick_fix_groups": f"WITH {F}, g(position, title, rule) AS (VALUES (1,'tagging','R1'),(1,'tagging','R2'),(2,'title','R99'),(3,'language','R5'),(4,'forms','R7')), x AS (SELECT position, title, count(DISTINCT doc) AS files FROM f JOIN g ON f.rule = g.rule GROUP BY 1, 2) SELECT title, files, row_number() OVER (ORDER BY position) AS number FROM x",
    "stratified_sample": f"WITH {F}, d AS (SELECT DISTINCT doc, type FROM f), c AS (SELECT type, count(*) AS n, sum(count(*)) OVER () AS t FROM d GROUP BY type), p AS (SELECT doc, type, row_number() OVER (PARTITION BY type ORDER BY md5(CAST(doc AS VARCHAR)), doc) AS k FROM d) SELECT doc, p.type FROM p JOIN c ON c.type = p.type WHERE k <= greatest(1, CAST(round(60 * n / t) AS INT))",
    "heading_skip_lag": f"WITH {H}, x AS (SELECT *, lag(level) OVER (PARTITION BY doc ORDER BY ord) AS before FROM h) SELECT * FROM x WHERE level > before + 1",
    "heading_holes": f"WITH {H}, g AS (SELECT doc || '/' || (ord % 50) AS doc, CASE level WHEN 2 THEN 4 ELSE level END AS level FROM h), m AS (SELECT doc, max(level) AS m FROM g GROUP BY doc) SELECT doc, CAST(k AS INT) AS hole FROM m, range(1, 7) x(k) WHERE k <= m AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc = m.doc AND g.level = k)",
    "docx_seen_levels": f"WITH {H}, fst AS (SELECT doc, level, min(ord) AS first FROM h GROUP BY 1, 2), x AS (SELECT h.doc, h.level, h.ord, min(k) AS missing FROM h, range(1, 6) r(k) WHERE k < h.level AND NOT EXISTS (SELECT 1 FROM fst WHERE fst.doc = h.doc AND fst.level = k AND first < h.ord) GROUP BY ALL) SELECT doc, level, ord, CAST(missing AS INT) AS missing FROM x",
    "multiple_h1": f"WITH {H}, x AS (SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY ord) AS nth FROM h WHERE level = 1) SELECT * FROM x WHERE nth > 1",
    "heading_repair_fold": f"WITH RECURSIVE {H}, q AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS i FROM h), w AS (SELECT doc, i, level AS fixed FROM q WHERE i = 1 UNION ALL SELECT q.doc, q.i, least(q.level, w.fixed + 1) FROM w JOIN q ON q.doc = w.doc AND q.i = w.i + 1) SELECT doc, string_agg(CAST(fixed AS VARCHAR), ',' ORDER BY i) AS repaired FROM w GROUP BY doc",
    "list_continuation": f"WITH {H}, x AS (SELECT doc, ord, level, CAST(ord % 9 AS INT) AS items, lead(level) OVER w AS nl, CAST(lead(ord % 9) OVER w AS INT) AS next_items FROM h WINDOW w AS (PARTITION BY doc ORDER BY ord)) SELECT doc, ord, items, next_items FROM x WHERE level = nl AND (items <= 5 OR next_items <= 5)",
    "md_lines": f"WITH {MD} SELECT doc_id, line_no, raw, outside, opens, previous FROM st",
    "md_links": rf"""WITH {MD}, x AS (SELECT doc_id, line_no, unnest(regexp_extract_all(raw, '\[([^\]]*)\]\(([^)]+)\)', 1)) AS text, unnest(regexp_extract_all(raw, '\[([^\]]*)\]\(([^)]+)\)', 2)) AS url FROM st WHERE outside)
      SELECT doc_id, line_no, text, CASE WHEN text IN ('here', 'click here') OR text LIKE 'read more about%' THEN 'ambiguous' WHEN text LIKE 'https://%' THEN 'bare' END AS kind, (url LIKE '%.pdf' AND text NOT LIKE '%pdf%') OR (url LIKE '%.zip' AND text NOT LIKE '%zip%') AS hides_type FROM x""",
    "md_alt_quality": rf"""WITH {MD}, x AS (SELECT doc_id, line_no, unnest(regexp_extract_all(raw, '!\[([^\]]*)\]\(([^)]+)\)', 1)) AS alt FROM st WHERE outside) SELECT doc_id, line_no, alt, CASE WHEN alt = '' THEN 'missing' ELSE 'weak' END AS kind FROM x WHERE alt IN ('', 'image', 'photo.jpg')""",
    "md_headings": rf"WITH {MD} SELECT doc_id, line_no, CAST(length(regexp_extract(raw, '^(#{{1,6}})\s', 1)) AS INT) AS level, trim(regexp_replace(raw, '^#+', '')) AS text FROM st WHERE outside AND regexp_matches(raw, '^#{{1,6}}\s+.')",
    "md_tables": rf"""WITH {MD}, x AS (SELECT *, lag(starts_with(stripped, '|')) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM st WHERE outside), y AS (SELECT doc_id, line_no, coalesce(starts_with(previous, '#'), true) AS no_description, list_transform(string_split(trim(stripped, '|'), '|'), lambda c: trim(c)) AS c FROM x WHERE starts_with(stripped, '|') AND NOT coalesce(after, false)),
      z AS (SELECT doc_id, line_no, no_description, CAST(unnest(range(len(c))) AS INT) AS place, unnest(c) AS cell FROM y) SELECT * FROM z WHERE cell = '' OR no_description""",
    "md_emoji": f"WITH {MD} SELECT doc_id, line_no, starts_with(raw, '# ') AS in_heading, CAST(CASE WHEN raw LIKE '%😀😀%' THEN 2 ELSE 1 END AS INT) AS n FROM st WHERE outside AND (raw LIKE '%😀%' OR raw LIKE '%☀%')",
    "md_fences": f"WITH {MD} SELECT doc_id, line_no, trim(stripped[4:]) AS language, previous FROM st WHERE opens",
    "underscore_fill": "WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(CASE WHEN p_size >= 12 THEN 1 ELSE 0 END + CASE WHEN p_size % 20 >= 12 THEN 1 ELSE 0 END AS INT) AS fill_lines FROM part) SELECT * FROM x WHERE fill_lines > 0",
    "text_extractable": r"WITH x AS (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS book, doc_id AS page, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 40 AS poor FROM documents), g AS (SELECT book, count(*) AS pages, count(*) FILTER (poor) AS bad, array_to_string(list_sort(list(page) FILTER (poor))[1:10], ',') AS listed FROM x GROUP BY book) SELECT *, CASE WHEN bad = pages THEN 'error' ELSE 'warning' END AS severity FROM g WHERE bad > 0",
    "paragraph_150_words": r"WITH x AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS s FROM documents)) SELECT doc_id, CAST(i AS INT) AS i, CAST(len(regexp_extract_all(line, '[^ ]+')) AS INT) AS words FROM x WHERE len(regexp_extract_all(line, '[^ ]+')) > 150",
    "alt_score": f"""WITH {ALTS} SELECT p_partkey, {_alt("'About ' || p_type || ' PHOTO'")} FROM w""",
    "alt_rank": f"WITH {ALTS}, s AS (SELECT p_brand, p_partkey, {_alt('')} FROM w) SELECT p_brand, p_partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s",
    "alt_recommendation": f"WITH {ALTS}, s AS (SELECT p_brand, p_type, p_partkey, {_alt('')} FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, p_partkey) AS rank FROM s), b AS (SELECT p_brand, p_type, CASE WHEN p_partkey % 4 <> 0 THEN score END AS best FROM k WHERE rank = 1), e AS (SELECT p_brand, p_type, max(score) FILTER (p_partkey % 3 = 0) AS existing FROM k GROUP BY 1, 2), j AS (SELECT coalesce(b.p_brand, e.p_brand) AS p_brand, coalesce(b.p_type, e.p_type) AS p_type, best, existing FROM b FULL JOIN e ON b.p_brand = e.p_brand AND b.p_type = e.p_type) SELECT *, CASE WHEN best IS NULL AND existing IS NULL THEN '' WHEN best IS NULL THEN CASE WHEN existing >= 80 THEN 'good' WHEN existing >= 60 THEN 'acceptable' ELSE 'rewrite' END WHEN existing >= best THEN 'keep' WHEN existing >= 70 AND best - existing < 10 THEN 'close' ELSE 'adopt' END AS advice FROM j",
    "tree_preorder": f"WITH RECURSIVE {TREE}, z AS (SELECT a.doc_id, a.node_id, a.depth, a.preorder, (SELECT count(*) FROM o b WHERE b.doc_id = a.doc_id AND b.path[1:a.depth] = a.path) AS k FROM o a) SELECT doc_id, node_id, depth, CAST(preorder AS INT) AS preorder, CAST(preorder + k - 1 AS INT) AS post FROM z",
    "sect_depth": f"WITH RECURSIVE {TREE}, s(doc_id, node_id, k) AS (SELECT doc_id, node_id, 0 FROM n WHERE parent_id IS NULL UNION ALL SELECT n.doc_id, n.node_id, s.k + CASE WHEN n.tag = 'Sect' THEN 1 ELSE 0 END FROM s JOIN n ON n.doc_id = s.doc_id AND n.parent_id = s.node_id) SELECT doc_id, max(k)::BIGINT AS depth FROM s GROUP BY doc_id",
    "leaf_sequence": f"WITH RECURSIVE {LEAF} SELECT doc_id, node_id, kind, CAST(place AS INT) AS place FROM leaf",
    "forms_detached": f"WITH RECURSIVE {LEAF}, g AS (SELECT doc_id, count(*) FILTER (kind = 'form') AS forms, count(*) FILTER (kind = 'text') AS texts, CAST(min(place) FILTER (kind = 'form') AS INT) AS first, CAST(max(place) FILTER (kind = 'form') AS INT) AS last FROM leaf GROUP BY doc_id) SELECT *, forms >= 2 AND texts > 0 AND first > 0.5 * texts AND (last - first + 1 - forms) / (last - first + 1) < 0.1 AS detached FROM g",
    "figure_caption_pair": f"WITH RECURSIVE {TREE}, x AS (SELECT *, lead(tag) OVER (PARTITION BY doc_id, parent_id ORDER BY ord) AS after FROM n) SELECT doc_id, node_id, after FROM x WHERE tag = 'Figure' AND after <> 'Caption'",
    "tag_counts": f"WITH RECURSIVE {TREE} SELECT doc_id, tag, count(*) AS n FROM n GROUP BY 1, 2",
    "reading_order_by_page": f"WITH RECURSIVE {TREE} SELECT doc_id, page, count(*) AS n, count(mcid) AS contents FROM n WHERE mcid IS NOT NULL GROUP BY 1, 2",
    "parent_tree": f"WITH RECURSIVE {TREE} SELECT n.doc_id, page, CAST(mcid AS INT) AS mcid, arg_max(n.node_id, preorder) AS node_id FROM n JOIN o USING (doc_id, node_id) WHERE mcid IS NOT NULL GROUP BY 1, 2, 3",
    "inversion_rate": "WITH x AS (SELECT l_orderkey AS d, l_linenumber AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS p FROM lineitem), c AS (SELECT d, count(*) AS n FROM x GROUP BY d), i AS (SELECT a.d, count(*) AS k FROM x a JOIN x b ON a.d = b.d AND a.p < b.p AND a.t > b.t GROUP BY a.d) SELECT c.d AS doc_id, n, round(CASE WHEN n < 2 THEN 0 ELSE coalesce(k, 0) * 2.0 / (n * (n - 1)) END, 9)::DOUBLE AS rate FROM c LEFT JOIN i ON c.d = i.d",
    "empty_runs": "WITH x AS (SELECT user_id, event_type = 'error' AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), y AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM x WHERE e) SELECT user_id, CAST(min(p) AS INT) AS first, CAST(max(p) AS INT) AS last, count(*) AS length FROM y GROUP BY user_id, g HAVING count(*) >= 2",
    "duplicate_field_names": f"WITH {FIELDS} SELECT doc_id, name, count(*) AS n FROM d WHERE NOT radio GROUP BY 1, 2 HAVING count(*) > 1",
    "radio_consistency": f"WITH {FIELDS} SELECT doc_id, string_split(name, '-')[-1] AS grp, count(DISTINCT tooltip) AS tooltips FROM d WHERE radio GROUP BY 1, 2 HAVING count(DISTINCT tooltip) > 1",
    "required_label": f"WITH {FIELDS} SELECT doc_id, count(*) AS n FROM d WHERE required AND tooltip NOT ILIKE '%required%' GROUP BY 1",
    "orphan_widgets": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "lang_valid": "SELECT p_partkey, ['en','en-US','es-419','en419','zh-Hant-TW','en_US','de-1996','x'][CAST(p_partkey % 8 + 1 AS INT)] AS lang FROM part WHERE p_partkey % 8 IN (2, 5, 7)",
    "page_structure": r"SELECT page_id, len(regexp_extract_all(html, '<title[ >]')) AS titles, len(regexp_extract_all(html, '<h1[ >]')) AS h1, len(regexp_extract_all(html, '<a[ >]')) AS links, len(regexp_extract_all(html, '<img[ >]')) AS bare_images FROM pages",
    "page_lang": """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
    "page_link_text": "WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) AS t FROM pages) SELECT page_id, count(*) AS n FROM x WHERE length(t) <= 3 GROUP BY page_id",
    "dup_slide_titles": "SELECT p_brand, lower(p_type) AS title, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "autonumber_titles": "WITH x AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN k > 1 THEN p_type || ' (' || k || ')' ELSE p_type END AS new_title FROM x",
    "contrast_ratios": f"WITH x AS (SELECT p_partkey, {_light('p_partkey % 256', 'p_partkey * 7 % 256', 'p_partkey * 13 % 256')} AS a, {_light('p_partkey * 3 % 256', 'p_partkey * 5 % 256', 'p_partkey * 11 % 256')} AS b FROM part) SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS ratio FROM x",
    "windowed_event_findings": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_event_findings": "SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2",
    "session_event_findings": "WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s",
    "final_assessment": f"""WITH {S}, g AS (SELECT count(*) AS files, CAST(round_even(avg(score), 0) AS INT) AS score FROM s), k AS (SELECT *, {_grade('score')} AS grade FROM g) SELECT *,
      CASE grade WHEN 'A' THEN 'Excellent — meets or exceeds most accessibility requirements' WHEN 'B' THEN 'Good foundation — minor issues need attention' WHEN 'C' THEN 'Adequate foundation, moderate fixes required' ELSE 'Significant barriers found — remediation needed before publishing' END AS status,
      CASE grade WHEN 'A' THEN 'Minimal' WHEN 'B' THEN 'Low' WHEN 'C' THEN 'Moderate' ELSE 'High' END AS effort FROM k""",
    "scan_profile": f"WITH {F} SELECT severity, count(*) AS n FROM f WHERE severity <> 'Info' GROUP BY severity",
    "strengths": f"""WITH {F}, t(position, title, rule, type) AS (VALUES (1,'tagged','R1','pdf'),(1,'tagged','R99','pdf'),(2,'labels','R98','pdf'),(3,'images','R97',NULL),(3,'images','R96',NULL),(4,'titles','R2',NULL),(5,'odd','R95','odt'))
      SELECT CAST(position AS INT) AS position, title FROM t GROUP BY position, title, type HAVING count(*) FILTER (rule IN (SELECT rule FROM f WHERE severity = 'Error')) = 0 AND (type IS NULL OR type IN (SELECT type FROM f))""",
    "time_estimates": f"""WITH {F}, n AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(DISTINCT doc) FILTER (rule IN ('R1', 'R2')) AS a, count(DISTINCT doc) FILTER (rule IN ('R3', 'R4')) AS b, count(DISTINCT doc) FILTER (rule = 'R5') AS d, count(*) FILTER (rule = 'R3') AS shown FROM f)
      SELECT 'language' AS task, a AS files, 2 * a AS least, 2 * a AS most FROM c WHERE a > 0 UNION ALL SELECT 'titles', b, 3 * b, 3 * b FROM c WHERE shown > 0 UNION ALL SELECT 'labels', d, 10, 20 FROM c WHERE d > 0
      UNION ALL SELECT 'Manual reading order review', n, 10 * n, 10 * n FROM n UNION ALL SELECT 'Run accessibility checks', n, 5 * n, 5 * n FROM n""",
    "scorecard": f"WITH {S} SELECT count(*) AS files, round(avg(score), 6) AS mean, arg_min(doc, (-score, doc)) AS best, arg_min(doc, (score, doc)) AS worst FROM s",
    "type_ranking": f"WITH {S}, t AS (SELECT *, ['pdf','docx','xlsx','pptx','epub','md'][CAST(doc % 6 + 1 AS INT)] AS type FROM s) SELECT type, count(*) AS files, round(avg(errors), 6) AS mean_errors, arg_min(doc, (-errors, doc)) AS worst FROM t GROUP BY type",
    "file_totals": f"WITH {S}, x AS (SELECT doc, errors, warnings, score, false AS overall FROM s UNION ALL SELECT NULL, CAST(sum(errors) AS BIGINT), CAST(sum(warnings) AS BIGINT), CAST(round_even(avg(score), 0) AS INT), true FROM s) SELECT *, {_grade('score')} AS grade FROM x",
    "form_summary": f"""WITH {FIELDS}, x AS (SELECT *, coalesce(['Tx', 'Btn', NULL][CAST(ord % 3 + 1 AS INT)], 'Unknown') AS ft FROM d), k AS (SELECT doc_id, ft, count(*) AS n FROM x GROUP BY 1, 2), l AS (SELECT doc_id, string_agg(ft || ':' || n, ',' ORDER BY ft) AS types FROM k GROUP BY 1)
      SELECT doc_id, count(*) AS total, count(*) FILTER (tooltip IS NULL) AS missing_tooltip, count(*) FILTER (ord % 5 = 0) AS missing_name, count(*) FILTER (required) AS required, any_value(types) AS types, count(tooltip) AS has_tooltips FROM x JOIN l USING (doc_id) GROUP BY doc_id""",
    "tag_inventory": f"""WITH RECURSIVE {TREE}, x AS (SELECT doc_id, node_id, page, CASE node_id % 4 WHEN 0 THEN 'InlineShape' WHEN 1 THEN 'Textbox' END AS tag FROM n WHERE node_id % 4 < 2 AND node_id % 3 <> 0)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node_id) - 1 AS INT) AS number, page, tag, CASE WHEN tag = 'Textbox' AND doc_id <> 2 THEN 'Sect' ELSE '' END AS maps_to, CASE WHEN tag = 'InlineShape' THEN 'Mark as decorative artifact' ELSE 'Add alt text or change type' END AS action FROM x""",
    "key_problems": f"""WITH {F}, g AS (SELECT doc, bool_or(rule = 'R1' AND severity = 'Error') AS a, bool_or(rule = 'R3' AND severity = 'Warning') AS b, bool_or(rule = 'R5' AND severity = 'Error') AS c, count(*) FILTER (rule = 'R3') AS n, count(*) FILTER (rule = 'R5') AS m FROM f GROUP BY doc)
      SELECT doc, nullif(concat_ws(', ', CASE WHEN a THEN 'no title' END, CASE WHEN b THEN n || ' elements without text' END, CASE WHEN c THEN m || ' fields' END), '') AS problems FROM g""",
    "file_inventory": "SELECT source, count(*) AS files, count(*) FILTER (doc_id % 7 = 0 OR doc_id % 11 = 0) AS untitled, count(*) FILTER (doc_id % 5 = 0 OR lang IS NULL) AS no_language FROM documents GROUP BY source",
    "md_repeated_links": "SELECT CAST(p_size AS BIGINT) AS doc_id, lower(p_type) AS text, count(DISTINCT p_partkey % 7) AS urls FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey % 7) > 1",
    "md_anchors": "SELECT p_partkey AS doc_id, 3 AS line_no, 'big-plan-now-2' AS anchor FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 4, 'gone' FROM part WHERE p_partkey % 2 = 1",
    "page_missing_alt": "SELECT page_id, count(*) AS n FROM pages WHERE page_id % 2 = 0 GROUP BY page_id",
    "pdf_dates": "SELECT p_partkey, ['2026-02-09 14:30', '2026-02-09', '2026-02-09', '9 Feb 2026', ''][CAST(p_partkey % 5 + 1 AS INT)] AS shown FROM part",
    "image_texts": """WITH i AS (SELECT l_suppkey AS doc_id, CAST(l_linenumber AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) - 1 AS INT) AS idx, l_partkey AS k FROM lineitem),
      d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k % 2, k % 40 ORDER BY page, idx) AS nth FROM i WHERE k % 200 >= 50), e AS (SELECT doc_id, page, idx, CASE WHEN k % 2 = 0 THEN 'image/jpeg' ELSE 'image/gif' END AS mime FROM d WHERE nth = 1),
      t AS (SELECT o_orderkey % 20 + 1 AS doc_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 + 1 END AS page, o_orderkey AS k FROM orders),
      p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS r FROM t),
      j AS (SELECT e.*, p.k FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.page = e.page AND p.r = e.idx + 1),
      q AS (SELECT *, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, idx) AS turn FROM j)
      SELECT q.doc_id, q.page, idx, mime, 'a' || coalesce(q.k, p.k) AS existing_alt FROM q LEFT JOIN p ON q.k IS NULL AND p.page IS NULL AND p.doc_id = q.doc_id AND p.r = q.turn""",
    "alt_answers": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'A & ' || p_name END AS alt, CASE WHEN p_partkey % 3 < 2 THEN 'Long  text' END AS description, p_partkey % 3 < 2 AS ok FROM part",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE | oracle_rules.oracle_sql()
