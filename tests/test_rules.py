"""One positive and one negative case per rule, on small fact tables."""

from collections import Counter

import pytest

from lectern.plans import dims, rules
from lectern.sources.schema import SCHEMAS


def names(table):
    return [f.split()[0] for f in SCHEMAS[table].replace("MAP<STRING,STRING>", "M").replace("ARRAY<STRUCT<id:STRING,text:STRING>>", "A").replace("ARRAY<STRUCT<property:STRING,text:STRING>>", "A").split(", ")]


def run(spark, scanners, **facts):
    tables = {t: spark.createDataFrame([tuple(r.get(c) for c in names(t)) for r in rows], SCHEMAS[t]) for t, rows in facts.items()}
    errors = []
    got = rules.findings(spark, tables, scanners, errors=errors)
    assert errors == []
    return [(r.doc, r.rule, r.severity, r.page, r.line, r.element, r.n) for r in got.collect()]


def by_doc(found):
    out = {}
    for d, rule, *_ in found:
        out.setdefault(d, Counter())[rule] += 1
    return out


def pdf(doc_id, **more):
    good = dict(type="pdf", access_ok=True, title="T", lang="en-GB", pages=3, tagged=True, mark_info_present=True, display_doc_title=True, viewer_prefs_present=True, outlines_present=False, acroform_present=True, tree_present=True, xmp="<pdfuaid:part>")
    return good | dict(doc_id=doc_id) | more


def grow(doc_id, *tags):
    """Nodes from (tag, depth) in preorder; keyword dicts override fields."""
    rows, stack = [], []
    for i, (tag, depth, *more) in enumerate(tags):
        stack = stack[: depth - 1]
        rows.append(dict(doc_id=doc_id, node_id=i, parent_id=stack[-1] if stack else None, ord=i, depth=depth, preorder=i, post=i, tag=tag, page=1, attrs={}, mcids=[], has_objr=False, k_null=False) | (more[0] if more else {}))
        stack.append(i)
        for s in stack:
            rows[s]["post"] = i
    return rows


def test_registry_covers_the_inventory():
    pairs = [(r.family, r.scanner, r.id) for group in rules.REGISTRY.values() for r in group]
    assert len(pairs) == len(set(pairs)) == 136
    known = {line.split("|")[0] for line in dims.RULES.strip().split("\n")}
    assert {p[2] for p in pairs} - known == {"SCAN.FILE.INACCESSIBLE"} and len(known) == 131


def test_core_clean(spark):
    nodes = grow(1, ("Document", 1), ("H1", 2, dict(mcids=[0])), ("Sect", 2), ("H2", 3, dict(mcids=[1])), ("Table", 3), ("TR", 4), ("TH", 5, dict(attrs={"Scope": "Column"}, mcids=[2])), ("L", 3), ("LI", 4), ("LBody", 5, dict(mcids=[3])), ("Figure", 3, dict(alt="A chart of sales", mcids=[4])), ("Caption", 3, dict(mcids=[5])))
    pages = [dict(doc_id=1, page=1, tabs="S", text="Some words on a page", extract_ok=True)]
    fields = [dict(doc_id=1, ord=0, name="name", ft="Tx", ff=0, tooltip="Your full name", kids_n=0)]
    assert run(spark, ("core",), doc=[pdf(1)], struct_node=nodes, pdf_page=pages, form_field=fields) == []


def test_core_faults(spark):
    docs = [pdf(1, title=" ", lang=None, tree_present=False, pages=21, viewer_prefs_present=False), pdf(2, tagged=False, lang="es-419"), pdf(3, lang="en419"), pdf(4, pages=20), pdf(5), pdf(6), pdf(7)]
    nodes = grow(2, ("Document", 1), ("H1", 2), ("H3", 2), ("Figure", 2), ("Figure", 2, dict(alt="x" * 251)), ("Figure", 2, dict(alt="IMG_0042")), ("Table", 2), ("TR", 3), ("Table", 4), ("TR", 5), ("TH", 6), ("Link", 2, dict(alt="", actual_text="click here")), ("Link", 2, dict(actual_text="Click  here")), ("Link", 2, dict(alt="https://example.org/a/very/long/path")), ("Odd", 2, dict(alt="()")), ("P", 2, dict(k_null=True)), ("L", 2), ("Span", 3), ("LI", 3), ("Art", 2), ("Caption", 2))
    nodes += grow(3, ("Document", 1), *[("P", 2)] * 11)
    nodes += grow(4, ("Table", 1), ("TR", 2), ("TD", 3))
    nodes += grow(5, ("Sect", 1), ("Sect", 2), ("Sect", 3), ("Sect", 4), ("H1", 5))
    nodes += grow(6, ("H1", 1, dict(mcids=[1])), *[("P", 1, dict(mcids=[i])) for i in range(6)], *[("Form", 1, dict(has_objr=True)) for _ in range(4)])
    nodes += grow(7, ("H1", 1, dict(mcids=[1])), *[(t, 1, dict(mcids=[1])) for t in ("P", "Form") * 4])
    fields = [dict(doc_id=2, ord=i, name=n, ft=ft, ff=ff, tooltip=t, kids_n=k) for i, (n, ft, ff, t, k) in enumerate([("a", "Tx", 0, None, 0), (" ", "Tx", 0, "Field", 0), ("a", "Tx", 0, "Age in years", 0), ("r", "Btn", 32768, "Pick one", 1), ("r", "Btn", 32768, "Pick one", 2), ("q", "Btn", 32768, "Pick one", 1)])]
    pages = [dict(doc_id=2, page=1, tabs="R", text="Name: ____________\nx", extract_ok=True), dict(doc_id=2, page=2, tabs=None, text="ab", extract_ok=True), dict(doc_id=3, page=1, tabs="S", text="", extract_ok=False)]
    found = run(spark, ("core",), doc=docs, struct_node=nodes, form_field=fields, pdf_page=pages, role_map=[dict(doc_id=2, tag="Odd", maps_to="P")])
    got = by_doc(found)
    assert got[1] == Counter(["PDFUA.TITLE", "PDFUA.LANG", "PDFUA.TAGGED", "PDFUA.BOOKMARKS", "PDFBP.DISPLAY_TITLE"])
    assert got[2] == Counter({"PDFUA.TAGGED": 1, "PDFBP.LANG_VALID": 1, "PDFUA.HEADINGS": 1, "PDFUA.IMG.ALT": 1, "PDFBP.ALT_LENGTH": 1, "PDFBP.ALT_QUALITY": 1, "PDFBP.TABLE_SCOPE": 2, "PDFBP.LINK_TEXT": 2, "PDFBP.NONSTD_NO_ALT": 1, "PDFBP.EMPTY_TAGS": 1, "PDFBP.LIST_STRUCT": 2, "PDFBP.ART_TAGS": 1, "PDFUA.FORMS": 2, "PDFBP.FORMS.DUPLICATE_NAMES": 1, "PDFBP.FORMS.RADIO_GROUP": 1, "PDFBP.FORMS.TOOLTIP_QUALITY": 1, "PDFBP.NAV.TABORDER": 2, "PDFBP.UNDERSCORE_FILL": 1, "PDFBP.TEXT.EXTRACTABLE": 1})
    assert got[3] == Counter(["PDFBP.FLAT_STRUCTURE", "PDFBP.NO_HEADINGS", "PDFBP.TEXT.EXTRACTABLE"])
    assert got[4] == Counter(["PDFBP.TABLE_HEADERS", "PDFBP.NO_HEADINGS"])
    assert got[5] == Counter(["PDFBP.SECT_NESTING"])
    assert got[6] == Counter(["PDFBP.FORMS_DETACHED"]) and 7 not in got
    severity = {(d, r): s for d, r, s, *_ in found}
    assert severity[2, "PDFBP.TEXT.EXTRACTABLE"] == "warning" and severity[3, "PDFBP.TEXT.EXTRACTABLE"] == "error"


def test_pdf_tools(spark):
    docs = [pdf(1), pdf(2, title=None, lang=None, info_lang="en", tagged=None, display_doc_title=None, xmp=None, tree_present=False, acroform_present=False), pdf(3)]
    nodes = grow(1, ("Document", 1), ("Form", 2), ("H1", 2), ("H3", 2), ("Table", 2), ("Figure", 2), ("P", 2), ("Figure", 2, dict(alt="ok")), ("Caption", 2), ("L", 2), ("LI", 3), ("L", 2), ("Odd", 2), ("Unknown", 2))
    nodes += grow(3, ("Form", 1), ("Document", 1), ("P", 2))
    fields = [dict(doc_id=1, ord=i, name=n, ft=ft, ff=ff, tooltip=t, kids_n=0) for i, (n, ft, ff, t) in enumerate([("consent", "Tx", 0, ""), ("go", "Btn", 65536, "Go"), ("age", "Tx", 2, "Age"), ("city", "Tx", 2, "City (required)"), ("g.a", "Btn", 32768, "One"), ("h.a", "Btn", 32768, "Two")])]
    tree = [dict(doc_id=1, page=1, pos=i, mcid=i) for i in range(4)] + [dict(doc_id=1, page=2, pos=i, mcid=i) for i in range(4)] + [dict(doc_id=1, page=3, pos=i, mcid=i) for i in range(2)]
    paint = [dict(doc_id=1, page=1, pos=i, mcid=3 - i) for i in range(4)] + [dict(doc_id=1, page=2, pos=i, mcid=m) for i, m in enumerate((0, 1, 3, 2))] + [dict(doc_id=1, page=3, pos=i, mcid=1 - i) for i in range(2)]
    found = run(spark, ("metadata", "tags", "forms"), doc=docs, struct_node=nodes, form_field=fields, mcid_tree=tree, mcid_paint=paint, widget=[dict(doc_id=1, page=1, ord=0, t="age"), dict(doc_id=1, page=1, ord=1, t="lost")], pdf_page=[dict(doc_id=1, page=1, tabs=None), dict(doc_id=2, page=1, tabs=None)])
    got = by_doc(found)
    assert got[1] == Counter(["PDFUA.METADATA.LANG.REVIEW", "PDFBP.LIST.CONTINUATION", "PDFQ.NONSTD.ROLE", "PDFBP.HEADING.SKIP", "PDFUA.TABLE.HEADERS", "PDFUA.IMG.ALT", "PDFBP.ORDER.FIGURE", "PDFBP.ORDER.MCID", "PDFQ.ORDER.MANUAL", "PDFBP.NAV.TABORDER", "PDFUA.FORM.TU", "PDFBP.FORMS.REQUIRED_LABEL", "PDFBP.FORMS.BUTTON_TOOLTIP", "PDFBP.FORMS.RADIO_TOOLTIP", "PDFUA.FORM.STRUCT", "PDFBP.FORM.ORPHAN"])
    assert got[2] == Counter(["PDFUA.METADATA.TITLE", "PDFUA.METADATA.LANG.REVIEW", "PDFBP.DISPLAY.DOCTITLE", "PDFUA.STRUCT.TAGGED", "PDFQ.METADATA.PDFUA", "PDFUA.STRUCT.NOTREE", "PDFBP.FORMS.NOACROFORM"])
    assert got[3] == Counter(["PDFUA.METADATA.LANG.REVIEW", "PDFUA.FORM.STRUCT", "PDFQ.ORDER.MANUAL"])
    assert [f[3] for f in found if f[1] == "PDFBP.ORDER.MCID"] == [1] and ("Error" in {f[2] for f in found if f[1] == "PDFUA.FORM.TU"})


def test_docx(spark):
    docs = [dict(doc_id=1, type="docx", access_ok=True, toc_present=False, tracked_n=2), dict(doc_id=2, type="docx", access_ok=True, title="T", lang="en", toc_present=True, tracked_n=0), dict(doc_id=3, type="docx", access_ok=True, title="T", lang="en")]
    paras = [dict(doc_id=1, ord=i, style=s, text=t) for i, (s, t) in enumerate([("Heading 2", "a"), ("Heading 3", "b"), ("Heading 2", "c"), ("Heading 1", "d"), ("Heading 4", "e"), *[("Normal", " ")] * 4, *[("Normal", "1. one")] * 2, ("Normal", "- two")])]
    paras += [dict(doc_id=2, ord=i, style=f"Heading {n}", text="x") for i, n in enumerate((1, 2, 3, 2, 3, 4))] + [dict(doc_id=3, ord=i, style="Normal", text="words") for i in range(11)]
    found = run(spark, ("docx",), doc=docs, para=paras, drawing=[dict(doc_id=1, ord=0, kind="inline", has_docpr=True), dict(doc_id=1, ord=1, kind="anchor", has_docpr=True), dict(doc_id=1, ord=2, kind="inline", descr="abc", has_docpr=True), dict(doc_id=2, ord=0, kind="inline", descr="A long text", has_docpr=True)], doc_table=[dict(doc_id=1, table_no=0, has_header=False, has_merged=True, nested_n=1), dict(doc_id=2, table_no=0, has_header=True, has_merged=False, nested_n=0)], hyperlink=[dict(doc_id=1, ord=0, container="b", text="Click here."), dict(doc_id=2, ord=0, container="b", text="Annual report")], note=[dict(doc_id=1, ord=i, kind="footnote", text="x" * (301 if i == 0 else 3)) for i in range(21)], hdrftr=[dict(doc_id=1, section=0, kind="header", linked=False, text="Draft for the board of 2024"), dict(doc_id=2, section=0, kind="footer", linked=False, text="Page 1 of 20")])
    got = by_doc(found)
    assert got[1] == Counter({"DOCX-META.TITLE": 1, "DOCX-META.LANG": 1, "DOCX-STRUCT.HEADINGSKIP": 4, "DOCX-IMG.ALT": 1, "DOCX-IMG.ALT_QUALITY": 1, "DOCX-IMG.ALT_FLOAT": 1, "DOCX-TABLE.HEADERS": 1, "DOCX-TABLE.MERGE": 1, "DOCX-TABLE.NESTED": 1, "DOCX-LINK.DESCRIPTIVE": 1, "DOCX-STRUCT.EMPTYPARA": 1, "DOCX-LIST.SEMANTIC": 1, "DOCX-STRUCT.TOC": 1, "DOCX-REVIEW.TRACKED": 1, "DOCX-STRUCT.HDRFTR": 1, "DOCX-STRUCT.FOOTNOTES": 2})
    assert 2 not in got and got[3] == Counter(["DOCX-STRUCT.HEADINGS"])


def test_xlsx(spark):
    sheet = lambda d, o, n, **m: dict(doc_id=d, ord=o, name=n, state="visible", max_row=9, max_col=2, frozen=False, merged_n=0, protected=False, hidden_rows=0, hidden_cols=0, colour_fill=False) | m
    found = run(spark, ("xlsx",), doc=[dict(doc_id=1, type="xlsx", access_ok=True), dict(doc_id=2, type="xlsx", access_ok=True, title="T")], sheet=[sheet(1, 0, "Sheet1", merged_n=2, protected=True, hidden_rows=1, colour_fill=True), sheet(1, 1, "sheet1 ", state="hidden"), sheet(2, 0, "Budget", frozen=True)], sheet_row=[dict(doc_id=1, sheet="Sheet1", row_no=i, empty_first19=True) for i in (2, 4, 6)] + [dict(doc_id=2, sheet="Budget", row_no=i, empty_first19=True) for i in (2, 4, 8)], xl_table=[dict(doc_id=1, sheet="Other", name="t", header_row_count=0), dict(doc_id=2, sheet="Budget", name="t", header_row_count=1)], hyperlink=[dict(doc_id=1, ord=0, container="Sheet1", text="HTTPS://x"), dict(doc_id=2, ord=0, container="Budget", text="Plan")], xl_drawing=[dict(doc_id=1, kind="chart", ord=0), dict(doc_id=1, kind="pic", ord=1), dict(doc_id=2, kind="chart", ord=0, descr="Sales")], validation=[dict(doc_id=1, sheet="Sheet1", ord=0), dict(doc_id=2, sheet="Budget", ord=0, prompt="A number")])
    got = by_doc(found)
    assert got[1] == Counter({"XLSX.META.TITLE": 1, "XLSX.NAV.SHEET_NAMES": 1, "XLSX.NAV.SHEET_DUP": 1, "XLSX.NAV.FREEZE_PANES": 1, "XLSX.TABLE.HEADER": 1, "XLSX.TABLE.NAMED": 1, "XLSX.LAYOUT.MERGED": 1, "XLSX.LAYOUT.SPACING": 1, "XLSX.LINKS.TEXT": 1, "XLSX.COLOR.ONLY": 1, "XLSX.CHART.ALT": 1, "XLSX.IMG.ALT": 1, "XLSX.LAYOUT.HIDDEN": 2, "XLSX.PROTECT.SHEET": 1, "XLSX.DATA.VALIDATION": 1})
    assert got[2] == Counter(["XLSX.CHART.ALT"]) and {f[2] for f in found if f[0] == 2} == {"Info"}


def test_pptx(spark):
    slide = lambda d, n, **m: dict(doc_id=d, slide_no=n, title=f"Slide {n}", has_title_shape=True, notes="said", animated=False) | m
    shape = lambda d, n, o, **m: dict(doc_id=d, slide_no=n, ord=o, shape_type=1, is_title=False, text="", left_emu=0, top_emu=0, width_emu=10, has_table=False) | m
    found = run(spark, ("pptx",), doc=[dict(doc_id=1, type="pptx", access_ok=True, slide_width_emu=100, slide_height_emu=100), dict(doc_id=2, type="pptx", access_ok=True, title="T", lang="en", slide_width_emu=100, slide_height_emu=100)], slide=[slide(1, 1, title=None, notes=""), slide(1, 2, title="Same", adv_tm="2500"), slide(1, 3, title="same ", adv_tm="x"), *[slide(1, n, animated=True) for n in range(4, 10)], slide(2, 1)], shape=[shape(1, 1, 0, text="early"), shape(1, 1, 1, is_title=True, text="t"), shape(1, 1, 2, shape_type=13), shape(1, 1, 3, shape_type=13, descr="chart"), shape(1, 1, 4, shape_type=6), shape(1, 1, 5, shape_type=13, decorative=True), shape(1, 2, 0, text="l", top_emu=50), shape(1, 2, 1, text="r", top_emu=50, left_emu=80), shape(1, 2, 2, has_table=True, first_row=False, shape_type=19), shape(2, 1, 0, is_title=True, text="Slide 1"), shape(2, 1, 1, shape_type=13, descr="A map of the town")], run_link=[dict(doc_id=1, slide_no=1, ord=0, text="Here.", url="u"), dict(doc_id=2, slide_no=1, ord=0, text="Town plan", url="u")], deck_section=[dict(doc_id=1, ord=0, name="Default Section"), dict(doc_id=1, ord=1, name="A"), dict(doc_id=1, ord=2, name="a")])
    got = by_doc(found)
    assert got[1] == Counter(["PPTX.META.TITLE", "PPTX.META.LANG", "PPTX.SLIDE.TITLE", "PPTX.SLIDE.TITLE_DUP", "PPTX.SLIDE.NOTES", "PPTX.ORDER.TITLE_FIRST", "PPTX.ORDER.COLUMNS", "PPTX.ORDER.VERIFY", "PPTX.IMG.ALT", "PPTX.IMG.ALT_QUALITY", "PPTX.TABLE.HEADER", "PPTX.MEDIA.CAPTIONS", "PPTX.SECTION.NAME", "PPTX.SECTION.DUP", "PPTX.LINKS.TEXT", "PPTX.GROUP.ALT", "PPTX.TRANSITION.AUTO", "PPTX.ANIM.EXCESSIVE"])
    assert got[2] == Counter(["PPTX.ORDER.VERIFY"]) and [f[5] for f in found if f[1] == "PPTX.TRANSITION.AUTO"] == ["2.5"]


def test_epub(spark):
    good = dict(version="3.0", unique_identifier="id", title="T", language="en", creator="C", description="D", identifiers=[("id", "x")], metas=[("schema:accessMode", "a"), ("schema:accessibilityFeature", "b"), ("schema:accessibilityHazard", "c"), ("schema:accessibilitySummary", "word " * 50)], nav_present=True, nav_types=["toc", "page-list", "landmarks"], ncx_points=0, spine_present=True, manifest_present=True)
    bad = dict(version="3.0", unique_identifier="id", identifiers=[("other", " ")], metas=[("schema:accessibilitySummary", "short"), ("rendition:layout", "pre-paginated")], nav_present=True, nav_types=[], spine_present=True, manifest_present=True)
    el = lambda d, o, tag, post=None, **m: dict(doc_id=d, content_doc="c", ord=o, post=o if post is None else post, el=tag, attrs={}, inner_text="") | m
    found = run(spark, ("epub",), epub_pkg=[good | dict(doc_id=1), bad | dict(doc_id=2), good | dict(doc_id=3, version="2.0", metas=[])], epub_item=[dict(doc_id=d, item_id="a") for d in (1, 2, 3)], epub_spine=[dict(doc_id=1, ord=0, idref="a"), dict(doc_id=2, ord=0, idref="a"), dict(doc_id=2, ord=1, idref="a"), dict(doc_id=2, ord=2, idref="z")], html_el=[el(1, 0, "img", attrs={"alt": "", "role": "presentation"}), el(1, 1, "svg", 2), el(1, 2, "title"), el(1, 3, "table", 4), el(1, 4, "th"), el(1, 5, "h2"), el(2, 0, "img"), el(2, 1, "img", attrs={"alt": " "}), el(2, 2, "svg"), el(2, 3, "math"), el(2, 4, "h1"), el(2, 5, "h3"), el(2, 6, "table"), el(2, 7, "a", inner_text=" Read more ")])
    got = by_doc(found)
    assert 1 not in got and got[3] == Counter({"EPUB-E004": 1, "EPUB-E006": 1})
    assert got[2] == Counter({"EPUB-E001": 1, "EPUB-E002": 1, "EPUB-E003": 1, "EPUB-E004": 1, "EPUB-E005": 4, "EPUB-E006": 2, "EPUB-E007": 1, "EPUB-T001": 1, "EPUB-T002": 1, "EPUB-T003": 1, "EPUB-W001": 1, "EPUB-W002": 1, "EPUB-W003": 1, "EPUB-W004": 1, "EPUB-W005": 1, "EPUB-W006": 1})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# T\n[click here](a.pdf)\n", ["MD-A11Y.LINK.AMBIGUOUS", "MD-A11Y.LINK.FILETYPE"]),
        ("# T\n```\n[click here](a.pdf)\n```\n", []),
        ("# T\n\n### x", ["MD-A11Y.HEADING.SKIP"]),
        ("# T\n![](a.png)", ["MD-A11Y.IMG.ALT_MISSING"]),
        ("# T\n\n| a | | c |\n|---|---|---|", ["MD-A11Y.TABLE.NO_DESC", "MD-A11Y.TABLE.EMPTY_HEADER"]),
        ("# T\n\nAbout it.\n\n| a | b |\n", []),
        ("# T ☀️", ["MD-A11Y.EMOJI.HEADING", "MD-A11Y.EMOJI.CONSECUTIVE"]),
        ("# A\n# B\n", ["MD-A11Y.HEADING.MULTIPLE_H1"]),
        ("## A\n", ["MD-A11Y.HEADING.NO_H1"]),
        ("# T\n[www.x.org](u) [read more about it](v) [Fine text](w)", ["MD-A11Y.LINK.BARE_URL", "MD-A11Y.LINK.AMBIGUOUS"]),
        ("# T\n![photo](a) ![cat.jpeg](b) ![A cat](c)", ["MD-A11Y.IMG.ALT_QUALITY"] * 2),
        ("# T\n\n```mermaid\nx\n```\n", ["MD-A11Y.DIAGRAM.MERMAID"]),
        ("# T\nThis shows x.\n```mermaid\nx\n```\n", []),
        ("# T\n\n+---+---+---+\n", ["MD-A11Y.DIAGRAM.ASCII"]),
        ("", []),
    ],
)
def test_markdown(spark, text, want):
    assert sorted(f[1] for f in run(spark, ("markdown",), md_text=[dict(doc_id=1, text=text)])) == sorted(want)


def test_inaccessible_and_disabled(spark):
    tables = {"doc": spark.createDataFrame([tuple(dict(doc_id=1, type="pdf", access_ok=False, skip_reason="encrypted").get(c) for c in names("doc"))], SCHEMAS["doc"])}
    got = rules.findings(spark, tables, ("scan", "core")).collect()
    assert [(r.rule, r.element) for r in got] == [("SCAN.FILE.INACCESSIBLE", "encrypted")]
    assert rules.findings(spark, tables, ("scan", "core"), disabled=("SCAN.FILE.INACCESSIBLE",)).count() == 0
    assert rules.listing(spark, "markdown").count() == 14


def test_a_broken_rule_is_reported_and_skipped(spark, monkeypatch):
    bad = rules.Rule("core", "scan", "X.BAD", "error", None, "SELECT nothing FROM nowhere")
    monkeypatch.setitem(rules.REGISTRY, "scan", [bad, *rules.REGISTRY["scan"]])
    errors = []
    got = rules.findings(spark, {}, ("scan",), errors=errors)
    assert [e[0] for e in errors] == ["X.BAD"] and got.count() == 0


def test_no_rule_gives_an_empty_result(spark):
    assert rules.findings(spark, {}, ("scan",), disabled=("SCAN.FILE.INACCESSIBLE",)).columns == rules.findings(spark, {}, ()).columns
    assert rules.findings(spark, {}, ()).count() == 0


def test_findings_feed_scores_and_reports(spark):
    from lectern.operators import analytics, scoring

    tables = {"doc": spark.createDataFrame([tuple(pdf(i, title=None).get(c) for c in names("doc")) for i in (1, 2)], SCHEMAS["doc"])}
    got = rules.findings(spark, tables, ("metadata", "core"))
    assert {r.doc: (r.errors, r.score) for r in scoring.score_documents(got).collect()} == {1: (3, 67), 2: (3, 67)}
    assert analytics.deduplicated(got).count() == got.count()
    assert {r.rule: r.files for r in analytics.by_rule(got).collect()}["PDFUA.TITLE"] == 2
    assert {r.rule: r.criterion for r in analytics.summary_table(got, dims.rule_dim(spark)).collect()}["PDFUA.TITLE"] == "2.4.2"
    assert {r.rule: r.pages for r in analytics.consolidated(got).collect()}["PDFUA.TITLE"] == "doc"
    assert {r.rule: r.fix for r in got.collect()}["PDFUA.METADATA.TITLE"] == "fix_pdf"


def test_every_rule_has_findings(spark, sf_dir):
    from lectern.queries import rule_findings

    got = rule_findings(spark, sf_dir).groupBy("scanner", "rule").count().collect()
    assert {(r.scanner, r.rule) for r in got} == {(s, r.id) for s, group in rules.REGISTRY.items() for r in group}


def test_findings_lie_on_documents_of_their_type_and_spare_some(spark, sf_dir):
    from pyspark.sql import functions as F

    from lectern import facts
    from lectern.operators.audits import ALWAYS_ON
    from lectern.queries import findings_scores, rule_findings

    doc = facts.tables(spark, sf_dir, {"doc"})["doc"]
    of = {r["type"]: r["n"] for r in doc.filter("access_ok").groupBy("type").agg(F.count("*").alias("n")).collect()}
    found = rule_findings(spark, sf_dir).join(doc.select(F.col("doc_id").alias("doc"), F.col("type").alias("own"), "access_ok"), "doc")
    assert found.filter("type <> own OR access_ok = (scanner = 'scan')").count() == 0
    rows = found.filter("scanner <> 'scan'").groupBy("scanner", "rule", "own").agg(F.count_distinct("doc").alias("docs")).collect()
    assert {r.rule for r in rows if r.docs == of[r.own]} <= set(ALWAYS_ON)
    assert {r.grade for r in findings_scores(spark, sf_dir).filter("family = 'tools'").collect()} == set("ABCDF")


def test_every_order_and_line_item_is_a_part_of_a_document_of_each_type(spark, sf_dir):
    """No part is left out of the facts, and all lie on documents that there are."""
    from lectern import facts

    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    o, n = orders.count(), lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).count()
    got = facts.tables(spark, sf_dir)
    owners = orders.select("o_custkey").distinct().count()
    assert got["struct_node"].filter("parent_id is not null").count() == o + 2 * n
    per_order = ("form_field", "widget", "pdf_page", "drawing", "doc_table", "hdrftr", "sheet", "xl_table", "validation", "xl_drawing", "slide", "run_link", "deck_section", "mcid_tree", "mcid_paint")
    assert {t: got[t].count() for t in per_order} == dict.fromkeys(per_order, o)
    assert {t: got[t].count() for t in ("para", "note", "sheet_row", "shape")} == dict.fromkeys(("para", "note", "sheet_row", "shape"), n)
    assert got["hyperlink"].count() == 2 * n and got["html_el"].count() == o + n
    assert got["md_text"].selectExpr("sum(size(split(text, '\n')))").first()[0] == n
    assert got["form_field"].select("doc_id").distinct().count() == owners
    for name, table in got.items():
        assert table.join(got["doc"].filter("access_ok"), "doc_id", "left_anti").count() == (got["doc"].filter("not access_ok").count() if name == "doc" else 0), name


def test_trimming_and_blanks_equal_the_pattern(spark):
    """Also for each white space by itself and for controls that are none."""
    from lectern.functions.text import SPACE

    texts = [None, "", "a b", " a ", " x　", "\t\n", "x\x00", *(chr(i) + "y" + chr(i) for i in (*range(1, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))]
    df = spark.createDataFrame([(t,) for t in texts] + [(chr(i),) for i in (9, 28, 0x85, 0x2003)], "t string")
    pattern = "regexp_replace(coalesce(t, ''), '^" + SPACE.replace("\\", "\\\\") + "+|" + SPACE.replace("\\", "\\\\") + "+$', '')"
    got = df.selectExpr("t", f"{rules.strip('t')} AS a", f"{pattern} AS b", f"{rules.blank('t')} AS c").collect()
    assert [r for r in got if r.a != r.b or r.c != (r.b == "")] == []


def test_conditions_of_a_shared_scan_are_compiled(spark):
    """No higher-order function around them: what is inside one is interpreted row by row."""
    spark.createDataFrame([(1, "")], "doc_id long, a string").createOrReplaceTempView("compiled_hits")
    sql = rules._fused("compiled_hits", False, [(1, rules.row("compiled_hits", rules.blank("a"))), (2, rules.row("compiled_hits", "a = 'x'"))])
    got = spark.sql(sql)
    assert [r.number for r in got.collect()] == [1]
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
