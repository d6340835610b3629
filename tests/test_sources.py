"""Small files of each format, made here, through discovery, extraction and rules."""

import zipfile

import pytest

from lectern.plans import rules
from lectern.sources import files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{}</dc:title><dc:language>en</dc:language></cp:coreProperties>'


def pack(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "sub").mkdir()
    (top / ".git").mkdir()
    para = '<w:p><w:pPr><w:pStyle w:val="H{0}"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
    pack(top / "a.docx", {"docProps/core.xml": CORE.format("Doc"), "word/styles.xml": f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H3"><w:name w:val="heading 3"/></w:style></w:styles>', "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{para.format(1)}{para.format(3)}<w:hyperlink r:id="x"><w:r><w:t>click here</w:t></w:r></w:hyperlink><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:ins/></w:body></w:document>'})
    pack(top / "sub" / "b.xlsx", {"docProps/core.xml": CORE.format(""), "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="Sheet1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{REL}"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>hello</t></si></sst>', "xl/worksheets/s.xml": f'<worksheet xmlns="{S}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3" hidden="1"><c r="B3"><v>4</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'})
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree><p:pic><p:nvPicPr><p:cNvPr id="1" name="pic"/></p:nvPicPr></p:pic><p:sp><p:nvSpPr><p:cNvPr id="2" name="t"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld><p:transition advTm="2500"/></p:sld>'
    pack(top / "c.pptx", {"docProps/core.xml": CORE.format("Deck"), "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst><p:sldSz cx="100" cy="100"/></p:presentation>', "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{REL}"><Relationship Id="r1" Target="slides/s.xml"/></Relationships>', "ppt/slides/s.xml": slide})
    opf = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="3.0" unique-identifier="i"><metadata><dc:title>Book</dc:title><dc:identifier id="i">x</dc:identifier></metadata><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="c"/></spine></package>'
    pack(top / "d.epub", {"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": opf, "o/c.xhtml": "<html><body><!-- note --><h1>A</h1><h3>B</h3><img src='x'/><a href='y'>here</a></body></html>"})
    (top / "e.md").write_text("# T\n\n### x\n")
    (top / "f.pdf").write_bytes(b"not a pdf")
    (top / "g.docx").write_bytes(b"\xd0\xcf\x11\xe0rest")
    (top / "~$a.docx").write_bytes(b"lock")
    (top / ".git" / "h.md").write_text("# no")
    (top / "i.txt").write_text("no")
    return f"file://{top}"


def test_scan_of_a_folder(spark, folder, tmp_path):
    found = files.discover(spark, folder)
    assert sorted(r.file for r in found.select("file").collect()) == ["a.docx", "b.xlsx", "c.pptx", "d.epub", "e.md", "f.pdf", "g.docx"]
    tables = files.store_facts(found, f"{tmp_path}/facts")
    docs = {r.doc_id: r for r in tables["doc"].collect()}
    assert sorted(d.file for d in docs.values() if not d.access_ok) == ["f.pdf", "g.docx"]
    got = {}
    for r in rules.findings(spark, tables).collect():
        got.setdefault(docs[r.doc].file, []).append(r.rule)
    assert {k: sorted(v) for k, v in got.items()} == {
        "a.docx": ["DOCX-LINK.DESCRIPTIVE", "DOCX-REVIEW.TRACKED", "DOCX-STRUCT.HEADINGSKIP", "DOCX-TABLE.HEADERS"],
        "b.xlsx": ["XLSX.LAYOUT.HIDDEN", "XLSX.LAYOUT.MERGED", "XLSX.META.TITLE", "XLSX.NAV.FREEZE_PANES", "XLSX.NAV.SHEET_NAMES", "XLSX.TABLE.NAMED"],
        "c.pptx": ["PPTX.IMG.ALT", "PPTX.ORDER.VERIFY", "PPTX.SLIDE.NOTES", "PPTX.TRANSITION.AUTO"],
        "d.epub": ["EPUB-E003", "EPUB-E004", "EPUB-E005", "EPUB-E006", "EPUB-E007", "EPUB-T002", "EPUB-T003", "EPUB-W003", "EPUB-W005"],
        "e.md": ["MD-A11Y.HEADING.SKIP"],
        "f.pdf": ["SCAN.FILE.INACCESSIBLE"],
        "g.docx": ["SCAN.FILE.INACCESSIBLE"],
    }


def test_types_and_depth(spark, folder):
    assert files.wanted_types(["Word", ".MD", "nonsense"]) == ["docx", "md"] and files.wanted_types(["x"]) == ["pdf", "docx", "xlsx", "pptx", "epub", "md"]
    assert sorted(r.file for r in files.discover(spark, folder, ["excel", "md"]).collect()) == ["b.xlsx", "e.md"]
    assert [r.file for r in files.discover(spark, folder, ["excel", "md"], recursive=False).collect()] == ["e.md"]


def test_validator_report(spark, tmp_path):
    head, tail = "<report><jobs><job><validationReport><details>", "</details></validationReport></job></jobs></report>"
    check = '<check status="failed"><context>{}</context></check>'
    rows = {
        "known.xml": head + '<rule clause="7.21" testNumber="1" status="failed"><description>Missing title</description>' + check.format("Page[1]") + '<check status="passed"/></rule>' + tail,
        "other.xml": head + '<rule clause="99.99" testNumber="1" status="failed"><description>Unknown rule</description>' + check.format("somewhere") + '<check status="failed" page="7"><context>x</context></check></rule><rule clause="7.1" testNumber="1" status="passed"/>' + tail,
        "empty.xml": head + tail,
        "broken.xml": "not xml at all",
    }
    for name, text in rows.items():
        (tmp_path / name).write_text(text)
    rows = [(r.file.rsplit("/", 1)[-1], r.rule, r.wcag, r.severity, r.confidence, r.page) for r in files.validator_findings(spark, str(tmp_path / "*.xml")).collect()]
    got = sorted(rows, key=lambda r: (r[0], r[5] is None))
    assert got == [
        ("broken.xml", "TOOL.VERAPDF", "", "error", "high", None),
        ("known.xml", "PDFUA.TITLE", "2.4.2", "error", "high", 1),
        ("other.xml", "VERAPDF.99.99.1", "", "warning", "medium", 7),
        ("other.xml", "VERAPDF.99.99.1", "", "warning", "medium", None),
    ]


def test_an_encrypted_pdf_is_seen_wherever_its_entry_stands():
    body = b"%PDF-1.7\n" + b"x" * 9000
    assert files.preflight(body, "pdf") is None and files.preflight(b"no", "pdf") == "not a PDF"
    assert files.preflight(b"%PDF-1.7\ntrailer << /Encrypt 5 0 R >>" + b"x" * 9000, "pdf") == "encrypted"
    assert files.preflight(body + b"/EncryptMetadata true", "pdf") is None

