"""Images taken out of small archives made here, against what was put in."""

import io
import struct
import zipfile
import zlib

import pytest

from lectern.operators import images
from lectern.sources import archive_images, files
from lectern.sources.schema import SCHEMAS
from test_sources import A, P, R, REL, S, W

WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
XDR = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"


def png(wide, high, mark=b""):
    head = struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head)) + mark


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 70, 90) + b"\x01\x01\x11\x00"
GIF = b"GIF89a" + struct.pack("<HH", 60, 61) + b"\x00"


def rels(**targets):
    return f'<Relationships xmlns="{REL}">' + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def drawing(rid, alt=""):
    return f'<w:drawing><wp:inline><wp:docPr id="1" name="Pic {rid}" descr="{alt}"/><a:graphic><a:blip r:embed="{rid}"/></a:graphic></wp:inline></w:drawing>'


def docx():
    text = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = f"<w:p>{text('far')}{text('before')}<w:r>{drawing('a', ' Old text ')}</w:r>{text('after')}{text('far')}</w:p><w:tbl><w:tr><w:tc><w:p><w:r>{drawing('b')}<w:t>own</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body += "".join(f"<w:p><w:r>{drawing(x)}</w:r></w:p>" for x in ("c", "gone", "nowhere", "d"))
    return pack({"word/document.xml": f'<w:document xmlns:w="{W}" xmlns:wp="{WP}" xmlns:a="{A}" xmlns:r="{R}"><w:body>{body}</w:body></w:document>', "word/_rels/document.xml.rels": rels(a="media/1.png", b="../word/media/2.JPG", c="media/copy.png", gone="media/none.png", d="/media/3.emf"), "word/media/1.png": png(50, 60), "word/media/2.JPG": JPEG, "word/media/copy.png": png(50, 60), "media/3.emf": b"EMF", "word/media/unused.png": png(1, 1)})


def pptx():
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="1" name="{0}" descr="{1}"/></p:nvPicPr><p:blipFill><a:blip r:embed="x"/></p:blipFill></p:pic>'
    slide = lambda inner: f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>Two </a:t></a:r><a:r><a:t>words</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>more</a:t></a:r></a:p></p:txBody></p:sp>"
    return pack({"ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="s2"/><p:sldId id="2" r:id="s1"/><p:sldId id="3" r:id="no"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(s1="slides/a.xml", s2="slides/b.xml"), "ppt/slides/a.xml": slide(pic.format("last", "")), "ppt/slides/b.xml": slide(pic.format("first", "Alt") + shape + f"<p:grpSp>{pic.format('in a group', '')}</p:grpSp>"), "ppt/slides/_rels/a.xml.rels": rels(x="../media/g.gif"), "ppt/slides/_rels/b.xml.rels": rels(x="../media/p.png"), "ppt/media/g.gif": GIF, "ppt/media/p.png": png(7, 8)})


def xlsx():
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>4</v></c><c r="AA1"><v>9</v></c></row><row r="11"><c r="A11"><v>7</v></c></row>'
    pic = lambda rid, alt: f'<xdr:pic><xdr:nvPicPr><xdr:cNvPr id="1" name="P" {alt}/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="{rid}"/></xdr:blipFill></xdr:pic>'
    return pack({"xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="Costs" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(r1="worksheets/s.xml"), "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>hello</t></si></sst>', "xl/worksheets/s.xml": f'<worksheet xmlns="{S}" xmlns:r="{R}"><sheetData>{cells}</sheetData><drawing r:id="d"/></worksheet>', "xl/worksheets/_rels/s.xml.rels": rels(d="../drawings/drawing1.xml"), "xl/drawings/drawing1.xml": f'<xdr:wsDr xmlns:xdr="{XDR}" xmlns:a="{A}" xmlns:r="{R}">{pic("i", "")}{pic("j", chr(100) + "escr=" + chr(34) + "Chart" + chr(34))}</xdr:wsDr>', "xl/drawings/_rels/drawing1.xml.rels": rels(i="../media/odd.bin", j="../media/j.png"), "xl/media/odd.bin": JPEG, "xl/media/j.png": png(3, 4)})


def epub():
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c" href="text/c%201.xhtml"/><item id="d" href="d.xhtml"/></manifest><spine><itemref idref="d"/><itemref idref="c"/><itemref idref="lost"/></spine></package>'
    return pack({"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": opf, "o/text/c 1.xhtml": "<html><body><p>Not &nbsp; closed<img src='../img/a.png' alt=' A map '><img src='http://x.org/b.png'><img src='img/w.webp'></body></html>", "o/d.xhtml": "<html><body><img src='img/a.png#x'/><img src='none.png'/><img/></body></html>", "o/img/a.png": png(9, 9), "o/img/w.webp": b"RIFF"})


EXPECTED = {
    "a.docx": [(0, None, "image/png", 50, 60, "Old text", "before after", "Pic a", None), (1, None, "image/jpeg", 90, 70, None, "own", "Pic b", None), (2, None, "image/x-emf", None, None, None, "", "Pic d", None)],
    "b.pptx": [(0, 1, "image/png", 7, 8, "Alt", "Two words more", "first", None), (1, 2, "image/gif", 60, 61, None, "", "last", None)],
    "c.xlsx": [(0, None, "image/jpeg", 90, 70, None, "hello | 4", "P", "Costs"), (1, None, "image/png", 3, 4, "Chart", "hello | 4", "P", "Costs")],
    "d.epub": [(0, None, "image/png", 9, 9, None, "", "a.png", "o/d.xhtml"), (1, None, "image/webp", None, None, None, "Not   closed", "w.webp", "o/text/c 1.xhtml")],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    for name, make in (("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.epub", epub)):
        (top / name).write_bytes(make())
    (top / "empty.docx").write_bytes(b"")
    (top / "broken.epub").write_bytes(epub()[:200])
    (top / "other.xlsx").write_bytes(pack({"x": "y"}))
    (top / "bad.pptx").write_bytes(pack({"ppt/presentation.xml": "<p"}))
    (top / "t.md").write_text("![a](b.png)")
    return f"file://{top}"


def test_images_of_all_archives(spark, folder):
    found = files.discover(spark, folder).withColumn("mime", files.F.lit("clash"))
    ids = {r.doc_id: r.file for r in found.select(files.F.xxhash64("path").alias("doc_id"), "file").collect()}
    got = {}
    for r in sorted(archive_images.extract_images(found).collect(), key=lambda r: (r.doc_id, r.image_id)):
        got.setdefault(ids[r.doc_id], []).append((r.image_id, r.page, r.mime, r.width, r.height, r.existing_alt, r.context, r.name, r.place))
    assert got == EXPECTED


def test_the_image_table_is_stored_with_the_other_facts(spark, folder, tmp_path):
    tables = files.store_facts(files.discover(spark, folder), f"{tmp_path}/facts")
    assert tables["image"].schema == spark.createDataFrame([], SCHEMAS["image"]).schema
    assert tables["image"].count() == sum(len(v) for v in EXPECTED.values())
    described = images.to_describe(tables["image"].withColumnRenamed("image_id", "idx"))
    assert described.count() == 4  # a.docx: two, b.pptx and c.xlsx: one of at least 50 pixels each way


def test_odd_archives_and_many_images(spark):
    assert [len(list(archive_images.images_of(1, k, b))) for k, b in (("docx", b""), ("pptx", b"PK"), ("epub", docx()), ("docx", epub()))] == [0, 0, 0, 0]
    assert archive_images.extract_images(spark.createDataFrame([("p", "docx", None), (None, "md", b"x"), ("p", None, b"x")], "path string, type string, content binary")).count() == 0
    assert archive_images.extract_images(spark.createDataFrame([], "path string, type string, content binary")).count() == 0
    n, big = 30, bytes(1 << 19)
    parts = {"word/document.xml": f'<w:document xmlns:w="{W}" xmlns:wp="{WP}" xmlns:a="{A}" xmlns:r="{R}"><w:body>' + "".join(f"<w:p><w:r>{drawing(f'i{k}')}</w:r></w:p>" for k in range(n)) + "</w:body></w:document>", "word/_rels/document.xml.rels": rels(**{f"i{k}": f"media/{k}.png" for k in range(n)})}
    parts |= {f"word/media/{k}.png": png(k + 1, 2, big) for k in range(n)}
    rows = spark.createDataFrame([("p", "docx", pack(parts)), ("p", "docx", pack(parts))], "path string, type string, content binary")
    got = archive_images.extract_images(rows).select("width", files.F.length("content").alias("n")).collect()
    assert sorted(r.width for r in got) == sorted(2 * list(range(1, n + 1))) and {r.n for r in got} == {33 + len(big)}
