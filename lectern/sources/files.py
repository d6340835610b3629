"""Files to silver tables: discovery, routing, a first look at each file, and extraction.

Spark lists and reads the files; one small parser per format runs inside ``mapInPandas`` and gives
facts as (table, JSON row), which Spark turns into typed tables. A file that cannot be parsed gives a
``doc`` row with ``access_ok`` false and the reason, never an exception.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.sources.schema import SCHEMAS

# Names of file types and the suffixes they stand for.
ALIASES = {"pdf": "pdf", "word": "docx", "docx": "docx", "excel": "xlsx", "xlsx": "xlsx", "powerpoint": "pptx", "pptx": "pptx", "ppt": "pptx", "epub": "epub", "ebook": "epub", "markdown": "md", "md": "md"}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
XDR = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
DC = "{http://purl.org/dc/elements/1.1/}"
OPF = "{http://www.idpf.org/2007/opf}"
XHTML = "{http://www.w3.org/1999/xhtml}"
OPS = "{http://www.idpf.org/2007/ops}"
#: Columns that decide whether a row is empty.
ROW_COLUMNS = 19


def wanted_types(names: list[str] | None) -> list[str]:
    """Suffixes for the names given; unknown names are left out, and no valid one means all."""
    got = [ALIASES[n.strip(" .").lower()] for n in names or [] if n.strip(" .").lower() in ALIASES]
    return list(dict.fromkeys(got or ALIASES.values()))


def discover(spark: SparkSession, folder: str, types: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, file, type, size_bytes, modified and content of the supported files, without hidden and temporary ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    kept = files.withColumn("file", F.url_decode(F.regexp_replace(name, r"\+", "%2B"))).withColumn("type", kind).filter(F.col("type").isin(wanted_types(types)))
    hidden = F.substring("path", F.length(F.lit(folder)) + 1, F.lit(1 << 20)).rlike(r"/\.") | F.col("file").rlike(r"^(~\$|\.)|\.(tmp|bak)$") | F.col("path").rlike("/(node_modules|__pycache__)/")
    return kept.filter(~hidden).select("path", "file", "type", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def preflight(content: bytes, kind: str) -> str | None:
    """Why a file cannot be read, or None."""
    if kind == "md":
        return None
    if content[:4] == b"\xd0\xcf\x11\xe0":
        return "encrypted or legacy format"
    if kind == "pdf":
        if content[:5] != b"%PDF-":
            return "not a PDF"
        # the entry is a name of its own in a trailer or a cross-reference stream's dictionary, wherever that stands
        return "encrypted" if re.search(rb"/Encrypt(?![A-Za-z])", content) else None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return "encrypted" if "EncryptedPackage" in z.namelist() else None
    except zipfile.BadZipFile:
        return "corrupt archive"


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _core(z: zipfile.ZipFile) -> dict:
    root = _xml(z, "docProps/core.xml")
    get = lambda tag: root.findtext(DC + tag) if root is not None else None
    return {"title": get("title"), "lang": get("language"), "author": get("creator")}


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter(W + "t"))


def _docx(z: zipfile.ZipFile) -> Iterator[tuple[str, dict]]:
    body = _xml(z, "word/document.xml")
    styles = {s.get(W + "styleId"): s.find(W + "name").get(W + "val") for s in (_xml(z, "word/styles.xml") or ET.Element("x")).iter(W + "style") if s.find(W + "name") is not None}
    for i, p in enumerate(body.iter(W + "p")):
        ref = p.find(f"{W}pPr/{W}pStyle")
        name = "Normal" if ref is None else styles.get(ref.get(W + "val"), ref.get(W + "val"))
        name = re.sub(r"^heading (\d)$", r"Heading \1", name or "")
        yield "para", {"ord": i, "style": name, "text": _text(p), "has_numpr": p.find(f".//{W}numPr") is not None}
    for i, d in enumerate([*body.iter(WP + "inline"), *body.iter(WP + "anchor")]):
        pr = d.find(WP + "docPr")
        at = {} if pr is None else pr.attrib
        yield "drawing", {"ord": i, "kind": d.tag[len(WP) :], "descr": at.get("descr"), "title": at.get("title"), "has_docpr": pr is not None}
    nested = {id(t) for cell in body.iter(W + "tc") for t in cell.iter(W + "tbl")}
    for i, t in enumerate(x for x in body.iter(W + "tbl") if id(x) not in nested):
        row = t.find(W + "tr")
        named = row is not None and any(re.search("header|heading", styles.get(s.get(W + "val"), s.get(W + "val")) or "", re.I) for s in row.iter(W + "pStyle"))
        yield "doc_table", {"table_no": i, "has_header": row is not None and (row.find(f"{W}trPr/{W}tblHeader") is not None or named), "has_merged": t.find(f".//{W}gridSpan") is not None or t.find(f".//{W}vMerge") is not None, "nested_n": sum(1 for c in t.iter(W + "tc") for _ in c.iter(W + "tbl"))}
    for i, h in enumerate(body.iter(W + "hyperlink")):
        yield "hyperlink", {"ord": i, "container": "body", "text": _text(h), "url": h.get(R + "id")}
    for kind in ("footnote", "endnote"):
        for i, n in enumerate((_xml(z, f"word/{kind}s.xml") or ET.Element("x")).iter(W + kind)):
            yield "note", {"ord": i, "kind": kind, "note_type": n.get(W + "type"), "text": _text(n)}
    for i, name in enumerate(sorted(n for n in z.namelist() if re.match(r"word/(header|footer)\d*\.xml$", n))):
        yield "hdrftr", {"section": i, "kind": name[5:11], "linked": False, "text": " ".join(_text(p).strip() for p in _xml(z, name).iter(W + "p"))}
    toc = any(s.get(W + "val") == "Table of Contents" for s in body.iter(W + "docPartGallery")) or any("TOC" in (t.text or "") for t in body.iter(W + "instrText"))
    yield "doc", _core(z) | {"toc_present": toc, "tracked_n": sum(1 for tag in ("ins", "del", "moveTo") for _ in body.iter(W + tag))}


def _cell(ref: str) -> tuple[int, int]:
    letters, row = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(row), col


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    out = {}
    for r in _xml(z, f"{folder}/_rels/{name}.rels") or []:
        target, base = r.get("Target"), folder.split("/")
        if target.startswith("/"):
            target, base = target[1:], []
        while target.startswith("../"):
            target, base = target[3:], base[:-1]
        out[r.get("Id")] = "/".join([*base, target])
    return out


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple[str, dict]]:
    book, rels = _xml(z, "xl/workbook.xml"), _related(z, "xl/workbook.xml")
    strings = ["".join(t.text or "" for t in s.iter(S + "t")) for s in (_xml(z, "xl/sharedStrings.xml") or ET.Element("x")).iter(S + "si")]
    links = drawn = 0
    for i, s in enumerate(book.iter(S + "sheet")):
        part, name = rels.get(s.get(R + "id")), s.get("name")
        root = _xml(z, part) if part else None
        if root is None:
            continue
        rows, value, most = {}, {}, 0
        for c in root.iter(S + "c"):
            row, col = _cell(c.get("r"))
            v = c.findtext(S + "v") or "".join(t.text or "" for t in c.iter(S + "t"))
            if v:
                value[c.get("r")] = strings[int(v)] if c.get("t") == "s" else v
                rows[row], most = rows.get(row, False) or col <= ROW_COLUMNS, max(most, col)
        last = max(rows, default=0)
        pane, own = root.find(f".//{S}pane"), _related(z, part)
        yield "sheet", {"ord": i, "name": name, "state": s.get("state", "visible"), "max_row": last, "max_col": most, "frozen": pane is not None and pane.get("state", "").startswith("frozen"), "merged_n": sum(1 for _ in root.iter(S + "mergeCell")), "protected": root.find(S + "sheetProtection") is not None, "hidden_rows": sum(r.get("hidden") == "1" for r in root.iter(S + "row")), "hidden_cols": sum(c.get("hidden") == "1" for c in root.iter(S + "col")), "colour_fill": False}
        for r in range(1, last + 1):
            yield "sheet_row", {"sheet": name, "row_no": r, "empty_first19": not rows.get(r, False)}
        for h in root.iter(S + "hyperlink"):
            yield "hyperlink", {"ord": links, "container": name, "text": h.get("display") or value.get(h.get("ref", "").split(":")[0], ""), "url": own.get(h.get(R + "id"))}
            links += 1
        for j, v in enumerate(root.iter(S + "dataValidation")):
            yield "validation", {"sheet": name, "ord": j, "prompt_title": v.get("promptTitle"), "prompt": v.get("prompt")}
        for target in own.values():
            if "/tables/" in target:
                t = _xml(z, target)
                yield "xl_table", {"sheet": name, "name": t.get("displayName"), "header_row_count": int(t.get("headerRowCount", 1))}
            elif "/drawings/drawing" in target:
                for kind, tag in (("chart", "graphicFrame"), ("pic", "pic")):
                    for d in _xml(z, target).iter(XDR + tag):
                        yield "xl_drawing", {"kind": kind, "ord": drawn, "descr": d.find(f".//{XDR}cNvPr").get("descr")}
                        drawn += 1
    yield "doc", _core(z)


def _pptx(z: zipfile.ZipFile) -> Iterator[tuple[str, dict]]:
    deck, rels = _xml(z, "ppt/presentation.xml"), _related(z, "ppt/presentation.xml")
    kinds = {"pic": 13, "grpSp": 6, "sp": 1}
    for no, ref in enumerate(deck.iter(P + "sldId"), 1):
        part = rels[ref.get(R + "id")]
        root, own = _xml(z, part), _related(z, part)
        title, ord_ = None, 0
        for e in root.find(f"{P}cSld/{P}spTree"):
            tag = e.tag.removeprefix(P)
            if tag not in ("sp", "pic", "grpSp", "graphicFrame"):
                continue
            pr = e.find(f".//{P}cNvPr")
            ph = e.find(f".//{P}nvPr/{P}ph")
            is_title = ph is not None and ph.get("type") in ("title", "ctrTitle")
            text = "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in e.iter(A + "p")) if tag == "sp" else ""
            table = e.find(f".//{A}tbl")
            off, ext = e.find(f".//{A}off"), e.find(f".//{A}ext[@cx]")
            kind = 19 if table is not None else 3 if tag == "graphicFrame" else 16 if e.find(f".//{A}videoFile") is not None or e.find(f".//{A}audioFile") is not None else kinds[tag]
            first = table is not None and table.find(f"{A}tblPr") is not None and table.find(f"{A}tblPr").get("firstRow") == "1"
            yield "shape", {"slide_no": no, "ord": ord_, "shape_type": kind, "is_title": is_title, "name": pr.get("name"), "text": text, "descr": pr.get("descr"), "decorative": any(x.get("val") == "1" for x in pr.iter() if x.tag.endswith("}decorative")), "left_emu": int(off.get("x")) if off is not None else None, "top_emu": int(off.get("y")) if off is not None else None, "width_emu": int(ext.get("cx")) if ext is not None else None, "has_table": table is not None, "first_row": first}
            title, ord_ = (text if is_title and title is None else title), ord_ + 1
        for j, run in enumerate(root.iter(A + "r")):
            link = run.find(f"{A}rPr/{A}hlinkClick")
            if link is not None:
                yield "run_link", {"slide_no": no, "ord": j, "text": run.findtext(A + "t"), "url": own.get(link.get(R + "id"))}
        notes = next((_xml(z, t) for t in own.values() if "notesSlide" in t), None)
        step = next((x for x in root.iter(P + "transition")), None)
        yield "slide", {"slide_no": no, "title": title, "has_title_shape": title is not None, "notes": None if notes is None else " ".join(t.text or "" for t in notes.iter(A + "t")), "adv_tm": None if step is None else step.get("advTm"), "animated": root.find(f".//{P}tnLst") is not None and len(root.find(f".//{P}tnLst")) > 0}
    for i, s in enumerate(e for e in deck.iter() if e.tag.endswith("}section")):
        yield "deck_section", {"ord": i, "name": s.get("name")}
    size = deck.find(P + "sldSz")
    yield "doc", _core(z) | ({} if size is None else {"slide_width_emu": int(size.get("cx")), "slide_height_emu": int(size.get("cy"))})


class _Elements(HTMLParser):
    """Elements of an HTML text in order, each with the last element of its subtree."""

    EMPTY = {"img", "br", "hr", "meta", "link", "input", "area", "col", "source", "wbr", "embed", "base", "track", "param"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        i = len(self.rows)
        self.rows.append({"ord": i, "parent_ord": self.open[-1] if self.open else None, "post": i, "el": tag, "attrs": {k: v or "" for k, v in attrs}, "inner_text": ""})
        if tag not in self.EMPTY:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] == len(self.rows) - 1:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]]["el"] == tag:
                for i in self.open[depth:]:
                    self.rows[i]["post"] = len(self.rows) - 1
                del self.open[depth:]
                return

    def handle_data(self, data):
        for i in self.open:
            if self.rows[i]["el"] in ("a", "title", "h1", "h2", "h3", "h4", "h5", "h6", "th", "caption"):
                self.rows[i]["inner_text"] += data


def html_elements(html: str) -> list[dict]:
    parser = _Elements()
    parser.feed(html or "")
    for i in parser.open:
        parser.rows[i]["post"] = len(parser.rows) - 1
    return parser.rows


def _epub(z: zipfile.ZipFile) -> Iterator[tuple[str, dict]]:
    container = ET.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if e.tag.endswith("}rootfile"))
    pkg, folder = ET.fromstring(z.read(opf)), opf.rpartition("/")[0]
    place = lambda href: f"{folder}/{href}" if folder else href
    items = {i.get("id"): i for i in pkg.iter(OPF + "item")}
    spine = [r.get("idref") for r in pkg.iter(OPF + "itemref")]
    nav = next((place(i.get("href")) for i in items.values() if "nav" in (i.get("properties") or "").split()), None)
    root = _xml(z, nav) if nav else None
    ncx = next((place(i.get("href")) for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    points = _xml(z, ncx) if ncx else None
    yield "epub_pkg", {"version": pkg.get("version"), "unique_identifier": pkg.get("unique-identifier"), "title": pkg.findtext(f".//{DC}title"), "language": pkg.findtext(f".//{DC}language"), "creator": pkg.findtext(f".//{DC}creator"), "description": pkg.findtext(f".//{DC}description"), "identifiers": [{"id": i.get("id"), "text": i.text} for i in pkg.iter(DC + "identifier")], "metas": [{"property": m.get("property") or m.get("name"), "text": m.text or m.get("content")} for m in pkg.iter(OPF + "meta")], "nav_present": root is not None, "nav_types": [] if root is None else [n.get(OPS + "type") for n in root.iter(XHTML + "nav") if n.get(OPS + "type")], "ncx_points": 0 if points is None else sum(1 for e in points.iter() if e.tag.endswith("}navPoint")), "spine_present": pkg.find(OPF + "spine") is not None, "manifest_present": pkg.find(OPF + "manifest") is not None}
    for key, i in items.items():
        yield "epub_item", {"item_id": key, "href": i.get("href"), "media_type": i.get("media-type"), "properties": i.get("properties"), "part": place(i.get("href")) if i.get("href") else None}
    for i, ref in enumerate(spine):
        yield "epub_spine", {"ord": i, "idref": ref}
    for ref in (r for r in dict.fromkeys(spine) if r in items):
        name = place(items[ref].get("href"))
        if name in z.namelist():
            for row in html_elements(z.read(name).decode("utf-8", "replace")):
                yield "html_el", {"content_doc": name} | row
    yield "doc", {"title": pkg.findtext(f".//{DC}title"), "lang": pkg.findtext(f".//{DC}language")}


_PARSERS = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "epub": _epub}


def facts_of(doc_id: int, path: str, file: str, kind: str, content: bytes) -> Iterator[tuple[str, dict]]:
    about = {"path": path, "file": file, "type": kind, "size_bytes": len(content)}
    reason = preflight(content, kind)
    rows: list[tuple[str, dict]] = []
    if reason is None:
        try:
            if kind in _PARSERS:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = list(_PARSERS[kind](z))
            elif kind == "md":
                rows = [("md_text", {"text": content.decode("utf-8", "replace")})]
        except Exception as error:  # a broken file must not stop the scan
            reason, rows = f"{type(error).__name__}: {error}", []
    own = next((r for t, r in rows if t == "doc"), {})
    yield "doc", about | own | {"access_ok": reason is None, "skip_reason": reason, "doc_id": doc_id}
    for table, row in rows:
        if table != "doc":
            yield table, row | {"doc_id": doc_id}


def extract(files: DataFrame) -> DataFrame:
    """(table, row as JSON) of discovered files; store it before reading several tables from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                got = [(t, json.dumps(x)) for t, x in facts_of(r.doc_id, r.path, r.file, r.type, r.content)]
                yield pd.DataFrame(got, columns=["table", "row"])

    known = files.select(F.xxhash64("path").alias("doc_id"), "path", "file", "type", "content")
    return known.mapInPandas(run, "table string, row string")


def silver(facts: DataFrame) -> dict[str, DataFrame]:
    """Typed tables from stored facts."""
    return {name: facts.filter(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*") for name, schema in SCHEMAS.items()}


def store_facts(files: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Facts of discovered files as typed Parquet tables in ``folder``, and readers of them.

    Each file is parsed once, into rows partitioned by table; a table is then made from its own
    partition, so no table's rows are read for another. Images of archives do not pass through JSON: the
    archives are read once more for them.
    """
    mixed = f"{folder}/mixed"
    extract(files).write.partitionBy("table").parquet(mixed)
    spark = files.sparkSession
    raw = spark.read.schema("row string, table string").parquet(mixed)
    from lectern.sources.archive_images import extract_images  # it builds on this module

    for name, df in (silver(raw) | {"image": extract_images(files).select(*spark.createDataFrame([], SCHEMAS["image"]).columns)}).items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def page_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Elements of raw web pages, as the ``html_el`` table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 100):
                rows = [{"doc_id": key, "content_doc": ""} | r for key, html in batch.iloc[low : low + 100].itertuples(index=False) for r in html_elements(html)]
                yield pd.DataFrame(rows, columns=["doc_id", "content_doc", "ord", "parent_ord", "post", "el", "attrs", "inner_text"]).astype({"parent_ord": "Int32"})

    return pages.select(F.col(id_col).cast("long"), html_col).mapInPandas(run, SCHEMAS["html_el"])


# clause/test of the validator | rule | criterion | severity.
CLAUSES = (
    ("7.1/1", "PDFUA.TAGGED", "1.3.1", "error"),
    ("7.1/2", "PDFUA.TAGGED", "1.3.1", "error"),
    ("7.2/1", "PDFUA.LANG", "3.1.1", "error"),
    ("7.21/1", "PDFUA.TITLE", "2.4.2", "error"),
    ("7.21/2", "PDFBP.DISPLAY_TITLE", "2.4.2", "warning"),
    ("7.3/1", "PDFUA.TAGGED", "1.3.1", "error"),
    ("7.4.4/1", "PDFUA.HEADINGS", "2.4.6", "warning"),
    ("7.3/2", "PDFUA.IMG.ALT", "1.1.1", "error"),
    ("7.18.1/1", "PDFUA.IMG.ALT", "1.1.1", "error"),
    ("7.5/1", "PDFBP.TABLE_HEADERS", "1.3.1", "warning"),
    ("7.5/2", "PDFBP.TABLE_SCOPE", "1.3.1", "warning"),
    ("7.18.3/1", "PDFUA.FORMS", "4.1.2", "error"),
    ("7.18.3/2", "PDFUA.FORMS", "4.1.2", "error"),
    ("7.11/1", "PDFUA.BOOKMARKS", "2.4.1", "warning"),
    ("7.18/1", "PDFUA.ANNOT", "4.1.2", "error"),
    ("7.18.5/1", "PDFUA.LINK", "2.4.4", "error"),
    ("7.2/2", "PDFBP.READING_ORDER", "1.3.2", "warning"),
    ("7.7/1", "PDFUA.CONTRAST", "1.4.3", "warning"),
)


def mapped_clauses(checks: DataFrame) -> DataFrame:
    """Failed checks (clause, test, description, element, page, ...) as findings: known clauses take our rule, criterion
    and severity with high confidence, the others are ``VERAPDF.clause.test``, a warning of medium confidence."""
    known = checks.sparkSession.createDataFrame(CLAUSES, "key string, known_rule string, known_wcag string, known_severity string")
    joined = checks.withColumn("key", F.concat_ws("/", "clause", "test")).join(F.broadcast(known), "key", "left")  # 18 rows
    ours = F.col("known_rule").isNotNull()
    named = {
        "rule": F.coalesce("known_rule", F.concat_ws(".", F.lit("VERAPDF"), "clause", "test")),
        "severity": F.coalesce("known_severity", F.lit("warning")),
        "wcag": F.coalesce("known_wcag", F.lit("")),
        "confidence": F.when(ours, "high").otherwise("medium"),
        "message": F.when(ours, F.col("known_rule")).otherwise(F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.concat(F.lit("rule "), "key", F.lit(" failed")))),
    }
    return joined.withColumns(named).drop("key", "known_rule", "known_wcag", "known_severity")


def validator_findings(spark: SparkSession, path: str) -> DataFrame:
    """One finding per failed check of saved XML validation reports; a report without valid XML is a ``TOOL.VERAPDF`` error.

    The page is the check's own, else that of its ``pages``, else the first number after ``page`` in its context.
    """
    check = "array<struct<_status:string,_page:string,pages:string,context:string>>"
    reports = spark.read.format("xml").option("rowTag", "rule").schema(f"_clause string, _testNumber string, _status string, description string, check {check}").load(path).withColumn("file", F.col("_metadata.file_path"))
    failed = reports.filter("_status = 'failed'").select("file", F.col("_clause").alias("clause"), F.col("_testNumber").alias("test"), "description", F.explode("check").alias("c")).filter("c._status = 'failed'")
    named = F.regexp_extract(F.coalesce("c.context", F.lit("")), r"[Pp]age\s*\[?(\d+)", 1)
    page = F.coalesce(F.expr("try_cast(c._page as int)"), F.expr("try_cast(trim(c.pages) as int)"), F.nullif(named, F.lit("")).try_cast("int"))
    checks = failed.select("file", "clause", "test", "description", F.nullif(F.trim("c.context"), F.lit("")).alias("element"), page.alias("page"))
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    broken = whole.filter(~F.col("text").rlike(r"(?s)^\s*<.*>\s*$"))
    bad = broken.select("file", F.lit(None).cast("string").alias("clause"), F.lit(None).cast("string").alias("test"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("element"), F.lit(None).cast("int").alias("page"), F.lit("TOOL.VERAPDF").alias("rule"), F.lit("error").alias("severity"), F.lit("").alias("wcag"), F.lit("high").alias("confidence"), F.lit("the report is not XML").alias("message"))
    return mapped_clauses(checks).unionByName(bad)
