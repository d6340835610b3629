"""Images inside office and book archives, as the ``image`` table.

Each archive is opened in the task that holds it. From the package's root part its relationships (or the
book's reading order) lead to the parts that show pictures, and only the members these name are
unpacked; one image at a time is in memory besides its archive. A broken archive, part or member gives
no rows, never an exception: the scan of the same file reports it.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lectern.sources.files import A, OPF, P, R, S, W, WP, XDR, _related, _xml
from lectern.sources.schema import SCHEMAS

# Image types by suffix and by first bytes; what neither tells is a PNG.
SUFFIXES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff", ".emf": "image/x-emf", ".wmf": "image/x-wmf", ".svg": "image/svg+xml", ".webp": "image/webp"}
MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"))
#: Code points of text around an image that are kept with it; the rest stays in the text tables.
CONTEXT = 500
#: Bytes of images that are sent on together.
BATCH = 4 << 20

SCHEMA = SCHEMAS["image"] + ", name STRING, place STRING"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def size_of(data: bytes) -> tuple[int | None, int | None]:
    """Width and height in pixels from the head of a PNG, GIF, BMP or JPEG file; (None, None) for others."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            wide, high = struct.unpack("<ii", data[18:26])
            return wide, abs(high)
        at = 2
        while data[:2] == b"\xff\xd8" and data[at] == 0xFF:
            mark, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame header
                high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
                return wide, high
            at += 2 + length
    except (struct.error, IndexError):
        pass
    return None, None


def _by_suffix(name: str) -> str:
    return SUFFIXES.get(posixpath.splitext(name)[1].lower(), "image/png")


def _by_start(data: bytes) -> str:
    return next((kind for magic, kind in MAGIC if data.startswith(magic)), "image/png")


#: What a walk gives of a picture: page, place, name, text of its own, context, and the members it may be.
Shown = tuple[int | None, str | None, str | None, str | None, str, list[str]]


def _docx(z: zipfile.ZipFile) -> Iterator[Shown]:
    """Drawings of the body; the context is the run that holds one and the elements before and after it."""
    root, rels = _xml(z, "word/document.xml"), _related(z, "word/document.xml")
    said = lambda e: [t.text for t in e.iter(W + "t") if t.text]
    stack = [(root, None, 0)]
    while stack:
        e, above, at = stack.pop()
        for k, child in reversed(list(enumerate(e))):
            if child.tag != W + "drawing":
                stack.append((child, e, k))
        for d in (c for c in e if c.tag == W + "drawing"):
            blip, near = d.find(f".//{A}blip"), said(e)
            if above is not None:
                for k in (at - 1, at + 1):
                    if 0 <= k < len(above):
                        near += said(above[k])
            for pr in d.iter(WP + "docPr"):
                if blip is not None and blip.get(R + "embed") in rels:
                    yield None, None, pr.get("name", "Image"), pr.get("descr"), " ".join(near), [rels[blip.get(R + "embed")]]


def _pptx(z: zipfile.ZipFile) -> Iterator[Shown]:
    """Pictures that stand on a slide by themselves; the context is the text of the slide's shapes."""
    deck, rels = _xml(z, "ppt/presentation.xml"), _related(z, "ppt/presentation.xml")
    for no, ref in enumerate(deck.iter(P + "sldId"), 1):
        part = rels.get(ref.get(R + "id"))
        root = _xml(z, part) if part else None
        tree = None if root is None else root.find(f"{P}cSld/{P}spTree")
        if tree is None:
            continue
        own = _related(z, part)
        lines = ("".join(t.text or "" for t in p.iter(A + "t")).strip() for s in tree.findall(P + "sp") for p in s.iter(A + "p"))
        near = " ".join(x for x in lines if x)
        for pic in tree.findall(P + "pic"):
            pr, blip = pic.find(f"{P}nvPicPr/{P}cNvPr"), pic.find(f".//{A}blip")
            if pr is not None and blip is not None and blip.get(R + "embed") in own:
                yield no, None, pr.get("name"), pr.get("descr"), near, [own[blip.get(R + "embed")]]


def _first_cells(root, strings: list[str]) -> str:
    """The first 20 values of a sheet's first ten rows and columns."""
    got = []
    for c in root.iter(S + "c"):
        letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r", "ZZ99")).groups()
        if int(row) > 10:
            break
        v = c.findtext(S + "v")
        v = "".join(t.text or "" for t in c.iter(S + "t")) if v is None else strings[int(v)] if c.get("t") == "s" else v
        if v and len(letters) == 1 and letters <= "J" and len(got) < 20:
            got.append(v)
    return " | ".join(got)


def _xlsx(z: zipfile.ZipFile) -> Iterator[Shown]:
    """Pictures of the sheets' drawings; the context is the head of the sheet, which is the place."""
    book, rels = _xml(z, "xl/workbook.xml"), _related(z, "xl/workbook.xml")
    shared = _xml(z, "xl/sharedStrings.xml")
    strings = [] if shared is None else ["".join(t.text or "" for t in s.iter(S + "t")) for s in shared.iter(S + "si")]
    for s in book.iter(S + "sheet"):
        part = rels.get(s.get(R + "id"))
        root = _xml(z, part) if part else None
        if root is None:
            continue
        own, near = _related(z, part), None
        for d in root.iter(S + "drawing"):
            drawing = own.get(d.get(R + "id"))
            shapes = _xml(z, drawing) if drawing else None
            targets = _related(z, drawing) if shapes is not None else {}
            for pic in () if shapes is None else shapes.iter(XDR + "pic"):
                pr, blip = pic.find(f".//{XDR}cNvPr"), pic.find(f".//{A}blip")
                if blip is not None and blip.get(R + "embed") in targets:
                    near = _first_cells(root, strings) if near is None else near
                    at = {} if pr is None else pr.attrib
                    yield None, s.get("name"), at.get("name"), at.get("descr"), near, [targets[blip.get(R + "embed")]]


class _Page(HTMLParser):
    """Texts and images of a content document, well formed or not."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.images = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.images.append(dict(attrs))

    def handle_data(self, data):
        self.texts += [data.strip()] if data.strip() else []


def _epub(z: zipfile.ZipFile) -> Iterator[Shown]:
    """``img`` elements in reading order; the context is their content document's text, the place its name."""
    container = ET.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if e.tag.endswith("}rootfile"))
    pkg, folder = ET.fromstring(z.read(opf)), posixpath.dirname(opf)
    at = lambda base, href: posixpath.normpath(posixpath.join(base, unquote(href.partition("#")[0])))
    href = {i.get("id"): i.get("href") for i in pkg.iter(OPF + "item") if i.get("href")}
    there = set(z.namelist())
    for ref in pkg.iter(OPF + "itemref"):
        name = at(folder, href[ref.get("idref")]) if ref.get("idref") in href else None
        if name not in there:
            continue
        page = _Page()
        page.feed(z.read(name).decode("utf-8", "replace"))
        page.close()
        near = " ".join(page.texts)
        for i in page.images:
            src = i.get("src")
            if src and not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", src):
                yield None, name, posixpath.basename(at("", src)), i.get("alt"), near, [at(posixpath.dirname(name), src), at(folder, src)]


_WALKS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "epub": _epub}


def images_of(doc_id: int, kind: str, content: bytes) -> Iterator[dict]:
    """Images of one archive in order of their places, equal ones once; ``image_id`` counts them from 0."""
    seen: set[bytes] = set()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for page, place, name, alt, near, members in _WALKS[kind](z):
                member = next((m for m in members if m in z.NameToInfo), None)
                try:
                    data = z.read(member) if member else b""
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, ValueError, EOFError):
                    continue  # this member cannot be unpacked, others may
                digest = hashlib.sha256(data).digest()
                if not data or digest in seen:
                    continue
                seen.add(digest)
                wide, high = size_of(data)
                mime = _by_start(data) if kind == "xlsx" else _by_suffix(member)
                yield {"doc_id": doc_id, "image_id": len(seen) - 1, "page": page, "mime": mime, "width": wide, "height": high, "content": data, "existing_alt": (alt or "").strip() or None, "context": near[:CONTEXT], "name": name, "place": place}
    except (zipfile.BadZipFile, ET.ParseError, AttributeError, KeyError, StopIteration, RuntimeError, TypeError, ValueError, IndexError, OSError):
        return  # not an archive of this kind, or broken from here on; the scan says so


def extract_images(files: DataFrame) -> DataFrame:
    """The ``image`` table (and ``name``, ``place``: sheet or content document) of files as ``discover`` gives them.

    ``doc_id`` is that of the other fact tables. Of equal images in a document the first is kept. Types without images in
    an archive, null contents and broken files give no rows; no files give an empty table; more columns are passed over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        frame = lambda: pd.DataFrame(rows, columns=_COLUMNS).astype({"page": "Int32", "width": "Int32", "height": "Int32"})
        for batch in batches:
            for r in batch.itertuples(index=False):
                for row in images_of(r.doc_id, r.type, r.content):
                    rows.append(row)
                    held += len(row["content"])
                    if held >= BATCH:
                        yield frame()
                        rows, held = [], 0
        if rows:
            yield frame()

    known = files.filter(F.col("type").isin(*_WALKS) & F.col("content").isNotNull())
    return known.select(F.xxhash64("path").alias("doc_id"), "type", "content").mapInPandas(run, SCHEMA)
