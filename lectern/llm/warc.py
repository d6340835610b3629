"""WARC archives, written and read through an index.

Writing puts each record into its task's archive as a gzip member of its own and returns the
index (file, offset, length, url, digest, ...), which is stored as a table before any archive is
read. Reading takes index rows, orders them by file and offset, joins neighbouring byte ranges
into one read and parses the records found there. Archives lie in the shared folder (or a
folder given), reached through Arrow's file systems, so local, HDFS and object stores work. A
task that is run again writes a new file, and only the index rows of the run that counts are kept.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import new_path, stored

#: Ranges that are read at once are at most this far apart, and at most so long (or one record).
GAP, READ = 64 << 10, 8 << 20
MIN_REVISIT = 100
INDEX = "page_id {id}, file string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to {id}"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit of ``refers_to``, as WARC/1.1 text."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # ids are quoted, so that no character of theirs ends a header or the name
    name = lambda x: f"<urn:page:{quote(str(x), safe='')}>"
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%~-._"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": name(refers_to) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its HTTP message, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    message, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in message.decode().split("\r\n")[1:]), payload


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with payload_bytes, digest and refers_to (the smallest id of an equal, long enough payload, else null)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    known = pages.withColumn("digest", F.sha2(payload, 256)).withColumn("payload_bytes", F.octet_length(payload).cast("long"))
    slim = stored(known.select(F.col(id_col).alias("k"), "digest", "payload_bytes"), "digests")
    repeated = slim.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("k").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only later copies are joined with their first; ids come once each, so rows do not multiply
    later = slim.join(repeated, "digest").filter(~F.col("k").eqNullSafe(F.col("refers_to"))).select("k", F.col("digest").alias("d"), "refers_to").distinct()
    return known.join(later, known[id_col].eqNullSafe(later["k"]) & (known["digest"] == later["d"]), "left").drop("k", "d")


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page; returns the stored index.

    A null html is an empty payload, a null url leaves out the header. Of pages with equal payloads
    of at least 100 bytes, those with the smallest id are responses and the others revisits of it.
    Repeated rows are records of their own; other columns are not written.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = revisits(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "page_id", "html").select("page_id", "url", "html", "digest", "payload_bytes", "refers_to")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = _place(folder)
        place.create_dir(path, recursive=True)
        name, at, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                size, offset = [], []
                ids, urls, htmls, digests, sizes, first = (batch.column(i) for i in range(6))
                out = out or place.open_output_stream(f"{path}/{name}", compression=None)
                for key, url, html, digest, origin in zip(ids.to_pylist(), urls.to_pylist(), htmls.to_pylist(), digests.to_pylist(), first.to_pylist()):
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = pack.compress(record(key, url, (html or "").encode("utf-8", "surrogatepass"), digest, origin)) + pack.flush()
                    out.write(raw)
                    offset.append(at)
                    size.append(len(raw))
                    at += len(raw)
                kinds = ["response" if x is None else "revisit" for x in first.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(batch), pa.string()), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), urls, digests, sizes, pa.array(kinds, pa.string()), first], ["page_id", "file", "offset", "length", "url", "digest", "payload_bytes", "record_type", "refers_to"])
        finally:
            if out:
                out.close()

    index = stored(rows.mapInArrow(put, INDEX.format(id=kind)), "index")
    return index.withColumn("folder", F.lit(folder))


def read(index: DataFrame) -> DataFrame:
    """The records of the selected index rows: page_id, url, record_type, payload, digest, payload_bytes, refers_to.

    All but ``page_id`` and ``url`` come from the archives. ``payload`` is null for a revisit;
    ``digest`` and ``payload_bytes`` are then those the record names, else they are taken from the
    payload read. ``refers_to`` is the id a revisit names.
    """
    kind = index.schema["page_id"].dataType
    # the rows are small and what they name is large, so the number of tasks follows the bytes to read
    tasks = int(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // READ) + 1
    ordered = index.select("page_id", "url", "folder", "file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / READ)).sortWithinPartitions("folder", "file", "offset")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_text = pa.string()

        def runs() -> Iterator[list[dict]]:
            run: list[dict] = []
            for batch in batches:
                for r in batch.to_pylist():
                    if run and (r["file"] != run[-1]["file"] or r["folder"] != run[-1]["folder"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > GAP or r["offset"] + r["length"] - run[0]["offset"] > READ):
                        yield run
                        run = []
                    run.append(r)
            if run:
                yield run

        opened: dict[str, object] = {}
        for run in runs():
            name = f"{run[0]['folder']}/{run[0]['file']}"
            if name not in opened:
                for f in opened.values():
                    f.close()
                place, path = _place(name)
                opened = {name: place.open_input_file(path)}
            start = run[0]["offset"]
            raw = opened[name].read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
            got = []
            for r in run:
                at = r["offset"] - start
                fields, http, payload = parse(zlib.decompress(raw[at : at + r["length"]], 31))
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                origin = unquote(fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">")) if revisit else None
                got.append((r["page_id"], r["url"], fields["WARC-Type"], None if revisit else payload, digest, int(http["Content-Length"]) if revisit else len(payload), origin))
            columns = list(zip(*got))
            types = [None, from_text, from_text, pa.binary(), from_text, pa.int64(), from_text]
            first = pa.array(columns[0], batch_type)
            yield pa.RecordBatch.from_arrays([first, *(pa.array(c, t) for c, t in zip(columns[1:], types[1:]))], ["page_id", "url", "record_type", "payload", "digest", "payload_bytes", "refers_to"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    out = ordered.mapInArrow(take, f"page_id {kind.simpleString()}, url string, record_type string, payload binary, digest string, payload_bytes long, refers_to string")
    return out.withColumn("refers_to", F.col("refers_to").cast(kind))
