"""Secret scans with multipart credential linking.

Strong spans stand alone: assignments, access identifiers and long hexadecimal runs. Weak
parts mean nothing alone: a bare key, a client or account identifier, an endpoint.
Parts are joined as intervals: each part reaches ``scope`` code points in both directions
within its text, and a weak part is reported only when a complementary part lies within reach
(an identifier with a secret, or a secret with an endpoint). The parts of a text are swept in
order of position, so a text with many parts costs n log n.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is maximal, so asking for 32 drops the same runs as a later test of the length.
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Keys of 32 or more characters, or of 20 or more with padding; a key may stand right after ``=``.
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?:[A-Za-z0-9+/]{32,}={0,2}|[A-Za-z0-9+/]{20,31}={1,2})(?![A-Za-z0-9+/=_-])")
_WEAK_ID = re.compile(r"""(?ai:(?:client|account|access_?key|user|tenant)_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9-]{8,})""")
#: What may stand before ``://``, what a matching address names before any ``?``, ``&``, ``=`` or ``%``, and how far it goes.
_SCHEME = re.compile(r"(?ai:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)\Z")
_SERVICE = re.compile(r"(?ai:amazonaws|azure|googleapis|vault|auth|login|api|s3|db)")
_HOST, _ADDRESS = re.compile(r"[A-Za-z0-9.:@/_-]*"), re.compile(r"[A-Za-z0-9.:@/?&=_%-]*")
BASE = ("assign", "access", "hex")
LINKED = ("secret_part", "id_part", "endpoint_part")
_ORDER = {k: i for i, k in enumerate((*BASE, *LINKED))}
#: What completes what.
_COMPLEMENT = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    """Addresses of services. Each stretch of address characters is looked at once, however many schemes it holds."""
    at = text.find("://")
    while at >= 0:
        head = max(0, at - 12)
        scheme = _SCHEME.search(text[head:at])
        after = at + 3
        if scheme:
            stop = _HOST.match(text, after).end()
            if _SERVICE.search(text, after, stop):
                after = _ADDRESS.match(text, stop).end()
                yield head + scheme.start(), after
            else:
                after = stop  # a later scheme before ``stop`` names no service either
        at = text.find("://", after)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """Weak parts with a complement in reach. Base spans take part: access as identifier, the others as secrets."""
    weak = {"secret": [m.span() for m in _WEAK_SECRET.finditer(text)], "id": [m.span(1) for m in _WEAK_ID.finditer(text)], "endpoint": list(endpoints(text))}
    if not any(weak.values()):
        return []
    part = {k: list(v) for k, v in weak.items()}
    for start, end, kind in base:
        part["id" if kind == "access" else "secret"].append((start, end))
    starts = {}
    for kind, spans in part.items():
        spans.sort()
        starts[kind] = ([s for s, _ in spans], sorted(e for _, e in spans))
    taken = {(s, e) for s, e, _ in base}
    out = []
    for kind, spans in weak.items():
        for start, end in spans:
            if (start, end) in taken:
                continue
            for other in _COMPLEMENT[kind]:
                s, e = starts[other]
                # parts that begin before our reach ends, less those that end before it begins
                if bisect.bisect_right(s, end + scope) - bisect.bisect_left(e, start - scope) > 0:
                    out.append((start, end, f"{kind}_part"))
                    break
    return out


def find(text: str | None, scope: int) -> list[tuple[int, int, str]]:
    text = text or ""
    base = base_spans(text)
    return sorted([*base, *linked_spans(text, base, scope)], key=lambda s: (s[0], _ORDER[s[2]], s[1]))


_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def scan_secrets(docs: DataFrame, text_col: str = "text", *, scope: int = 400, spans_col: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end) structs, by start, then kind, in code points.

    A null or empty text has no spans. Other columns pass through; one named like ``spans_col`` is
    replaced. Repeated rows get equal spans.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kept = docs.drop(spans_col)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in find(t, scope)] for t in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, spans_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(spans_col, _SPANS)]))


def redacted(text: str | None, scope: int) -> str | None:
    """The text with each secret replaced by a mark of its kind; overlapping spans become one."""
    spans = find(text, scope)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end, i = max(end, spans[i][1]), i + 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", *, scope: int = 400) -> DataFrame:
    """``docs``, all rows and columns, with secrets in the text replaced; null stays null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = pa.array([redacted(t, scope) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield batch.set_column(at, names[at], fixed)

    return docs.mapInArrow(run, docs.schema)


def digest_columns(spans: str = "spans"):
    """Columns of the digest query from a spans array."""
    def text(kinds):
        keep = f"filter({spans}, s -> s.kind in ({', '.join(repr(k) for k in kinds)}))"
        return F.expr(f"array_join(transform({keep}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    counts = [F.expr(f"cast(size(filter({spans}, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return [*counts, F.sha2(text(BASE), 256).alias("base_sha256"), text((*BASE, *LINKED)).alias("spans")]
