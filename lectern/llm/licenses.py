"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are lower-case words of letters, digits and non-ASCII characters. Of every
``winnow`` consecutive word k-grams of a template the one with the least hash is kept in an
inverted index (hash -> template, position), so a run of ``k + winnow - 1`` words in common is
always seen. All k-grams of a document are looked up; hits on nearby diagonals of one template
are a candidate, which is aligned with the template in a band around them, unless the stretch of text
that the band can reach has too few of the template's words for ``coverage`` (a bound, so no match is
lost by it). A match reports the share of the template's words that the alignment pairs, and its span
in the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._text import LETTER_DIGIT, LOWER, gram_hash, pieces, span_hash, words
from lectern.llm.license_templates import TEMPLATES

#: Templates travel to every task; more than so many bytes of them are dealt to several scans.
MAX_TEMPLATE_BYTES = 8 << 20


def _words(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = words(data, np.array([0, len(data)]), LETTER_DIGIT)
    return span_hash(data, start, end)


def winnowed(word: np.ndarray, k: int, winnow: int) -> list[tuple[int, int]]:
    """(position, hash) of the kept k-grams: in every window the rightmost least one."""
    gram = gram_hash(word, min(k, max(1, len(word))))
    kept = {}
    for i in range(max(1, len(gram) - winnow + 1)):
        window = gram[i : i + winnow]
        if len(window):
            at = i + len(window) - 1 - int(np.argmin(window[::-1]))
            kept[at] = int(gram[at])
    return sorted(kept.items())


class Index:
    """Fingerprints of all templates, sorted by hash."""

    def __init__(self, templates: dict[str, str], k: int, winnow: int):
        self.k = k
        self.names = [name for name in sorted(templates) if len(_words(templates[name])) >= k]
        self.words = [_words(templates[name]) for name in self.names]
        rows = sorted((h, t, at) for t, w in enumerate(self.words) for at, h in winnowed(w, k, winnow))
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.position = np.array([r[2] for r in rows], np.int64)
        self.bag = [np.unique(w, return_counts=True) for w in self.words]


def most_pairs(bag: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> int:
    """Most words that any alignment of a template (its distinct words and their counts) and ``text`` can pair."""
    have, count = np.unique(text, return_counts=True)
    _, i, j = np.intersect1d(bag[0], have, assume_unique=True, return_indices=True)
    return int(np.minimum(bag[1][i], count[j]).sum())


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Most pairs of equal words in order, with text position - template position within ``band`` of
    ``diagonal``; and the first and last paired text position."""
    width, m = 2 * band + 1, len(template)
    shift = diagonal - band
    score = np.zeros((m + 1, width), np.int32)
    equal = np.zeros((m, width), bool)
    for i in range(m):
        low = i + shift
        a, b = max(0, -low), min(width, len(text) - low)
        if a < b:
            equal[i, a:b] = text[low + a : low + b] == template[i]
        # cell (i, c): text word i + shift + c; a step down the template moves one cell to the right
        best = np.maximum(score[i] + equal[i], np.concatenate((score[i][1:], [0])))
        score[i + 1] = np.maximum.accumulate(best)
    i, c = m, int(np.argmax(score[m]))
    total, pairs = int(score[m, c]), []
    while i > 0 and score[i, c] > 0:
        if c and score[i, c - 1] == score[i, c]:
            c -= 1
        elif equal[i - 1, c] and score[i - 1, c] + 1 == score[i, c]:
            pairs.append(i - 1 + shift + c)
            i -= 1
        else:
            i, c = i - 1, c + 1
            if c >= width:
                break
    return total, (pairs[-1] if pairs else 0), (pairs[0] if pairs else 0)


def matches(index: Index, word: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, last word) in one text; hits: (position, row of the index)."""
    votes = defaultdict(list)
    for at, row in hits:
        votes[int(index.template[row])].append(at - int(index.position[row]))
    out = []
    for t, diagonals in votes.items():
        band = 4 + len(index.words[t]) // 8
        diagonals.sort()
        low, m = 0, len(index.words[t])
        found: list[tuple[float, int, int]] = []
        for i in range(1, len(diagonals) + 1):
            # a group spans at most a band, so that the band around its middle holds all of it
            if i < len(diagonals) and diagonals[i] - diagonals[low] <= band:
                continue
            middle, low = diagonals[(low + i) // 2], i
            reach = word[max(0, middle - band) : max(0, middle + m + band)]
            if most_pairs(index.bag[t], reach) < coverage * m:
                continue
            pairs, first, last = align(index.words[t], word, middle, band)
            if pairs >= coverage * m:
                found.append((-pairs / m, first, last))
        best: list[tuple[str, float, int, int]] = []
        for share, first, last in sorted(found):
            if not any(a <= last and first <= b for _, _, a, b in best):
                best.append((index.names[t], -share, first, last))
        out += best
    return sorted(out, key=lambda m: (m[2], m[0]))


def _parts(templates: dict[str, str]) -> list[dict[str, str]]:
    """``templates`` in parts of at most ``MAX_TEMPLATE_BYTES`` (or one template); no part needs another."""
    parts, size = [{}], 0
    for name in sorted(templates):
        more = len(templates[name].encode())
        if parts[-1] and size + more > MAX_TEMPLATE_BYTES:
            parts.append({})
            size = 0
        parts[-1][name] = templates[name]
        size += more
    return parts


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, *, k: int = 3, winnow: int = 2, coverage: float = 0.8) -> DataFrame:
    """One row per match: doc_id, template, coverage, start, end (code points, end exclusive).

    A text without a match, a null or an empty one, gives no row. Templates of fewer than ``k`` words
    are not searched. Of overlapping matches of one template the best is reported (of equal
    ones the first), of several templates each. Repeated documents give equal rows each, null ids too; other columns are not
    carried. Each part of ``MAX_TEMPLATE_BYTES`` of templates is a scan of its own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = [_scan(rows, Index(part, k, winnow), coverage) for part in _parts(TEMPLATES if templates is None else templates)]
    return reduce(DataFrame.unionByName, got)


def _scan(rows: DataFrame, index: Index, coverage: float) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(index)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            rows, ids = [], []
            for low, _, data, off in pieces(batch.column(1)) if len(index.hash) else ():
                data = LOWER[data]
                start, end, first = words(data, off, LETTER_DIGIT)
                word = span_hash(data, start, end)
                gram = gram_hash(word, index.k)
                left = np.searchsorted(index.hash, gram)
                found = np.flatnonzero(index.hash[np.minimum(left, len(index.hash) - 1)] == gram)
                doc = np.searchsorted(first, found, "right") - 1
                found = found[found + index.k <= first[doc + 1]]
                per = defaultdict(list)
                for at in found.tolist():
                    row, d = int(left[at]), int(np.searchsorted(first, at, "right")) - 1
                    while row < len(index.hash) and index.hash[row] == gram[at]:
                        per[d].append((at - int(first[d]), row))
                        row += 1
                for d, hits in sorted(per.items()):
                    base = int(first[d])
                    for name, share, a, b in matches(index, word[base : first[d + 1]], hits, coverage):
                        span = [int(np.count_nonzero((data[off[d] : p] & 0xC0) != 0x80)) for p in (start[base + a], end[base + b])]
                        rows.append((name, share, *span))
                        ids.append(low + d)
            c = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(c[0], pa.string()), pa.array(c[1], pa.float64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], ["doc_id", "template", "coverage", "start", "end"])

    return rows.mapInArrow(look, f"doc_id {kind}, template string, coverage double, start long, end long")
