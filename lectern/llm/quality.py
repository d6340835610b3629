"""Quality rules: plain text counts, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over ``2**bits`` hash places of word unigrams and bigrams:
that of a trusted target and that of the raw corpus. The raw counts cover all n-grams of all
documents; the target is a sample of trusted rows bounded by ``max_trusted`` (by hash order of
the ids). At each place the target's count t is held against e, what it would be at the corpus's
share: log((t + prior) / (e + prior)). Where the target says little (small e) the value is near 0,
whatever the size of the corpus. A document's value is the mean over its n-grams, so length does not
matter; a trusted row is judged without its own counts, as if it were any other. A document is kept
where the value reaches a fixed threshold: no chance is involved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._text import NOT_SPACE, gram_hash, long_array, pieces, span_hash, words

BITS = 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _places(word: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash places of all unigrams and bigrams, and the row of each."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = gram_hash(word, 2)
    whole = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    shift = np.uint64(64 - bits)
    return np.concatenate((word >> shift, pair[whole] >> shift)).astype(np.int64), np.concatenate((row, row[:-1][whole]))


def text_counts(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(off) - 1

    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums

    inside = NOT_SPACE[data]
    letters = total(inside)
    chars = total(((data & 0xC0) != 0x80) & inside)
    symbols = total(_SYMBOL[data])
    # lines: from a row's start or after a newline, to the next newline or the row's end
    newline = np.flatnonzero(data == 10)
    row_of = np.searchsorted(off, newline, "right") - 1
    line_start = np.sort(np.concatenate((off[:-1], newline + 1)))
    line_row = np.sort(np.concatenate((np.arange(n), row_of)))
    line_end = np.minimum(np.concatenate((line_start[1:], [len(data)])), off[1:][line_row]) if len(line_start) else line_start
    at_newline = np.zeros(len(data) + 1, bool)
    at_newline[newline + 1] = True
    ended = np.concatenate((line_row[1:] == line_row[:-1], [False])) if len(line_row) else np.zeros(0, bool)
    line_end = np.where(ended, line_end - 1, line_end)
    filled = letters[line_end] > letters[line_start]
    line_start, line_end, line_row = line_start[filled], line_end[filled], line_row[filled]
    key = span_hash(data, line_start, line_end) + line_row.astype(np.uint64) * _ODD
    _, kept = np.unique(key, return_index=True)
    repeated_lines = np.bincount(line_row, minlength=n) - np.bincount(line_row[kept], minlength=n)
    # words in a three-word window that the row holds twice
    row = np.repeat(np.arange(n), np.diff(first))
    repeated = np.zeros(len(word) + 1, np.int64)
    triple = gram_hash(word, 3)
    if len(triple):
        at = np.flatnonzero(row[:-2] == row[2:])
        key = triple[at] + row[at].astype(np.uint64) * _ODD
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = at[twice[near] == key]
            mark = np.zeros(len(word), bool)
            for j in range(3):
                mark[hit + j] = True
            repeated = total(mark)
    return [np.diff(first), np.diff(chars[off]), np.diff(symbols[off]), repeated_lines, repeated[first[1:]] - repeated[first[:-1]]]


@dataclass(frozen=True)
class Ratio:
    """Counts by hash place of the target and of the corpus, and the ids of the target's rows."""

    target: np.ndarray
    raw: np.ndarray
    trusted: frozenset
    prior: float

    def values(self, place: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """The value of each n-gram; ``own`` (places of a trusted row) are left out of the target."""
        if not self.target.any():
            return np.zeros(len(place))
        total, t = float(self.target.sum()), self.target[place].astype(float)
        if own is not None:
            total -= len(own)
            keys, count = np.unique(own, return_counts=True)
            t -= count[np.searchsorted(keys, place)]
        return np.log((t + self.prior) / (total * self.raw[place] / self.raw.sum() + self.prior))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", *, max_trusted: int = 4096, bits: int = BITS, prior: float = 16.0) -> Ratio:
    """Counts of every n-gram of ``docs``, and of up to ``max_trusted`` rows whose id ``labels`` gives quality 1.

    ``prior``: how many n-grams at a place weigh as much as the corpus's share. Without a trusted row all
    values are 0. Rows of one trusted id all count. Counts are summed in each task and then by place.
    """
    trusted = labels.filter(F.col(quality_col) == 1).select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    ids = frozenset(r["id"] for r in trusted.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_trusted).collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            is_good = np.fromiter((x in ids for x in batch.column(0).to_pylist()), bool, len(batch))
            for low, high, data, off in pieces(batch.column(1)):
                start, end, first = words(data, off, NOT_SPACE)
                place, row = _places(span_hash(data, start, end), first, bits)
                got[1] += np.bincount(place, minlength=1 << bits)
                if is_good[low:high].any():
                    got[0] += np.bincount(place[is_good[low:high][row]], minlength=1 << bits)
        place = np.flatnonzero(got[1])
        yield pa.RecordBatch.from_arrays([long_array(place), long_array(got[0, place]), long_array(got[1, place])], ["place", "target", "raw"])

    counts = np.zeros((2, 1 << bits), np.int64)
    summed = docs.select(id_col, text_col).mapInArrow(count, "place long, target long, raw long").groupBy("place").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    for r in summed.collect():  # at most 2**bits rows
        counts[:, r["place"]] = r["target"], r["raw"]
    return Ratio(counts[0], counts[1], ids, prior)


def assess(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = -0.1) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, llr and kept.

    A null or empty text has no words and fails the base rules. A text whose n-grams are all unknown
    to both sides has llr 0. Repeated rows get equal results; other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    bits = int(len(ratio.raw)).bit_length() - 1
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = held.value.values(np.arange(1 << bits)) if held.value.raw.any() else np.zeros(1 << bits)
        for batch in batches:
            known = batch.column(0).to_pylist()
            for low, high, data, off in pieces(batch.column(1)):
                start, end, first = words(data, off, NOT_SPACE)
                word = span_hash(data, start, end)
                counts = text_counts(data, off, start, end, first, word)
                place, row = _places(word, first, bits)
                value = np.bincount(row, every[place], high - low) / np.maximum(np.bincount(row, minlength=high - low), 1)
                for i in range(high - low):
                    if known[low + i] in held.value.trusted:
                        own = place[row == i]
                        value[i] = held.value.values(own, own).mean() if len(own) else 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(long_array, counts), pa.array(value)], ["doc_id", *names, "llr"])

    got = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(look, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, llr double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
