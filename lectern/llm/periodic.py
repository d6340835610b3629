"""Periodic runs of words: all stretches that repeat with a smallest period and cannot be extended.

By the runs theorem each run holds a Lyndon word of its period, and that word is the longest Lyndon
word at its place under the order of words or under the reverse order. So every place of a text
gives at most two candidates, read off the inverse suffix array: the next place whose suffix is
smaller ends the longest Lyndon word of one order, the next whose suffix is greater that of the
other. A candidate is extended to the right by the longest common prefix of the suffixes one period
apart, and to the left by that of the reversed text, each a range minimum over the array of common
prefixes of neighbours in the suffix array; the range minimum uses a sparse table over blocks.

Everything is linear or n log n in a text's words, whatever repeats there. The texts of a batch are
handled in pieces of about a megabyte as one sequence in which no word of one text equals a word of
another; a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

PIECE = 1 << 20
#: Places per block of the range minimum.
BLOCK = 32
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
RESULT = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]


def suffix_array(x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and their ranks; suffix i runs from i to end[i], a prefix before what it begins.

    Prefix doubling: each round sorts only the suffixes that still tie, by the rank ``step`` places on.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], x[order][1:] != x[order][:-1]))) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    slots, step = np.arange(n), 1
    while True:
        # slots of groups of two or more
        group = rank[order[slots]]
        same = group[1:] == group[:-1]
        slots = slots[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(slots) else slots
        if not len(slots):
            return order, rank
        at = order[slots]
        group, later = rank[at], at + step
        second = np.where(later < end[at], rank[np.minimum(later, n - 1)], -1)
        by = np.lexsort((second, group))
        at, group, second = at[by], group[by], second[by]
        order[slots] = at
        fresh = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1]))))
        rank[at] = np.repeat(slots[fresh], np.diff(np.append(fresh, len(at))))
        step *= 2


def next_smaller_and_greater(rank: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one of a smaller, and of a greater rank, before its text's end; else that end."""
    r, stop = rank.tolist(), end.tolist()
    n = len(r)
    less, more = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j, s, v = i + 1, stop[i], r[i]
        while j < s and r[j] > v:
            j = less[j]
        less[i] = j
        j = i + 1
        while j < s and r[j] < v:
            j = more[j]
        more[i] = j
    return np.array(less, np.int64), np.array(more, np.int64)


def neighbour_prefixes(x: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it (Kasai): what place i shares, i + 1 shares all but one word of."""
    word, stop, sorted_, place = x.tolist(), end.tolist(), order.tolist(), rank.tolist()
    out, h = [0] * len(word), 0
    for i, k in enumerate(place):
        if not k:
            h = 0
            continue
        j = sorted_[k - 1]
        top = min(stop[i] - i, stop[j] - j)
        while h < top and word[i + h] == word[j + h]:
            h += 1
        out[k] = h
        if h:
            h -= 1
    return np.array(out, np.int64)


class RangeMinimum:
    """Least value of a range: within blocks by their running minima, between them by a sparse table."""

    def __init__(self, values: np.ndarray):
        n = -len(values) % BLOCK
        self.cells = np.concatenate((values, np.full(n, np.iinfo(np.int64).max))).reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(self.cells, axis=1)
        self.behind = np.minimum.accumulate(self.cells[:, ::-1], axis=1)[:, ::-1]
        self.table = [self.ahead[:, -1]]
        while 2 << (len(self.table) - 1) <= len(self.cells):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low : high + 1]."""
        a, b = low // BLOCK, high // BLOCK
        out = np.empty(len(low), np.int64)
        inside = a == b
        for k in np.flatnonzero(inside):
            out[k] = self.cells[a[k], low[k] % BLOCK : high[k] % BLOCK + 1].min()
        far = np.flatnonzero(~inside)
        out[far] = np.minimum(self.behind[a[far], low[far] % BLOCK], self.ahead[b[far], high[far] % BLOCK])
        width = b[far] - a[far] - 1
        for level, table in enumerate(self.table):
            mine = np.flatnonzero((width >= 1 << level) & (width < 2 << level))
            k = far[mine]
            out[k] = np.minimum(out[k], np.minimum(table[a[k] + 1], table[b[k] - (1 << level)]))
        return out


class CommonPrefix:
    """Longest common prefix of two suffixes of a sequence."""

    def __init__(self, x: np.ndarray, end: np.ndarray, sorted_: tuple[np.ndarray, np.ndarray] | None = None):
        self.end = end
        order, self.rank = sorted_ or suffix_array(x, end)
        self.least = RangeMinimum(neighbour_prefixes(x, end, order, self.rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def find_runs(x: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of the texts in ``x``, by start and period.

    begin[i] and end[i] bound the text of place i; texts must share no value. A run has at least
    ``min_length`` words and ``min_exponent`` >= 2 periods.
    """
    n = len(x)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    order, rank = suffix_array(x, end)
    less, more = next_smaller_and_greater(rank, end)
    place = np.concatenate((np.arange(n), np.arange(n)))
    period = np.concatenate((less, more)) - place
    # a root whose run is longer than itself agrees with its neighbour one period on, at its first or before its first word
    right = np.minimum(place + period, n - 1)
    on = (place + period < end[place]) & (x[place] == x[right])
    back = (place > begin[place]) & (x[place - 1] == x[place + period - 1])
    keep = on | back
    place, period, on, back = place[keep], period[keep], on[keep], back[keep]
    if not len(place):
        return none, none, none
    # only texts with candidates need their common prefixes
    touched = np.zeros(n + 1, np.int64)
    np.add.at(touched, begin[place], 1)
    np.add.at(touched, end[place], -1)
    used = np.flatnonzero(np.cumsum(touched[:-1]) > 0)
    new = np.zeros(n + 1, np.int64)
    new[used] = np.arange(len(used))
    y, stop = x[used], new[end[used] - 1] + 1
    start = new[begin[used]]
    kept = order[np.isin(order, used, assume_unique=True)] if len(used) < n else order
    sub = new[kept]
    sub_rank = np.empty(len(used), np.int64)
    sub_rank[sub] = np.arange(len(used))
    forward = CommonPrefix(y, stop, (sub, sub_rank))
    m = len(used)
    backward = CommonPrefix(y[::-1], (m - start)[::-1])
    at = new[place]
    far, near = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    far[on] = forward(at[on], at[on] + period[on])
    near[back] = backward(m - at[back] - period[back], m - at[back])
    length = period + far + near
    good = length >= np.maximum(min_length, min_exponent * period)
    # at a text's end a root may be a power of the run's own; of several periods of one stretch the smallest is the run's
    found = np.unique(np.stack((place[good] - near[good], length[good], period[good]), 1), axis=0)
    found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))] if len(found) else found
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _look(texts: list[str | None], min_length: int, min_exponent: int) -> list[tuple[int, list[dict], str]]:
    """(number of words, runs, collapsed text) of each text."""
    # bytes.split() parts at 0x20 and 0x09 to 0x0D only
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    values: list[int] = []
    for mine in words:
        names: dict[bytes, int] = {}
        base = len(values)
        values.extend([names.setdefault(w, len(names)) + base for w in mine])
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    start, length, period = find_runs(np.array(values, np.int64), np.repeat(first, sizes), np.repeat(first + sizes, sizes), min_length, min_exponent)
    part = np.searchsorted(start, np.append(first, len(values))).tolist()
    out = []
    for k, mine in enumerate(words):
        low, high = part[k], part[k + 1]
        if low == high:
            out.append((len(mine), [], b" ".join(mine).decode("utf-8", "surrogatepass")))
            continue
        s, n, q = start[low:high] - first[k], length[low:high], period[low:high]
        edge = np.zeros(len(mine) + 1, np.int64)
        np.add.at(edge, s + q, 1)
        np.add.at(edge, s + n, -1)
        left = b" ".join(mine[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())
        runs = [{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), q.tolist())]
        out.append((len(mine), runs, left.decode("utf-8", "surrogatepass")))
    return out


def periodic_runs(docs: DataFrame, text_col: str = "text", *, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q and at least
    ``min_length`` words and ``min_exponent`` (2 or more) periods that no neighbouring word extends.
    ``collapsed`` holds, joined by one blank, the words that stand in no run or among the first q of
    every run they stand in. A null or empty text has no words, no runs and collapses to an empty one.
    Rows are looked at one by one, so repeated rows and null ids do not matter; columns named like a
    result are replaced, others kept.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    kept = [f for f in docs.drop(*(f.name for f in RESULT)).schema.fields]
    if text_col not in {f.name for f in kept}:
        raise ValueError(f"the text may not be in a column named {text_col!r}, which holds a result")
    schema = StructType([*kept, *RESULT])
    run = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            size = np.cumsum([len(t or "") for t in texts])
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + PIECE, "right")))
                n, runs, left = zip(*_look(texts[low:high], min_length, min_exponent))
                mine = [batch.column(i).slice(low, high - low) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*mine, pa.array(n, pa.int64()), pa.array(runs, run), pa.array(left, pa.string())], schema.names)
                low = high

    return docs.select([f.name for f in kept]).mapInArrow(look, schema)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 10) -> DataFrame:
    """``docs`` in which the words of about one text of ``one_in`` repeat from some place on, as the hash h of the id says.

    If ``one_in`` divides h = crc32 of the decimal id, with g = h / ``one_in`` each of the text's n words
    from number a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8), all without
    fractions, and one blank stands between words. A null id, a null text and one without words stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / one_in).cast("long")

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("long")
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), word), " "))

    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # bound by a lambda, so that the words are taken out of the text once
    text = F.get(F.transform(F.array(words), repeated), 0)
    return docs.withColumn(text_col, F.coalesce(F.when(h % one_in == 0, text), F.col(text_col)))


def digest_columns() -> list:
    """n_runs, the longest run (ties: smallest start, then period) and the digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return [
        F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ]
