"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-case (A-Z) words of letters, digits and non-ASCII characters,
one blank between them. Every ``window`` consecutive words of a benchmark item (all of a
shorter item) are a window. Of 2 b - 1 consecutive words some b begin at a multiple of b, so the
automaton holds the b-word blocks of each item that begin at such places, b = (window + 1) // 2, and
each item of fewer words than a window whole: about as much text as the items have, not ``window``
times as much. It finds all of these in one scan of a document; a block that is found is compared
word by word to both sides of each distinct context in which items have it, and counts where a whole
window agrees; a context reaches less than a window, so repeated words of an item share few of them and
repetitive texts take linear time. The words that windows cover are mapped back to code-point offsets
of the original text.

The automaton travels to each task, so its size is bounded: long items are cut into pieces that
overlap by a window, and pieces of more than about ``max_bytes`` in all are dealt to several
automata, which scan the documents in turn, each adding its hits to those before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from lectern.llm._shared import stored
from lectern.llm._text import LETTER_DIGIT, LOWER

_TABLE = bytes(int(LOWER[b]) if LETTER_DIGIT[LOWER[b]] else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of a piece of an item.
PIECE_WORDS = 4096
_built: dict[str, "Blocks | None"] = {}


def _words(text: str | None) -> list[str]:
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass").split(" ") if w]


class Blocks:
    """The automaton of (item id, words) pieces: text of a block -> its length and the contexts in which it stands.

    A context is the words of the same piece before and behind a block, as far as a window that holds the
    block can reach. Places with equal contexts are one, so a block that an item repeats is compared once
    a hit, not once a place.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        pieces: dict[tuple[str, ...], set[str]] = {}
        for name, words in items:
            if words:
                pieces.setdefault(tuple(words), set()).add(name)
        self.names: list[set[str]] = []
        found: dict[str, tuple[int, dict[tuple[tuple[str, ...], tuple[str, ...]], int]]] = {}
        size = (window + 1) // 2
        for words, names in pieces.items():
            step, reach = (len(words), 0) if len(words) < window else (size, window - size)
            for at in range(0, len(words) - step + 1, step):
                context = words[max(0, at - reach) : at], words[at + step : at + step + reach]
                contexts = found.setdefault(f" {' '.join(words[at : at + step])} ", (step, {}))[1]
                if context not in contexts:
                    contexts[context] = len(self.names)
                    self.names.append(set())
                self.names[contexts[context]] |= names
        self.machine = ahocorasick.Automaton()
        for text, (step, contexts) in found.items():
            # a short item is its only block, and a hit of it needs no context
            whole = contexts.pop(((), ()), None) if step < window else None
            self.machine.add_word(text, (step, whole, [(*c, k) for c, k in contexts.items()]))
        self.machine.make_automaton()

    def scan(self, words: list[str]) -> tuple[np.ndarray, set[str]]:
        """First and last word + 1 of each covered run, and the items found."""
        none = np.zeros((0, 2), np.int64)
        if not words or not len(self.machine):
            return none, set()
        line = f" {' '.join(words)} "
        hits = list(self.machine.iter(line))
        if not hits:
            return none, set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        last = np.searchsorted(blanks, [h[0] for h in hits]).tolist()
        edge = np.zeros(len(words) + 1, np.int64)
        met: set[int] = set()
        n = len(words)
        for stop, (_, (size, whole, contexts)) in zip(last, hits):
            if whole is not None:
                edge[stop - size] += 1
                edge[stop] -= 1
                met.add(whole)
            for before, behind, context in contexts:
                start, end = stop - size, stop
                for word in reversed(before):
                    if not start or words[start - 1] != word:
                        break
                    start -= 1
                for word in behind:
                    if end == n or words[end] != word:
                        break
                    end += 1
                if end - start >= self.window:
                    edge[start] += 1
                    edge[end] -= 1
                    met.add(context)
        covered = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
        step = np.diff(covered)
        return np.stack((np.flatnonzero(step > 0), np.flatnonzero(step < 0)), 1), set().union(*(self.names[k] for k in met))


def blocks(items: list[tuple[str, list[str]]], window: int) -> Blocks:
    """The automaton of ``items``, kept by content in the worker's process."""
    key = hashlib.sha256(repr((items, window)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _built:
        made = Blocks(items, window)
        _built.clear()
        _built[key] = made
    return _built[key]


def _joined(runs: np.ndarray, more: list[int]) -> np.ndarray:
    """Sorted disjoint runs that cover what ``runs`` and the flat pairs ``more`` cover."""
    both = np.concatenate((runs, np.array(more, np.int64).reshape(-1, 2)))
    if not len(both) or not more:
        return runs
    both = both[np.argsort(both[:, 0], kind="stable")]
    top = np.maximum.accumulate(both[:, 1])
    first = np.flatnonzero(np.concatenate(([True], both[1:, 0] > top[:-1])))
    return np.stack((both[first, 0], np.maximum.reduceat(both[:, 1], first)), 1)


_RUNS, _ITEMS = "lectern_runs", "lectern_items"
RESULT = [
    StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("item_ids", ArrayType(StringType())),
    StructField("spans", ArrayType(LongType())), StructField("contaminated", BooleanType()),
]


def _pass(docs: DataFrame, text_col: str, items: list[tuple[str, list[str]]], window: int, share: int, last: bool) -> DataFrame:
    """One scan of ``docs``; the runs and items of earlier scans are in two columns, those of the last become the result."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index(text_col)
    earlier = _RUNS in docs.columns
    kept = [f for f in docs.schema.fields if f.name not in (_RUNS, _ITEMS)]
    place = {n: docs.columns.index(n) for n in (_RUNS, _ITEMS)} if earlier else {}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = blocks(held.value, window)
        for batch in batches:
            out = []
            before = zip(batch.column(place[_RUNS]).to_pylist(), batch.column(place[_ITEMS]).to_pylist()) if earlier else [([], [])] * len(batch)
            for text, (old_runs, old_items) in zip(batch.column(at).to_pylist(), before):
                words = _words(text)
                runs, found = machine.scan(words)
                runs, found = _joined(runs, old_runs), sorted(found.union(old_items))
                if last:
                    spans = [m.span() for m in _WORD.finditer(text)] if len(runs) else []
                    n_hit = int((runs[:, 1] - runs[:, 0]).sum())
                    out.append((len(words), n_hit, len(found), found, [x for a, b in runs.tolist() for x in (spans[a][0], spans[b - 1][1])], n_hit > 0 and share * n_hit >= len(words)))
                else:
                    out.append((runs.ravel().tolist(), found))
            c = list(zip(*out)) or [[]] * (6 if last else 2)
            many, texts = pa.list_(pa.int64()), pa.list_(pa.string())
            types = [pa.int64(), pa.int64(), pa.int64(), texts, many, pa.bool_()] if last else [many, texts]
            names = [f.name for f in RESULT] if last else [_RUNS, _ITEMS]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in zip(c, types))], [*(f.name for f in kept), *names])

    more = RESULT if last else [StructField(_RUNS, ArrayType(LongType())), StructField(_ITEMS, ArrayType(StringType()))]
    return docs.mapInArrow(look, StructType([*kept, *more]))


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): the normalised words of each item, a long one as pieces that share ``window`` - 1 words."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                for i in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    names.append(item)
                    texts.append(" ".join(words[i : i + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item", "words"])

    return rows.mapInArrow(cut, "item string, words string").filter("words <> ''").distinct()


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 13, share: int = 20, max_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids, spans and contaminated; rows and other columns stay as they are.

    ``n_hit`` counts the words inside any occurrence of a window; ``item_ids`` are the items that
    occur, as sorted strings; ``spans`` are flat pairs of code-point offsets (end exclusive) of
    the covered runs; ``contaminated``: n_hit > 0 and share * n_hit >= n_words. A null or empty
    text has no words and is clean. Rows of the benchmark without id or text are left out; repeated
    ids are one item. Each row is judged by its own text, so null and repeated ids of ``docs`` do not
    matter; columns named like a result are replaced.
    """
    tests = stored(_pieces(benchmark, item_col, item_text_col, window), "items")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item")), F.lit(0))).first()[0]
    parts = int(size // max_bytes) + 1
    got = docs.drop(*(f.name for f in RESULT), _RUNS, _ITEMS)
    for part in range(parts):
        mine = tests if parts == 1 else tests.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        items = sorted((r["item"], r["words"].split(" ")) for r in mine.collect())
        got = _pass(got, text_col, items, window, share, part == parts - 1)
    return got


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids, spans, contaminated (see ``flag``).

    Repeated documents get equal rows; other columns are not carried.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return flag(rows, benchmark, "text", item_col, item_text_col, **options).drop("text")
