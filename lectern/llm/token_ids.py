"""Token ids of documents in files of Simple-8b words.

A Simple-8b word has 64 bits: the upper four select how many values of how many bits the other sixty
hold. Selector 0 is an escape: its one value did not fit 60 bits and is the next of the block's
exceptions, which stand behind the words as plain 64-bit numbers, so that words can be told from
exceptions without reading them in turn. Selector 1 stands for 120 zeros. Each word takes as many
of the coming values as fit. The last word of a list may stand for more values than are left; the
list's length says how many count.

A file is a sequence of blocks of whole documents, each with three lists: differences of document
ids, lengths of documents, token ids. The index, stored as a table, has each block's file, place, first
document and first id, so that any block can be read by itself. Decoding handles all words of one
selector at once. Files are written in the order of document ids: rows are range-sorted, each task
writes one file, and a file's first id is the sum of the files before it. A task that is run again
writes a new file, and only the index rows of the run that counts are kept.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from lectern.llm._shared import new_path, stored
from lectern.llm.warc import _place

_U = np.uint64
#: Bits and number of the values of each selector; fixed values of the coding.
BITS = [64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
COUNT = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
MAGIC = b"LS8B"
#: Values of a block (more only if one document has more), and bytes that one task reads.
BLOCK, READ = 1 << 16, 4 << 20
#: Magic, values and words and exceptions of the three lists, null ids, crc32 of what follows.
_HEAD = struct.Struct("<4s11Q")
INDEX = "part int, file string, offset long, length long, first_doc long, first_id long, n_docs long, n_ids long"
#: Segments after which a worker forgets them all, and characters tokenised at once.
REMEMBERED, PIECE = 1 << 20, 1 << 20
#: Classes of code points up to 255 that the splitting treats alike; all others are 0, beside which nothing is cut.
LETTER, DIGIT, SIGN, QUOTE, BLANK, LINE = range(1, 7)
_CLASS = np.zeros(257, np.uint8)
_CLASS[33:127] = SIGN
_CLASS[48:58] = DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
_CLASS[39], _CLASS[32], _CLASS[10] = QUOTE, BLANK, LINE
#: Where a part ends and another begins, whatever else stands around. A blank goes with what follows it, a quote may go with letters.
_CUTS = np.zeros((7, 7), bool)
for _a in (LETTER, DIGIT, SIGN, QUOTE):
    _CUTS[_a, [LETTER, DIGIT, SIGN, QUOTE, LINE]] = True
    _CUTS[_a, _a] = False
_CUTS[QUOTE, [LETTER, SIGN]] = _CUTS[SIGN, QUOTE] = False
#: What stands for each byte before the model: printable ones themselves, others from 256 on.
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_FIRST = chr(_BYTE_SIGNS[32])


def _segments(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All texts cut where parts begin, one after another, and how many segments each has."""
    line = "".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    kind = np.concatenate((_CLASS[np.minimum(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32), 256)], np.zeros(1, np.uint8)))
    cut = np.zeros(len(kind), bool)
    cut[1:-1] = _CUTS[kind[:-2], kind[1:-1]]
    known = (kind >= LETTER) & (kind <= QUOTE)
    # a single blank between others begins a part, a single line end is one; how longer white space parts hangs on what follows it
    between = known[:-2] & known[2:]
    cut[1:-1] |= between & (kind[1:-1] == BLANK)
    cut[2:] |= between & (kind[1:-1] == LINE)
    # a text's first code point begins a segment, and a blank at a text's end is followed by nothing
    last = ends[(ends > 0) & (ends < len(line))] - 1
    cut[last] &= kind[last] != BLANK
    cut[0] = True
    cut[ends] = True
    at = np.flatnonzero(cut)
    upto = np.searchsorted(at, ends)
    at = at.tolist()
    return [line[a:b] for a, b in zip(at, at[1:])], np.diff(upto, prepend=0)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    low = np.frexp((values & _U(0xFFFFFFFF)).astype(np.float64))[1]
    high = values >> _U(32)
    return (np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low) if high.any() else low).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and exceptions of a list of unsigned 64-bit values."""
    values = values.astype(_U, copy=False)
    n = len(values)
    if not n:
        return np.zeros(0, _U), np.zeros(0, _U)
    # widest[k][i]: most bits of 2**k values from i on; the list's end is no bar, as further values do not count
    widest = [np.concatenate((_widths(values), np.zeros(128, np.uint8)))]
    for k in range(6):
        last = widest[-1]
        widest.append(np.maximum(last[: -1 << k], last[1 << k :]))
    chosen = np.zeros(n, np.uint8)
    for selector in range(15, 0, -1):
        k = COUNT[selector].bit_length() - 1
        more = COUNT[selector] - (1 << k)
        np.copyto(chosen, np.uint8(selector), where=np.maximum(widest[k][:n], widest[k][more : more + n]) <= BITS[selector])
    step, at, i = np.array(COUNT)[chosen].tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    selectors = chosen[at]
    padded = np.concatenate((values, np.zeros(120, _U)))
    words = selectors.astype(_U) << _U(60)
    for selector in np.unique(selectors).tolist():
        if selector >= 2:
            mine = np.flatnonzero(selectors == selector)
            for k in range(COUNT[selector]):
                words[mine] |= padded[at[mine] + k] << _U(k * BITS[selector])
    return words, values[at[selectors == 0]]


def decode(words: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The n values of a list."""
    selectors = (words >> _U(60)).astype(np.int64)
    count = np.array(COUNT)[selectors]
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), _U)
    for selector in np.unique(selectors).tolist():
        mine = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[first[mine]] = exceptions
        elif selector >= 2:
            mask = _U((1 << BITS[selector]) - 1)
            shift = np.arange(COUNT[selector], dtype=_U) * _U(BITS[selector])
            out[first[mine][:, None] + np.arange(COUNT[selector])] = words[mine][:, None] >> shift & mask
    return out[:n]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of documents in ascending order of id, nulls first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    # modulo 2**64 a difference of ascending ids is exact and not negative; the first one is folded
    step = np.diff(known.astype(_U))
    first = [_U(2 * k if k >= 0 else -2 * k - 1) for k in known[:1].tolist()]
    lists = [np.concatenate((np.array(first, _U), step)), lengths, ids]
    coded = [encode(x) for x in lists]
    body = b"".join(a.astype("<u8").tobytes() for pair in coded for a in pair)
    sizes = [s for x, (w, e) in zip(lists, coded) for s in (len(x), len(w), len(e))]
    return _HEAD.pack(MAGIC, *sizes, len(doc_ids) - len(known), zlib.crc32(body)) + body


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids, lengths and token ids of a block."""
    magic, *sizes, nulls, crc = _HEAD.unpack_from(raw)
    if magic != MAGIC or zlib.crc32(raw[_HEAD.size :]) != crc:
        raise ValueError("damaged block of token ids")
    body, at, lists = np.frombuffer(raw, "<u8", offset=_HEAD.size), 0, []
    for n, n_words, n_more in zip(*[iter(sizes)] * 3):
        lists.append(decode(body[at : at + n_words], body[at + n_words : at + n_words + n_more], n))
        at += n_words + n_more
    steps, lengths, ids = lists
    known = steps.copy()
    if len(known):
        known[0] = ~(known[0] >> _U(1)) if int(known[0]) & 1 else known[0] >> _U(1)
    known = np.cumsum(known, dtype=_U).astype(np.int64).tolist()
    return [None] * nulls + known, lengths.astype(np.int64), ids


class _Codes(dict):
    """Segment -> number; a new one gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = code = len(self)
        self.fresh.append(segment)
        return code


class Encoder:
    """Ids of whole texts by a byte-level tokenizer, which remembers those of segments.

    Such a tokenizer first splits a text into parts by a fixed pattern (letters, digits or signs, each with
    a blank before them, or white space) and then looks at each part by itself. So a text cut where parts
    begin, as far as code points up to 255 show it, has the ids of its segments one after another, and a
    segment that was seen before need not be tokenised again. Of new segments, letters go to the
    tokenizer's model at once; the others go to the tokenizer in one text, an added token between them,
    at which it splits a text first of all. A text that holds the string of an added token is tokenised
    whole, and so is every text if ``segments`` is off or the tokenizer is of another kind.
    """

    def __init__(self, path: str, segments: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        plain = {i: t.content for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word)}
        self.bar, self.between = next(iter(plain.items()), (None, None))
        split = self.tokenizer.pre_tokenizer
        byte_level = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.segments = segments and byte_level and self.between is not None
        self.strange = re.compile("|".join(re.escape(t.content) for t in added.values()) or "(?!)")
        self._forget()

    def _forget(self) -> None:
        self.codes, self.flat, self.first = _Codes(), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new segments, behind those of the known ones."""
        tokenize, found = self.model.tokenize, []
        for s in fresh:
            word = s[1:] if s[0] == " " else s
            if not word.isalpha():
                found.append(None)
            elif s.isascii():
                found.append([t.id for t in tokenize(s.replace(" ", _FIRST))])
            else:
                found.append([t.id for t in tokenize(s.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_SIGNS))])
        rest = [i for i, ids in enumerate(found) if ids is None]
        for low in range(0, len(rest), 4096):
            mine = rest[low : low + 4096]
            ids = self._whole([self.between.join(fresh[i] for i in mine)])[0]
            at = 0
            for i in mine:
                to = ids.index(self.bar, at) if i != mine[-1] else len(ids)
                found[i], at = ids[at:to], to + 1
        known = len(self.codes) - len(fresh)
        ends = self.first[known] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.first = _grown(self.first, len(self.codes) + 1)
        self.flat = _grown(self.flat, int(ends[-1]))
        self.flat[self.first[known] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32)
        self.first[known + 1 : len(self.codes) + 1] = ends

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        whole = [i for i, t in enumerate(texts) if not self.segments or self.strange.search(t)]
        skip = set(whole)
        segments, count = _segments(["" if i in skip else t for i, t in enumerate(texts)])
        code = np.fromiter(map(self.codes.__getitem__, segments), np.int64, len(segments))
        if self.codes.fresh:
            self._learn(self.codes.fresh)
            self.codes.fresh = []
        begin = self.first[code]
        n = self.first[code + 1] - begin
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].astype(_U)
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
        lengths = np.diff(upto)
        if whole:
            parts = np.split(ids, upto[1:-1])
            for i, mine in zip(whole, self._whole([texts[i] for i in whole])):
                parts[i], lengths[i] = np.array(mine, _U), len(mine)
            ids = np.concatenate(parts)
        return ids, lengths


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy with room for ``size`` values and as many again."""
    return values if len(values) >= size else np.concatenate((values, np.zeros(2 * size - len(values), values.dtype)))


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, segments: bool) -> Encoder:
    """One tokenizer per worker process; its threads are not used, as each task has a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, segments) not in _encoders:
        _encoders[path, segments] = Encoder(path, segments)
    return _encoders[path, segments]


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = 0, segments: bool = True) -> DataFrame:
    """Tokenise every whole text and write the ids in ascending order of document id; returns the stored index.

    ``tokenizer`` is the path of a file of the tokenizers library, the same on all executors;
    ``end_id`` follows each document's ids, null for none. A null text is an empty one. Null document
    ids come first; rows of equal id come by a hash of their text, so repeated rows stay and a hot id is
    spread over files. Ids must be integers. Other columns are not written. No rows give an empty index.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError("document ids must be integers")
    folder = folder or new_path(docs.sparkSession, "token-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, path = _encoder(tokenizer, segments), *_place(folder)
        place.create_dir(path, recursive=True)
        name, part, out = f"part-{uuid.uuid4().hex}.s8b", TaskContext.get().partitionId(), None
        docs_done = ids_done = at = 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal out, at, docs_done, ids_done
            out = out or place.open_output_stream(f"{path}/{name}", compression=None)
            lengths = np.array([len(x) for x in held], np.int64)
            raw = pack(names, lengths, np.concatenate(held))
            out.write(raw)
            row = [part, name, at, len(raw), docs_done, ids_done, len(names), int(lengths.sum())]
            at, docs_done, ids_done = at + len(raw), docs_done + len(names), ids_done + row[-1]
            names.clear()
            held.clear()
            types = [pa.int32(), pa.string()] + [pa.int64()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in INDEX.split(", ")])

        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                size, low, held_ids = np.cumsum([len(t) for t in texts]), 0, 0
                while low < len(texts):
                    high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + PIECE, "right")))
                    ids, lengths = encoder(texts[low:high])
                    if end_id is not None:
                        ids = np.insert(ids, np.cumsum(lengths), _U(end_id))
                        lengths = lengths + 1
                    ends = np.cumsum(lengths)
                    for d, a, b in zip(doc_ids[low:high], (ends - lengths).tolist(), ends.tolist()):
                        names.append(d)
                        held.append(ids[a:b])
                        held_ids += b - a
                        if held_ids >= BLOCK:
                            yield block()
                            held_ids = 0
                    low = high
                if names:
                    yield block()
        finally:
            if out:
                out.close()

    index = stored(ordered.mapInArrow(put, INDEX), "token-index")
    return index.withColumn("folder", F.lit(folder))


def read(index: DataFrame) -> DataFrame:
    """The documents of a whole index, read from its files: doc_id, start, n_tokens, ids.

    ``start`` is the number of ids of all documents before it; ``ids`` holds the ids, its end id too, as
    little-endian unsigned 32-bit numbers.
    """
    # one row per file goes through this window
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    tasks = int(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // READ) + 1
    # sums of bytes before a block would need a window over all; blocks are much alike in size, so they are dealt by a hash
    blocks = index.join(parts, "part").select("folder", "file", "offset", "length", (F.col("base") + F.col("first_id")).alias("start"))
    ordered = blocks.repartition(tasks, "file", F.floor(F.col("offset") / READ)).sortWithinPartitions("folder", "file", "offset")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            for folder, file, offset, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                if opened != (folder, file):
                    place, path = _place(folder)
                    if stream:
                        stream.close()
                    opened, stream = (folder, file), place.open_input_file(f"{path}/{file}")
                doc_ids, lengths, ids = unpack(stream.read_at(length, offset))
                ends = np.cumsum(lengths)
                first = ends - lengths
                raw, cut = ids.astype("<u4").tobytes(), np.append(0, 4 * ends)
                # offsets of a binary array are 32 bits wide
                low = 0
                while low < len(doc_ids):
                    high = max(low + 1, int(np.searchsorted(cut, cut[low] + (64 << 20), "right")) - 1)
                    mine = pa.array([raw[a:b] for a, b in zip(cut[low:high].tolist(), cut[low + 1 : high + 1].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[low:high], pa.int64()), pa.array(start + first[low:high]), pa.array(lengths[low:high]), mine], ["doc_id", "start", "n_tokens", "ids"])
                    low = high
        if stream:
            stream.close()

    return ordered.mapInArrow(take, "doc_id long, start long, n_tokens long, ids binary")
