"""LM scoring by masked pseudo-likelihood.

Every token is predicted from the two tokens on each side of it, its own place masked. Tokens
are words: the most frequent ones of the whole corpus stand for themselves, all others for one of
``2**12`` hash buckets, and each of these is a class of its own, as target and as context. The
network (numpy) adds an embedding per offset, applies tanh and gives a softmax in two levels: over
the most frequent words and groups of classes, then over the classes of the group. A document's
score is the sum of its tokens' conditional log-probabilities.

Word counts and bucket counts cover all documents; the network starts from their shares. Documents
are dealt to blocks of about ``block_tokens`` tokens by a hash and sorted by it; stochastic gradient
descent runs over every token of each block from the same start, and the results are averaged, each row
by the tokens that moved it, so that what only few documents hold is not thinned out. So the model
does not hang on how rows were ordered or partitioned, and what is gathered grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import stored
from lectern.llm._text import NOT_SPACE, long_array, mix, one_blas_thread, pieces, span_hash, words

OFFSETS = (-2, -1, 1, 2)
BUCKET_BITS = 12
#: Classes of the first level that stand for themselves, and groups that hold all others.
HEAD, GROUPS = 32, 64
#: Networks that one task adds up.
FAN_IN = 16
_BLOCK = 16384
#: Rows of first-level classes that are worked on at once.
_ROWS = 512
_ONES = np.ones(_BLOCK, np.float32)


@dataclass
class Vocabulary:
    frequent: np.ndarray  # sorted word hashes
    rank: np.ndarray  # class of each, by falling count
    log_share: np.ndarray  # of each class in the corpus: frequent words, then buckets

    @property
    def classes(self) -> int:
        return len(self.log_share)

    @property
    def bucket_log(self) -> np.ndarray:
        """Log share of each bucket among those of its group."""
        share = np.exp(self.log_share[len(self.frequent) :])
        group = np.arange(len(share)) % GROUPS
        return np.log(share / np.bincount(group, share)[group])

    def encode(self, word: np.ndarray) -> np.ndarray:
        """Class of each word."""
        cls = len(self.frequent) + (word >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)
            cls = np.where(self.frequent[at] == word, self.rank[at], cls)
        return cls


def _encoded(column, member=NOT_SPACE):
    for low, high, data, off in pieces(column):
        start, end, first = words(data, off, member)
        yield low, high, span_hash(data, start, end), first


def vocabulary(docs: DataFrame, text_col: str, frequent: int) -> tuple[Vocabulary, int]:
    """The classes with their shares, and the number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def pack():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([long_array(keys.view(np.int64)), long_array(n)], ["word", "n"])

        for batch in batches:
            for _, _, word, _ in _encoded(batch.column(0)):
                held.append(word)
                size += len(word)
                if size > 8_000_000:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    counts = stored(docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    top = np.array([r.word for r in best], np.int64)
    total = np.zeros(1 << BUCKET_BITS)
    bucket = F.shiftrightunsigned("word", 64 - BUCKET_BITS)
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        total[r.b] = r.n
    top = top.view(np.uint64)
    np.subtract.at(total, (top >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), [r.n for r in best])
    order = np.argsort(top)
    share = np.concatenate(([r.n for r in best], total)) + 1
    return Vocabulary(top[order], order, np.log(share / share.sum())), int(share.sum()) - len(share)


class Network:
    def __init__(self, classes: int, width: int, flat: np.ndarray | None = None, log_share: np.ndarray | None = None):
        self.classes, self.width = classes, width
        # small sets of classes are split too, so that they use both levels
        self.head = min(HEAD, classes // 2)
        self.groups = min(GROUPS, classes - self.head)
        first, members = self.head + self.groups, -(-(classes - self.head) // self.groups)
        shapes = [(len(OFFSETS), classes + 1, width), (width, first), (first,), (self.groups, width, members), (self.groups, members)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        fresh = flat is None
        if fresh:
            # a fixed start: hash bits as small numbers
            noise = (mix(np.arange(ends[-1], dtype=np.uint64)) >> np.uint64(40)).astype(np.float64) / (1 << 24) - 0.5
            flat = (noise * 0.2).astype(np.float32)
        self.flat = flat
        self.inputs, self.out, self.bias, self.inner, self.inner_bias = (flat[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(shapes, ends))
        if fresh:
            share = np.full(classes, 1 / classes) if log_share is None else np.exp(log_share)
            group, place = self.place(np.arange(self.head, classes))
            mass = np.bincount(group, share[self.head :], self.groups)
            self.bias[:] = np.log(np.concatenate((share[: self.head], mass)))
            self.inner_bias[:] = 0
            self.inner_bias[group, place] = np.log(share[self.head :] / mass[group])

    def place(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each class beyond the head, and its place there."""
        return (target - self.head) % self.groups, (target - self.head) // self.groups

    def _grouped(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """Rows whose target a group holds, sorted by group; their places there; and (group, its size, from, to) of each run."""
        rows = np.flatnonzero(target >= self.head)
        group, place = self.place(target[rows])
        order = np.argsort(group, kind="stable")
        rows, group, place = rows[order], group[order], place[order]
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(rows)] if len(rows) else []
        runs = []
        for a, b in zip(cut, cut[1:]):
            g = int(group[a])
            runs.append((g, -(-(self.classes - self.head - g) // self.groups), a, b))
        return rows, place, runs

    def _first(self, target: np.ndarray) -> np.ndarray:
        return np.where(target < self.head, target, self.head + (target - self.head) % self.groups)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.inputs[0][context[:, 0]]
        for j in range(1, len(OFFSETS)):
            h += self.inputs[j][context[:, j]]
        return np.tanh(h, out=h)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        got = np.empty(len(target))
        for a in range(0, len(target), _BLOCK):
            to = target[a : a + _BLOCK]
            h, first = self.hidden(context[a : a + _BLOCK]), self._first(to)
            for low in range(0, len(to), _ROWS):
                got[a + low : a + low + _ROWS] = _own_log(self._outer(h[low : low + _ROWS]), first[low : low + _ROWS])
            rows, place, runs = self._grouped(to)
            own = h[rows]
            for g, n, low, high in runs:
                got[a + rows[low:high]] += _own_log(own[low:high] @ self.inner[g, :, :n] + self.inner_bias[g, :n], place[low:high])
        return got

    def _outer(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.out
        z += self.bias
        return z

    def train(self, context: np.ndarray, target: np.ndarray, rate: float, least: float = 0.0) -> None:
        """One step of descent on the mean loss of the block.

        With ``least``, what only some tokens move (rows of inputs, groups) goes by at least that much
        of each token's own gradient, but not by more than the mean over those tokens.
        """
        n_all = len(target)
        h, first = self.hidden(context), self._first(target)
        back, step, shift = np.empty_like(h), np.zeros_like(self.out), np.zeros_like(self.bias)
        for low in range(0, n_all, _ROWS):  # so many rows of classes stay in the core's cache
            x = h[low : low + _ROWS]
            z = self._outer(x)
            _error(z, first[low : low + _ROWS])
            np.matmul(z, self.out.T, out=back[low : low + _ROWS])
            step += x.T @ z
            shift += _ones(len(x)) @ z
        self.out -= rate / n_all * step
        self.bias -= rate / n_all * shift
        rows, place, runs = self._grouped(target)
        own, more = h[rows], np.empty((len(rows), self.width), np.float32)
        for g, n, low, high in runs:
            w, x = self.inner[g, :, :n], own[low:high]
            e = x @ w
            e += self.inner_bias[g, :n]
            _error(e, place[low:high])
            np.matmul(e, w.T, out=more[low:high])
            by = max(rate / n_all, min(least, rate / (high - low)))
            e *= by
            w -= x.T @ e
            self.inner_bias[g, :n] -= _ones(high - low) @ e
        back[rows] += more
        back *= 1 - h * h
        parts = np.ascontiguousarray(back.T)
        where = np.empty(self.classes + 1, np.int64)
        for j in range(len(OFFSETS)):
            own_count = np.bincount(context[:, j], minlength=self.classes + 1)
            keys = np.flatnonzero(own_count)
            where[keys] = np.arange(len(keys))
            inverse = where[context[:, j]]
            by = np.maximum(rate / n_all, np.minimum(least, rate / own_count[keys])).astype(np.float32)
            total = np.empty((len(keys), self.width), np.float32)
            for d, part in enumerate(parts):
                total[:, d] = np.bincount(inverse, part, len(keys))
            self.inputs[j][keys] -= by[:, None] * total

    def weights(self, seen: np.ndarray) -> np.ndarray:
        """How many tokens moved each parameter, from the tokens of each class."""
        out = Network(self.classes, self.width, np.zeros(len(self.flat), np.float32))
        total = seen.sum()
        out.inputs[:] = np.append(seen, total)[:, None]
        out.out[:], out.bias[:] = total, total
        group = np.bincount(out.place(np.arange(self.head, self.classes))[0], seen[self.head :], self.groups)
        out.inner[:], out.inner_bias[:] = group[:, None, None], group[:, None]
        return out.flat


def _ones(n: int) -> np.ndarray:
    return _ONES[:n] if n <= len(_ONES) else np.ones(n, np.float32)


def _lower(z: np.ndarray) -> None:
    """Take so much from each row, in place, that its exponentials neither overflow nor all vanish."""
    most = z.max() if z.size else 0
    if most - (z.min() if z.size else 0) < 60:
        z -= most  # one reduction of all rows is cheaper, and enough
    else:
        z -= z.max(1, keepdims=True)


def _own_log(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log of the softmax at one place of each row; ``z`` is used up."""
    _lower(z)
    at = z[np.arange(len(z)), own]
    np.exp(z, out=z)
    return at - np.log(z @ _ones(z.shape[1]))


def _error(z: np.ndarray, own: np.ndarray) -> None:
    """Softmax less the target, in place."""
    _lower(z)
    np.exp(z, out=z)
    z /= (z @ _ones(z.shape[1]))[:, None]
    z[np.arange(len(z)), own] -= 1


def contexts(cls: np.ndarray, first: np.ndarray, pad: int, at: np.ndarray | None = None) -> np.ndarray:
    """Classes beside each token (of ``at``), ``pad`` where its document ends."""
    at = np.arange(len(cls)) if at is None else at
    doc = np.searchsorted(first, at, "right") - 1
    low, high = first[doc], first[doc + 1]
    out = np.empty((len(at), len(OFFSETS)), np.int64)
    for j, step in enumerate(OFFSETS):
        near = at + step
        fits = (near >= low) & (near < high)
        out[:, j] = np.where(fits, cls[np.where(fits, near, 0)], pad)
    return out


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, frequent: int = 4096, width: int = 16, block_tokens: int = 1_000_000, rate: float = 1.0, batch: int = 512, most: int = 8192, least: float = 0.3) -> tuple[Vocabulary, Network]:
    """Counts over all documents, and a network trained on every token of all documents.

    Steps take ``batch`` tokens at first and up to ``most`` later. What tasks send is summed in levels
    of ``FAN_IN``, so that no task adds up more, however many there are. Without any word the network stays at its start. Rows that are equal in id and text
    are trained on one after the other; null ids and texts are values like others.
    """
    vocab, tokens = vocabulary(docs, text_col, frequent)
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    start = Network(vocab.classes, width, log_share=vocab.log_share)
    size = len(start.flat)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        v = held.value
        total, moved = np.zeros(size), np.zeros(v.classes, np.int64)
        block, net, seen, used = None, None, 0, None

        def add() -> None:
            nonlocal moved
            total[:] += net.flat.astype(np.float64) * net.weights(used)
            moved += used

        for rows in batches:
            owner = rows.column(0).to_numpy()
            # runs of rows of one block
            edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else []
            for low, high in zip(edge, edge[1:]):
                if owner[low] != block:
                    if seen:
                        add()
                    block, net, seen, used = owner[low], Network(v.classes, width, log_share=v.log_share), 0, np.zeros(v.classes, np.int64)
                for _, _, word, first in _encoded(rows.column(1).slice(low, high - low)):
                    if len(word):
                        cls = v.encode(word)
                        context = contexts(cls, first, v.classes)
                        used += np.bincount(cls, minlength=v.classes)
                        a = 0
                        while a < len(cls):
                            n = min(max(batch, seen // 32), most, len(cls) - a)
                            slow = 1 / (1 + seen / 400_000)
                            net.train(context[a : a + n], cls[a : a + n], rate * slow * max(1, n / 256) ** 0.5, least * slow**0.5)
                            a, seen = a + n, seen + n
        if seen:
            add()
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], ["flat", "used"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(size), np.zeros(vocab.classes, np.int64)
        for rows in batches:
            for flat, n in zip(rows.column(0), rows.column(1)):
                total += np.frombuffer(flat.as_py(), np.float32)
                used = used + np.frombuffer(n.as_py(), np.int64)
        if used.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([used.tobytes()], pa.binary())], ["flat", "used"])

    # a task takes several blocks of a large corpus, so that what tasks send stays a small share of the texts
    blocks = int(tokens // block_tokens) + 1
    tasks = max(min(blocks, 64), blocks // 8)
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    dealt = docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.col(text_col).alias("text"), key.alias("key")).filter("text is not null")
    dealt = dealt.repartition(tasks, "block").sortWithinPartitions("block", "key").select("block", "text")
    kind = "flat binary, used binary"
    total, used = np.zeros(size), np.zeros(vocab.classes, np.int64)
    sent = dealt.mapInArrow(descend, kind)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sent = sent.repartition(tasks).mapInArrow(summed, kind)
    for r in sent.toLocalIterator():
        total += np.frombuffer(bytes(r.flat), np.float32)
        used += np.frombuffer(bytes(r.used), np.int64)
    by = start.weights(used)
    flat = np.where(by > 0, total / np.maximum(by, 1), start.flat)
    return vocab, Network(vocab.classes, width, flat.astype(np.float32))


def score(docs: DataFrame, model: tuple[Vocabulary, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood (sum), mean_log_likelihood.

    A null or empty text has no tokens, a sum of 0 and a null mean. Repeated rows get equal scores;
    other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        vocab, net = held.value
        for batch in batches:
            for low, high, word, first in _encoded(batch.column(1)):
                cls = vocab.encode(word)
                value = net.log_probability(contexts(cls, first, vocab.classes), cls)
                total = np.bincount(np.repeat(np.arange(high - low), np.diff(first)), value, high - low)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), long_array(np.diff(first)), pa.array(total)], ["doc_id", "n_tokens", "log_likelihood"])

    got = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(look, f"doc_id {kind}, n_tokens long, log_likelihood double")
    return got.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
