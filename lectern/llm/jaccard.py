"""N-gram Jaccard join: documents whose sets of word n-grams are similar, and their classes.

All steps are exact; only the order of tokens and the grouping of work are estimated.

1. ``memberships``: number of n-grams and a 128-bit fingerprint of each document's set. Documents
   with one fingerprint are one node from then on, so copies are never expanded into pairs.
2. Rare-first order. Documents are dealt to blocks; each block counts its n-grams once and sends
   the counts to hash ranges, which send back those that more than one document has. The order is
   (half of the hash space, document frequency, hash): the counted half comes first. A document
   whose prefix would leave the counted half sends its other n-grams too, so prefixes are always
   ordered by counts over all documents.
3. Prefix filter. Similar sets share an n-gram among the first n - ceil(s n) + 1. A prefix n-gram
   that no other document has matches nothing; a document with only such ones is done.
4. Documents that share a prefix n-gram, and whose lengths may differ so much, are put into one
   family (connected components of links to the least fingerprint of each n-gram and length band).
5. Each family is joined with prefix, length, positional and suffix filters; a pair is verified once,
   at its first common prefix n-gram, and not at all where verified links connect it already. A
   large family is cut into chunks by hash, and every two chunks meet in a task of their own.
6. Components of the verified links give each node its class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lectern.llm._shared import stored
from lectern.llm._text import LOWER, NOT_SPACE, gram_hash, long_array, mix, pieces, span_hash, words
from lectern.llm.components import components

_U = np.uint64
_HALF = _U(1 << 63)
#: N-grams of a block of documents, counts of a hash range, and n-grams of a chunk of a family.
BLOCK, RANGE, CHUNK = 1_500_000, 1_500_000, 2_000_000


def ngram_sets(column, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of an Arrow column; a shorter text is one n-gram."""
    for _, _, data, off in pieces(column):
        data = LOWER[data]
        start, end, first = words(data, off, NOT_SPACE)
        word = span_hash(data, start, end)
        gram = gram_hash(word, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(gram[a : b - n + 1])
            elif b > a:
                yield mix(gram_hash(word[a:b], b - a) + _U(b - a))
            else:
                yield np.zeros(0, _U)


def fingerprint(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection of sets of a and b n-grams at which 100 * both >= percent * either."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def memberships(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """The columns of ``docs`` but the text, with n_shingles and node (fingerprint of the set, null if empty)."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    at, kept = docs.columns.index(text_col), [docs.columns.index(f.name) for f in others]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, mark = [], []
            for grams in ngram_sets(batch.column(at), n):
                size.append(len(grams))
                mark.append(fingerprint(grams))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), long_array(size), pa.array(mark, pa.binary())], [*(f.name for f in others), "n_shingles", "node"])

    return docs.mapInArrow(look, StructType([*others, StructField("n_shingles", LongType()), StructField("node", BinaryType())]))


def _pack(keys: np.ndarray) -> bytes:
    """48-bit keys, six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _counted(grams: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams whose document frequencies the order of this document's prefix needs."""
    half = grams[: np.searchsorted(grams, _HALF)]
    return half if len(half) >= prefix_length(len(grams), percent) else grams


def _block_counts(n: int, percent: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        sets = [_counted(g, percent) >> _U(16) for g in ngram_sets(table.column("text"), n) if len(g)]
        keys, count = np.unique(np.concatenate(sets or [np.zeros(0, _U)]), return_counts=True)
        # ranges of equal width; only those that the block has are looked at, however many there are
        owner = keys // _U(-(-(1 << 48) // ranges))
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        rows = []
        for low, high in zip(edge.tolist(), edge[1:].tolist()):
            r, part, c = int(owner[low]), keys[low:high], count[low:high]
            more = np.flatnonzero(c > 1)
            rows.append((r, block, _pack(part), np.stack((more, c[more])).astype("<u4").tobytes()))
        c = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["range", "block", "keys", "more"])

    return run


def _range_frequencies(table: pa.Table) -> pa.Table:
    blocks = table.column("block").to_pylist()
    parts = [_unpack(x.as_py()) for x in table.column("keys")]
    counts = []
    for part, more in zip(parts, table.column("more")):
        c = np.ones(len(part), np.int64)
        at, many = np.frombuffer(more.as_py(), "<u4").reshape(2, -1)
        c[at] = many
        counts.append(c)
    keys, count = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total = np.add.reduceat(count[order], begin)
    frequency = np.empty(len(keys), np.int64)
    frequency[order] = np.repeat(total, np.diff(np.concatenate((begin, [len(keys)]))))
    rows, at = [], 0
    for block, part in zip(blocks, parts):
        f = frequency[at : at + len(part)]
        keep = f > 1
        if keep.any():
            rows.append((block, _pack(part[keep]), np.minimum(f[keep], 0xFFFFFFFF).astype("<u4").tobytes()))
        at += len(part)
    c = list(zip(*rows)) or [[]] * 3
    return pa.table([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], ["block", "keys", "frequency"])


def prefix(grams: np.ndarray, keys: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The prefix n-grams that another document has; ``keys`` (sorted) are the frequent ones."""
    length = prefix_length(len(grams), percent)
    known = _counted(grams, percent)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, known >> _U(16)), len(keys) - 1)
        f = np.where(keys[at] == known >> _U(16), frequency[at], 1)
    else:
        f = np.ones(len(known), np.int64)
    if np.count_nonzero(f[known < _HALF] == 1) >= length:
        return known[:0]
    order = np.lexsort((known, f, known >= _HALF))[:length]
    return known[order[f[order] > 1]]


def _block_prefixes(n: int, percent: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = {}
        if docs.num_rows and found.num_rows:
            keys = np.concatenate([_unpack(x.as_py()) for x in found.column("keys")])
            frequency = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in found.column("frequency")]).astype(np.int64)
            order = np.argsort(keys)
            keys, frequency = keys[order], frequency[order]
            for grams in ngram_sets(docs.column("text"), n):
                if len(grams):
                    first = prefix(grams, keys, frequency, percent)
                    if len(first):
                        rows.setdefault(fingerprint(grams), (len(grams), first.astype(np.int64), grams.tobytes()))
        return pa.table([pa.array(list(rows), pa.binary()), pa.array([r[0] for r in rows.values()], pa.int64()), pa.array([r[1] for r in rows.values()], pa.list_(pa.int64())), pa.array([r[2] for r in rows.values()], pa.binary())], ["node", "n", "prefix", "grams"])

    return run


class _Sets:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _few_apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """Suffix filter: whether sorted x and y may differ in at most ``most`` elements, by splitting at a median."""
    if abs(len(x) - len(y)) > most:
        return False
    if not depth or not len(x) or not len(y):
        return True
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    low, high = abs(i - j), abs((len(x) - i) - (len(y) - j))
    return low + high <= most and _few_apart(x[:i], y[:j], most - high, depth - 1) and _few_apart(x[i:], y[j:], most - low, depth - 1)


def link_forest(sets: list[np.ndarray], percent: int, allowed=None) -> list[tuple[int, int]]:
    """Verified links that connect all linked sets (indices); ``allowed(i, j)`` says which pairs to look at."""
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets)
    unique, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(unique), np.int64)
    rank[np.lexsort((unique, count))] = np.arange(len(unique))
    alone = int(np.count_nonzero(count == 1))  # these have the first ranks
    edge = np.concatenate(([0], np.cumsum(sizes)))
    ranks = [np.sort(rank[inverse[edge[i] : edge[i + 1]]]) for i in range(len(sets))]
    groups, links = _Sets(len(sets)), []
    index: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for y in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        mine, n, seen = ranks[y], sizes[y], set()
        shortest = -(-percent * n // 100)
        length = prefix_length(n, percent)
        start = int(np.searchsorted(mine[:length], alone))
        for j in range(start, length):
            for root, held in index.get(int(mine[j]), {}).items():
                if groups.find(root) == groups.find(y):
                    continue
                for x, i in held:
                    if x in seen or sizes[x] < shortest or (allowed and not allowed(x, y)):
                        continue
                    seen.add(x)
                    m, need = sizes[x], least_overlap(sizes[x], n, percent)
                    if min(m - i, n - j) < need:
                        continue
                    if not _few_apart(ranks[x][i:], mine[j:], (m - i) + (n - j) - 2 * need):
                        continue
                    if len(np.intersect1d(ranks[x], mine, assume_unique=True)) >= need:
                        links.append((x, y))
                        groups.join(x, y)
                        break
        for j in range(start, length):
            index.setdefault(int(mine[j]), {}).setdefault(groups.find(y), []).append((y, j))
    return links


def _family_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, at = {}, []
        a, b, k = (table.column(c)[0].as_py() for c in ("a", "b", "k"))
        for node, raw, chunk in zip(table.column("node").to_pylist(), table.column("grams"), table.column("chunk").to_pylist()):
            if node not in nodes:
                nodes[node] = np.frombuffer(raw.as_py(), _U)
                at.append(chunk)
        names = list(nodes)
        # pairs within a chunk are looked at where it meets the next chunk
        within = {c for c, other in ((a, b), (b, a)) if k == 1 or (c + 1) % k == other}
        links = link_forest(list(nodes.values()), percent, None if k == 1 else lambda x, y: at[x] != at[y] or at[x] in within) if len(nodes) > 1 else []
        return pa.table([pa.array([names[x] for x, _ in links], pa.binary()), pa.array([names[y] for _, y in links], pa.binary())], ["a", "b"])

    return run


def links(docs: DataFrame, total: int, text_col: str = "text", *, key, n: int = 5, percent: int = 75) -> DataFrame:
    """Verified links (a, b) of fingerprints, enough to connect all that are linked.

    ``total``: about how many n-grams there are, which sets the number of blocks and ranges.
    ``key``: a column that deals documents evenly to blocks.
    """
    blocks, ranges = int(total // BLOCK) + 1, 2 * (int(total // (2 * RANGE)) + 1)
    dealt = docs.select(F.pmod(key, F.lit(blocks)).cast("long").alias("block"), F.col(text_col).alias("text")).filter("text is not null")
    counts = dealt.groupBy("block").applyInArrow(_block_counts(n, percent, ranges), "range int, block long, keys binary, more binary")
    frequent = counts.groupBy("range").applyInArrow(_range_frequencies, "block long, keys binary, frequency binary")
    first = dealt.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(_block_prefixes(n, percent), "node binary, n long, prefix array<long>, grams binary")
    nodes = stored(first.withColumn("short", F.xxhash64("node")), "prefixes")
    # similar sets are in one length band or in neighbouring ones
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9)
    entries = nodes.select("short", band.alias("band"), F.explode("prefix").alias("token"))
    bands = entries.groupBy("token", "band").agg(F.min("short").alias("least"))
    to_least = entries.join(bands, ["token", "band"]).filter("short <> least").select(F.col("short").alias("a"), F.col("least").alias("b"))
    nearby = bands.alias("x").join(bands.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.band") + 1 == F.col("y.band"))).select(F.col("x.least").alias("a"), F.col("y.least").alias("b"))
    family = components(to_least.unionByName(nearby))
    members = nodes.select("short", "n").join(family, F.col("short") == F.col("node")).select("short", "n", "root")
    sizes = members.groupBy("root").agg((F.floor(F.sum("n") / CHUNK) + 1).alias("k"))
    placed = stored(members.select("short", "root").distinct().join(sizes, "root"), "families")
    # chunks of one family meet pairwise; a family of one chunk is one task
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")).cast("long")
    rows = nodes.select("short", "node", "grams").join(placed, "short").withColumn("chunk", chunk)
    others = F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.expr("filter(sequence(0L, cast(k as long) - 1), c -> c <> chunk)"))
    rows = rows.withColumn("other", F.explode(others)).select("root", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "k", "chunk", "node", "grams")
    return rows.groupBy("root", "a", "b").applyInArrow(_family_links(percent), "a binary, b binary")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut at white space; a text of fewer than ``n`` words is one
    n-gram, a null text or one without words has none and is linked with nothing. Two documents are
    linked where 100 * intersection >= percent * union; ``component_id`` is the smallest doc_id that
    links reach, the document's own id included. Repeated rows and repeated ids are allowed: equal
    sets are one node. A null id counts for no minimum, and a component with null ids alone has
    a null component_id. Other columns are not carried; an empty table gives an empty result.
    """
    known = stored(memberships(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", n), "sets")
    by_node = known.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = _linked_nodes(known, docs, id_col, text_col, n, percent)
    by_root = linked.join(by_node, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = linked.join(by_root, "root").select("node", "component_id")
    # stored, so that both sides of the last join are dealt by it alone and Spark can split a node with many copies
    best = stored(by_node.join(of_node, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return known.join(best, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _linked_nodes(known: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(node, root) of all fingerprints that have a link."""
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    # by id and text, so that null or repeated ids are spread too
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    return components(stored(links(docs, total, text_col, key=key, n=n, percent=percent), "links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of linked documents, all columns as they are.

    It is the one with the smallest id, null ids last, and among rows with that id the one whose hash
    is least; rows equal in id and text are one document, of which one row stays. Texts without words
    are linked with nothing and stay.
    """
    mark = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit(""))
    keyed = docs.withColumn("lectern_key", F.md5(F.concat(mark(id_col), F.lit(":"), mark(text_col))))
    known = stored(memberships(keyed.select(F.col(id_col).alias("doc_id"), "lectern_key", F.col(text_col).alias("text")), "text", n), "sets")
    linked = _linked_nodes(known, docs, id_col, text_col, n, percent)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lectern_key")).alias("first")
    by_node = known.filter("node is not null").groupBy("node").agg(order)
    first = by_node.join(linked, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select("first.lectern_key")
    chosen = first.unionByName(known.filter("node is null").select("lectern_key").distinct())
    return keyed.join(chosen, "lectern_key", "left_semi").dropDuplicates(["lectern_key"]).drop("lectern_key")
