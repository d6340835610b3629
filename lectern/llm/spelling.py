"""Spelling variants of a corpus's words, found without making pairs of words.

Words are counted, sorted by falling count (ties: code-point order) and numbered in that order, so
that of two words the smaller number is the better form. Each word then gives one row per group it
belongs to:

* for each position, the group (position, prefix, suffix) of all words that differ at most there:
  its members are one replacement apart;
* for the word itself and each of its deletions, the group of that string: a word in it is one
  deletion from the words that gave the deletions, and they are one insertion from the word.

A group keeps its size and its first two members. That is all a member needs: it has size - 1 near
words in the group, and the best of them is the first member or, for the first itself, the second. Each
pair of near words meets in exactly one group, so sums over a word's groups are its counts, and the
least number its best near word. Rows are four numbers long whatever a word's length: a group's key
is 124 bits of polynomial hashes modulo four primes, in which the changed position has coefficient 0.
A group of replacements has at most as many members as the alphabet has letters, and one of deletions
at most that many times the word's length, so no group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm._shared import stored

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Primes below 2**31 and a base for each.
LANES = [(2147483647, 1103515245), (2147483629, 1664525069), (2147483587, 907633385), (2147483579, 1406151781)]
#: Code points handled at once, and group rows of one task.
PIECE, TASK = 1 << 16, 1 << 20
#: Part of a member in its group: of a wildcard group, the word itself, a word less one code point.
WILDCARD, ITSELF, SHORTENED = 0, 1, 2
_powers: dict[tuple[int, int], np.ndarray] = {}


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUN) -> DataFrame:
    """(doc_id, run): every match of ``pattern`` in every text, A-Z lower-cased; a null text has none."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("run")).select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))


def with_deletions(found: DataFrame, one_in: int = 31) -> DataFrame:
    """(run) with a code point left out of about one run of ``one_in``, as the hash h of ``<doc_id>:<run>`` says.

    If ``one_in`` divides h, the run loses its code point number h % length. A null id counts as empty.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % one_in == 0, short).otherwise(F.col("run")).alias("run"))


def vocabulary(words: DataFrame, word_col: str = "run", *, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(rank, word, n), stored: words of enough code points and occurrences, ranked by n downwards, then word."""
    w = F.col(word_col)
    counts = words.filter(F.length(w) >= min_length).groupBy(w.alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    return stored(counts.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "vocabulary")


def _power(p: int, base: int, n: int) -> np.ndarray:
    have = _powers.get((p, base), np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), p)) % np.uint64(p)))
    _powers[p, base] = have
    return have[:n]


def group_rows(words: list[str], rank: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the keys, the parts and the ranks of all rows of some words."""
    length = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(length) - length
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(points)) - first[word]
    wild, itself, short = [], [], []
    for prime, base in LANES:
        p = np.uint64(prime)
        term = (points + np.uint64(1)) * _power(prime, base, int(length.max()))[place] % p
        upto = np.cumsum(term)
        before = upto - term
        before = (before - before[first][word]) % p
        total = np.add.reduceat(term, first) % p
        whole = total[word]
        wild.append((whole + p - term) % p)
        itself.append(total)
        after = (whole + p + p - before - term) % p
        short.append((before + after * np.uint64(pow(base, -1, prime))) % p)
    # equal neighbours give the same deletion; a deletion below the least length is no word
    keep = np.concatenate(([True], points[1:] != points[:-1])) | (place == 0)
    keep &= length[word] > min_length
    string = np.uint64(1 << 62)
    half = lambda lanes, k: lanes[k] << np.uint64(31) | lanes[k + 1]
    k1 = np.concatenate((half(wild, 0), half(itself, 0) | string, half(short, 0)[keep] | string))
    k2 = np.concatenate((half(wild, 2), half(itself, 2), half(short, 2)[keep]))
    sizes = (len(points), len(words), int(keep.sum()))
    return k1.astype(np.int64), k2.astype(np.int64), np.repeat(np.array([WILDCARD, ITSELF, SHORTENED], np.int32), sizes), np.concatenate((rank[word], rank, rank[word[keep]]))


def _memberships(vocab: DataFrame, min_length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.cumsum([len(w) for w in words])
            low = 0
            while low < len(words):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + PIECE, "right")))
                got = group_rows(words[low:high], rank[low:high], min_length)
                for at in range(0, len(got[0]), 8 * PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 8 * PIECE]) for c in got], ["k1", "k2", "part", "rank"])
                low = high

    total = vocab.agg(F.coalesce(F.sum(2 * F.length("word")), F.lit(0))).first()[0]
    return vocab.select("rank", "word").repartition(int(total // TASK) + 1).mapInArrow(cut, "k1 long, k2 long, part int, rank long")


def nearest(vocab: DataFrame, min_length: int = 7) -> DataFrame:
    """(rank, n_near, best): of each word with near words their number and the least rank."""
    group = Window.partitionBy("k1", "k2")
    # the word itself comes first among a string's members, then all go by rank
    order = group.orderBy(F.when(F.col("part") == SHORTENED, 1).otherwise(0), "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = _memberships(vocab, min_length).select(
        "rank", "part", F.row_number().over(order).alias("place"), F.count("*").over(whole).alias("size"),
        F.first("rank").over(whole).alias("top"), F.first("part").over(whole).alias("top_part"), F.nth_value("rank", 2).over(whole).alias("second"),
    ).filter("size > 1")
    near = F.when(F.col("part") != SHORTENED, F.col("size") - 1).when(F.col("top_part") == ITSELF, 1).otherwise(0)
    met = seen.select("rank", near.alias("near"), F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top")).alias("other")).filter("near > 0")
    return met.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("other").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(rank, root) for rows (rank, up): the end of each chain, by pointer doubling.

    Counts grow by the ratio at each step of a chain, so chains and rounds are few; each round is stored.
    """
    links = stored(links, "links")
    while True:
        further = links.select(F.col("rank").alias("up"), F.col("up").alias("next"))
        step = stored(links.join(further, "up", "left").select("rank", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "links")
        links = step.select("rank", "up")
        if not step.filter("moved").limit(1).count():
            return links.withColumnRenamed("up", "root")


def group_variants(vocab: DataFrame, *, min_length: int = 7, ratio: int = 10) -> DataFrame:
    """One row per word of a ``vocabulary``: word, n, n_near, form, form_n, root.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The
    form is the near word of largest n (ties: smallest in code-point order) if that n is at least
    ``ratio`` times the word's, else null; the root is the last of the chain of forms, the word itself
    if it has none. ``min_length`` is the one of the vocabulary. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must have more occurrences than their words, or chains might not end")
    near = nearest(vocab, min_length)
    form = vocab.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    good = F.col("best_n") >= ratio * F.col("n")
    known = stored(
        vocab.join(near, "rank", "left").join(form, "best", "left").select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("up"),
            F.when(good, F.col("best_word")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
        ), "near",
    )
    ends = roots(known.filter("up is not null").select("rank", "up"))
    named = ends.join(vocab.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return known.join(named, "rank", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, deletions: int | None = None, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """Variants (see ``group_variants``) among all words of all texts of ``docs``.

    ``deletions``: also leave a code point out of about one run of so many (see ``with_deletions``).
    A null or empty text has no words; repeated rows count as often as they stand there; null ids only
    matter to ``deletions``; other columns are not read.
    """
    found = runs(docs, id_col, text_col)
    words = with_deletions(found, deletions) if deletions else found.select("run")
    return group_variants(vocabulary(words, min_length=min_length, min_count=min_count), min_length=min_length, ratio=ratio)
