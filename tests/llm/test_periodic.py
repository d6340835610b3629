import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lectern.llm import periodic


def plain_runs(w, min_length=6, min_exponent=4):
    """Every stretch, every period."""
    found, n = {}, len(w)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)  # of several periods of one stretch the smallest counts
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_repeats(d, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(d).encode())
    if d is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(d, text):
    w = plain_repeats(d, text)
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        d, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one", "a " * 6, "a b " * 4 + "a", "é é " * 9, "x\x1cy x\x1cy x\x1cy x\x1cy", "ab " * 5]
    for _ in range(120):
        w = []
        for _ in range(rng.choice([1, 2, 5])):
            root = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 6]))]
            w += root * rng.choice([1, 3, 4, 9]) + root[: rng.randrange(len(root))]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return out + [" ".join(fib[-1]), " ".join(fib[-1] * 5), " ".join(rng.choice("ab") for _ in range(2000)), " ".join(str(i) for i in range(700)), out[20]]


@pytest.mark.parametrize("piece", [periodic.PIECE, 60])
def test_against_every_stretch(spark, monkeypatch, piece):
    monkeypatch.setattr(periodic, "PIECE", piece)
    rows = [(i, t, 1, "r") for i, t in enumerate(texts(1))] + [(None, "u v " * 6, 1, "r"), (None, None, 1, "r"), (3, "a b c d e f g", 1, "r")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string")
    got = periodic.periodic_runs(periodic.with_repeats(docs)).select("doc_id", *periodic.digest_columns()).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted((plain_row(d, t) for d, t, *_ in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert sum(r[1] > 0 for r in want) > 40


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra double")
    got = periodic.periodic_runs(periodic.with_repeats(docs))
    assert got.columns == ["doc_id", "text", "extra", "n_words", "runs", "collapsed"] and got.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 3, 4]), st.sampled_from([2, 6]))
def test_runs_of_random_words(lists, exponent, least):
    sizes = np.array([len(w) for w in lists])
    first = np.cumsum(sizes) - sizes
    x = np.array([v + 3 * k for k, w in enumerate(lists) for v in w], np.int64)
    got = list(zip(*(a.tolist() for a in periodic.find_runs(x, np.repeat(first, sizes), np.repeat(first + sizes, sizes), least, exponent))))
    assert sorted(got) == sorted((s + f, n, q) for f, w in zip(first.tolist(), lists) for s, n, q in plain_runs(w, least, exponent))


@pytest.mark.parametrize("period", [1, 2, 7, 60_000])
def test_long_repetitive_text(period):
    words = [f"w{i % period}" for i in range(300_000)]
    began = time.process_time()
    ((n, runs, left),) = periodic._look([" ".join(words)], 6, 4)
    assert time.process_time() - began < 30
    assert n == 300_000 and runs == [{"start": 0, "length": 300_000, "period": period}] and left.split() == words[:period]
